"""Approximate nearest neighbours by cosine: one hierarchical navigable
small-world graph per shard, stored as flat neighbour arrays, with the
results of all shards merged.

Vectors with the same components are indexed once and carry the least of
their ids, so a vector that a third of the rows share is one node.  Shards
are dealt by a hash of the vector and hold a bounded number of nodes, and there are at
least as many as the cluster has cores; the index is a table with one row per
shard, built and searched by a task each.  Queries are packed into blocks of
bounded size, and every block meets every shard.  The graphs are searched in
single precision; what they find is scored in double precision on the
original components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmap.llm.common import slices, stored


class Graph:
    """Small-world graph over unit vectors.

    ``base`` (nodes x 2m) and ``upper`` (rows x m) are flat neighbour arrays
    padded with -1; node i has ``levels[i]`` rows of ``upper`` from
    ``start[i]``, one for each level above the base.
    """

    def __init__(self, unit: np.ndarray, levels: np.ndarray, m: int, base: np.ndarray | None = None,
                 upper: np.ndarray | None = None, entry: int = -1):
        self.unit, self.levels, self.m = unit, levels, m
        n = len(unit)
        self.start = np.concatenate([[0], np.cumsum(levels)])
        self.base = np.full((n, 2 * m), -1, np.int32) if base is None else base
        self.upper = np.full((int(self.start[-1]), m), -1, np.int32) if upper is None else upper
        self.entry = entry
        self.stamp = np.zeros(n, np.int64)
        self.now = 0

    def links(self, node: int, level: int) -> np.ndarray:
        return self.base[node] if level == 0 else self.upper[self.start[node] + level - 1]

    def search(self, q: np.ndarray, found: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` most similar nodes reached from ``found`` on a level,
        as (similarity, node), best first."""
        self.now += 1
        stamp, now, unit = self.stamp, self.now, self.unit
        best = list(found)  # min-heap: worst on top
        heapq.heapify(best)
        queue = [(-s, i) for s, i in found]
        heapq.heapify(queue)
        for _, i in found:
            stamp[i] = now
        while queue:
            s, i = heapq.heappop(queue)
            if len(best) >= ef and -s < best[0][0]:
                break
            near = self.links(i, level)
            near = near[near >= 0]
            near = near[stamp[near] != now]
            if not len(near):
                continue
            stamp[near] = now
            for s, j in zip((unit[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (s, j))
                    heapq.heappush(queue, (-s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                    heapq.heappush(queue, (-s, j))
        return sorted(best, key=lambda x: (-x[0], x[1]))

    def diverse(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of (similarity, node), best first, those that are nearer to the
        centre than to any one taken before; then the best others."""
        if len(near) <= most:
            return [i for _, i in near]
        nodes = [i for _, i in near]
        v = self.unit[nodes]
        between = v @ v.T
        closest = np.full(len(nodes), -np.inf, np.float32)
        taken, rest = [], []
        for k, (s, i) in enumerate(near):
            if s > closest[k]:
                taken.append(i)
                if len(taken) == most:
                    return taken
                np.maximum(closest, between[k], out=closest)
            else:
                rest.append(i)
        return taken + rest[:most - len(taken)]

    def connect(self, node: int, others: list[int], level: int) -> None:
        own = self.links(node, level)
        own[:len(others)] = others
        for j in others:
            back = self.links(j, level)
            free = np.flatnonzero(back < 0)
            if len(free):
                back[free[0]] = node
                continue
            around = np.append(back, np.int32(node))
            sims = self.unit[around] @ self.unit[j]
            order = np.argsort(-sims, kind="stable")
            kept = self.diverse([(float(sims[k]), int(around[k])) for k in order], len(back))
            back[:] = -1
            back[:len(kept)] = kept

    def insert(self, node: int, ef: int) -> None:
        level = int(self.levels[node])
        if self.entry < 0:
            self.entry = node
            return
        q, top = self.unit[node], int(self.levels[self.entry])
        found = [(float(self.unit[self.entry] @ q), self.entry)]
        for at in range(top, level, -1):
            found = self.search(q, found[:1], 1, at)
        for at in range(min(top, level), -1, -1):
            found = self.search(q, found, ef, at)
            self.connect(node, self.diverse(found, self.m), at)
        if level > top:
            self.entry = node

    def nearest(self, q: np.ndarray, ef: int) -> list[int]:
        if self.entry < 0:
            return []
        found = [(float(self.unit[self.entry] @ q), self.entry)]
        for at in range(int(self.levels[self.entry]), 0, -1):
            found = self.search(q, found[:1], 1, at)
        return [i for _, i in self.search(q, found, ef, 0)]


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (scaled by their largest component first,
    so that very large or small components do not overflow)."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


def level_of(vector: bytes, m: int) -> int:
    """Level drawn from a hash of the vector: geometric with factor 1/m."""
    u = (xxhash.xxh64_intdigest(vector, seed=7) + 1) / 2.0 ** 64
    return min(int(-np.log(u) / np.log(m)), 16)


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v): float64 bytes of the vectors without null or non-finite
    components and with a length above zero; null ids take no part."""
    rows = table.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_list"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            column = part["_list"]
            flat = column.flatten().to_numpy(zero_copy_only=False) + 0.0  # one zero, not two; null is not a number
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])[ends]
            some = np.concatenate([[0], np.cumsum(flat != 0)])[ends]
            keep = np.flatnonzero((np.diff(bad) == 0) & (np.diff(some) > 0))
            vectors = [flat[ends[i]:ends[i + 1]].tobytes() for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([part["_id"].take(pa.array(keep, pa.int64())), pa.array(vectors, pa.binary())],
                                             names=["_id", "_v"])

    return rows.mapInArrow(run, f"_id {kind}, _v binary")


def shards_for(nodes: int, shard_rows: int, cores: int, least: int = 1000) -> int:
    """Shards of at most ``shard_rows`` nodes; of fewer, down to ``least``, as
    long as some core would have none."""
    return max(1, -(-nodes // shard_rows), min(cores, nodes // least))


def build_index(vectors: DataFrame, ids_kept: int, shard_rows: int = 6000, m: int = 12, ef: int = 64) -> DataFrame:
    """Index of (_id, _v): (shard, dim, ids, vectors, levels, base, upper,
    entry), one row per shard and dimension.  ``ids`` holds for each node
    the least ``ids_kept`` ids of its vector, padded with nulls.  A shard has
    about ``shard_rows`` nodes, however many rows there are."""
    order = Window.partitionBy("_v").orderBy("_id")
    nodes = stored(vectors.distinct().withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= ids_kept)
                   .groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids")), "vector-nodes")
    shards = shards_for(nodes.count(), shard_rows, vectors.sparkSession.sparkContext.defaultParallelism)
    kind = vectors.schema["_id"].dataType.simpleString()
    rows = nodes.withColumn("shard", F.pmod(F.xxhash64("_v"), F.lit(shards))).withColumn("dim", F.octet_length("_v"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_v")  # the same graph in whatever order rows arrive
        raw = group["_v"].to_pylist()
        v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
        graph = Graph(unit_rows(v), np.array([level_of(x, m) for x in raw], np.int32), m)
        for i in range(len(raw)):
            graph.insert(i, ef)
        return pa.table({
            "shard": group["shard"].slice(0, 1), "dim": group["dim"].slice(0, 1), "ids": [group["_ids"].to_pylist()],
            "vectors": [v.tobytes()], "levels": [graph.levels.tobytes()], "base": [graph.base.tobytes()],
            "upper": [graph.upper.tobytes()], "entry": pa.array([graph.entry], pa.int32())})

    schema = (f"shard long, dim int, ids array<array<{kind}>>, vectors binary, levels binary, base binary, "
              "upper binary, entry int")
    # dealt by number, so that each task has about one shard to build
    dealt = rows.repartitionByRange(shards, "shard")
    return stored(dealt.groupBy("shard", "dim").applyInArrow(run, schema), "vector-index")


def search_index(index: DataFrame, queries: DataFrame, k: int, m: int = 12, ef: int = 128,
                 block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query
    (_id, _v), best first, ties to the smaller id; the query's own id is no
    candidate."""
    kind = queries.schema["_id"].dataType.simpleString()
    blocks = max(1, -(-queries.count() // block))
    # queries in blocks of one dimension, each met by every shard of it
    grouped = (queries.withColumn("dim", F.octet_length("_v"))
               .withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(blocks)))
               .groupBy("dim", "block").agg(F.collect_list(F.struct("_id", "_v")).alias("queries")))
    # the join is by dimension and shard, and every pair of a block and a shard is
    # a unit of work of its own
    held = index.select("dim", "shard")
    pairs = grouped.join(held, "dim").join(index, ["dim", "shard"])
    met = pairs.repartition(min(100_000, max(1, blocks * held.count())), "shard", "block").select(
        "ids", "vectors", "levels", "base", "upper", "entry", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            levels = np.frombuffer(row["levels"], np.int32)
            v = np.frombuffer(row["vectors"], np.float64).reshape(len(levels), -1)
            graph = Graph(unit_rows(v), levels, m, np.frombuffer(row["base"], np.int32).reshape(len(levels), 2 * m),
                          np.frombuffer(row["upper"], np.int32).reshape(-1, m), row["entry"])
            out = []
            for query in row["queries"]:
                q = np.frombuffer(query["_v"], np.float64)
                near = graph.nearest(unit_rows(q[None])[0], ef)
                scored = [(-s, i) for s, n in zip(cosines(v[near], q).tolist(), near, strict=True)
                          for i in row["ids"][n] if i != query["_id"]]
                out += [(query["_id"], i, -s) for s, i in heapq.nsmallest(k, scored)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], t) for j, t in enumerate((part.schema.field("ids").type.value_type.value_type,) * 2
                                                                         + (pa.float64(),))],
                names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest_vectors(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                    shard_rows: int = 6000, m: int = 12, ef_build: int = 64, ef_search: int = 128) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k``
    nearest rows of every row where ``is_query`` (a condition on the id, by
    the name ``_id``) holds.

    Defined results: rows with a null id or a vector that is null, empty,
    zero or holds null or non-finite components take no part; fewer than
    ``k`` candidates are all returned; rows that repeat an id and a vector
    count once, and all rows with the query's id are its own; vectors are
    compared with those of the same number of components only; an empty
    table gives an empty result; other columns are ignored.
    """
    vectors = stored(usable_vectors(table, id_col, vector_col), "vectors")
    index = build_index(vectors, k + 1, shard_rows, m, ef_build)
    return search_index(index, vectors.filter(is_query).distinct(), k, m, ef_search)
