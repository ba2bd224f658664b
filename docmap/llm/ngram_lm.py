"""Stupid-backoff language-model scores from n-gram counts of all documents.

Documents are dealt to blocks.  A block lists its distinct n-grams with their
counts, cut by ranges of the n-gram's hash; the ranges of all blocks meet in
one group each, which is the part of the count table for that range.  There
the counts are added and joined back to the lists of the blocks, which then
look up every n-gram of every position, score it and add up the logarithms
of each document.  What is shuffled are sorted arrays of hashes, one entry
for a block's distinct n-gram, so a very common n-gram costs one entry per
block; nothing is kept in one place for the whole corpus.

Words and pairs are counted first.  A longer n-gram can only occur ``least``
times if both n-grams of one word less in it do, so each further order lists
only those (with ``least`` 1 all); the counts that matter stay exact.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmap.llm.common import free_shuffles, stored, worker_state
from docmap.llm.jaccard_join import MIX, STEP, WordHashes
from docmap.session import plan_size_bytes

HASH_BYTES = 6  # of each hash that are sent; the range it is in is known besides


def block_grams(texts: list[str | None], order: int, hashes: WordHashes) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document of each word, [hash of the n-gram that ends at each word for
    n = 1..order]); where a document has too few words before, the n-gram
    is the one of all its words so far (its hash is that of a lower order)."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    doc = np.repeat(np.arange(len(split)), [len(s) for s in split])
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split)), np.uint64, len(doc))
    grams = [_mix(h)]
    long = h
    for n in range(2, order + 1):
        # hash of n words: that of the n - 1 before, and the last one
        before = np.concatenate([np.zeros(1, np.uint64), long[:-1]])
        longer = before * np.uint64(STEP) + h + np.uint64(n)
        whole = np.zeros(len(h), bool)
        whole[n - 1:] = doc[n - 1:] == doc[:len(doc) - n + 1]
        long = np.where(whole, longer, long)
        grams.append(_mix(long))
    return doc, grams


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(MIX[0])
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def position_in_document(doc: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))


def pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def backoff_scores(counts: list[np.ndarray], place: np.ndarray, total: int, discount: float,
                   least: int) -> np.ndarray:
    """log score of every word: the longest n-gram that ends there with at
    least ``least`` occurrences, by the count of its context, times
    ``discount`` for every order that it falls short of the longest possible."""
    out = np.log(counts[0] / total)
    for n in range(2, len(counts) + 1):
        here = counts[n - 1].astype(np.float64)
        context = np.ones(len(here))
        context[1:] = counts[n - 2][:-1]
        possible = place >= n - 1
        seen = possible & (here >= least)
        ratio = np.log(np.where(seen, here, 1) / np.where(seen, context, 1))
        out = np.where(seen, ratio, np.where(possible, out + np.log(discount), out))
    return out


def candidates(n: int, counts: list[np.ndarray], place: np.ndarray, least: int) -> np.ndarray:
    """Positions whose n-gram is looked up: those that have one, and from
    n = 3 on only if both n-grams of one word less in it are frequent."""
    out = place >= n - 1
    if n > 2:
        shorter = counts[n - 2] >= least
        out &= shorter
        out[1:] &= shorter[:-1]
    return out


def known_counts(grams: list[np.ndarray], place: np.ndarray, counted: pa.Table, least: int) -> list[np.ndarray]:
    """Counts in the corpus of the n-grams at every position of a block (0:
    not looked up), from the block's answers."""
    counted = counted.sort_by([("n", "ascending"), ("range", "ascending")])
    orders, found = counted["n"].to_numpy(), counted["totals"].to_pylist()
    counts: list[np.ndarray] = []
    for n, h in enumerate(grams, 1):
        mask = candidates(n, counts, place, least)
        distinct, inverse = np.unique(h[mask], return_inverse=True)
        table = np.frombuffer(b"".join([found[i] for i in np.flatnonzero(orders == n)]), "<u4")
        if len(table) != len(distinct):
            raise RuntimeError("the documents changed between two reads")
        c = np.zeros(len(h))
        c[mask] = table[inverse]
        counts.append(c)
    return counts


def _count_orders(rows: DataFrame, answers: DataFrame | None, orders: list[int], ranges: int, least: int) -> DataFrame:
    """Adds the counts of some orders to the answers: (block, n, range,
    totals, words), where ``totals`` has a uint32 for each distinct n-gram
    of the block in the range, in the order of their hashes."""
    bits = ranges.bit_length() - 1

    def listed(block: int, grams: list[np.ndarray], counts: list[np.ndarray], place: np.ndarray) -> pa.Table:
        out: dict[str, list] = {"block": [], "n": [], "range": [], "hashes": [], "counts": []}
        for n in orders:
            distinct, times = np.unique(grams[n - 1][candidates(n, counts, place, least)], return_counts=True)
            cuts = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange(ranges + 1, dtype=np.uint64))
            for r in range(ranges):
                if cuts[r] < cuts[r + 1]:
                    out["block"].append(block)
                    out["n"].append(n)
                    out["range"].append(r)
                    out["hashes"].append(pack(distinct[cuts[r]:cuts[r + 1]]))
                    out["counts"].append(times[cuts[r]:cuts[r + 1]].astype("<u4").tobytes())
        return pa.table([pa.array(out["block"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["range"], pa.int64()),
                         pa.array(out["hashes"], pa.binary()), pa.array(out["counts"], pa.binary())], names=list(out))

    def first(group: pa.Table) -> pa.Table:
        doc, grams = block_grams(group["_text"].to_pylist(), orders[-1], worker_state(("shingles",), WordHashes))
        return listed(group["block"][0].as_py(), grams, [], position_in_document(doc))

    def further(group: pa.Table, counted: pa.Table) -> pa.Table:
        doc, grams = block_grams(group["_text"].to_pylist(), orders[-1], worker_state(("shingles",), WordHashes))
        place = position_in_document(doc)
        counts = known_counts(grams[:orders[0] - 1], place, counted, least)
        return listed(group["block"][0].as_py(), grams, counts, place)

    def totals(group: pa.Table) -> pa.Table:
        hashes = [unpack(x) for x in group["hashes"].to_pylist()]
        counts = [np.frombuffer(x, "<u4") for x in group["counts"].to_pylist()]
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts))[inverse].astype("<u4")
        cuts = np.cumsum([0, *map(len, hashes)])
        return pa.table([group["block"], group["n"], group["range"],
                         pa.array([total[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                         pa.array([int(c.sum()) for c in counts], pa.int64())],
                        names=["block", "n", "range", "totals", "words"])

    schema = "block long, n int, range long, hashes binary, counts binary"
    blocks = rows.groupBy("block")
    lists = blocks.applyInArrow(first, schema) if answers is None else (
        blocks.cogroup(answers.groupBy("block")).applyInArrow(further, schema))
    new = stored(lists.groupBy("n", "range").applyInArrow(
        totals, "block long, n int, range long, totals binary, words long"), "ngram-counts")
    return new if answers is None else answers.unionByName(new)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3,
                    discount: float = 0.4, least: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """``id_col``, ``n_words``, ``log_score`` (sum over the words),
    ``mean_log_score`` of every document under the model of all documents.

    Words are split at ASCII white space after lower-casing A-Z.  N-grams of
    two or more words count as seen from ``least`` occurrences on: with 1
    every count is used and every n-gram listed; with more, as the query's
    SQL has it, n-grams are not seen just because of the text that is scored,
    and longer ones need fewer lists.
    Defined results: a null or empty text has 0 words, log score 0 and a
    null mean; a null id is passed on; repeated rows are counted and scored
    each; an empty table gives an empty result; other columns are ignored.
    """
    if least < 1:
        raise ValueError("least must be 1 or more")
    spark = docs.sparkSession
    size = plan_size_bytes(docs)
    blocks = -(-size // block_bytes) if size < 1 << 62 else 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << max(3, (blocks // 4).bit_length())  # a power of two: ranges are leading bits of the hash
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn(
        "block", F.pmod(F.xxhash64("_id", "_text"), F.lit(int(blocks))))
    answers = None
    for orders in [list(range(1, min(order, 2) + 1)), *[[n] for n in range(3, order + 1)]]:
        answers = _count_orders(rows, answers, orders, ranges, least)
        free_shuffles(spark)  # of the lists, before the texts are shuffled again
    total = answers.filter("n = 1").agg(F.sum("words").alias("words")).first()["words"] or 0
    kind = rows.schema["_id"].dataType.simpleString()

    def score(group: pa.Table, counted: pa.Table) -> pa.Table:
        texts = group["_text"].to_pylist()
        doc, grams = block_grams(texts, order, worker_state(("shingles",), WordHashes))
        place = position_in_document(doc)
        counts = known_counts(grams, place, counted, least)
        words = np.bincount(doc, minlength=len(texts))
        logs = np.bincount(doc, weights=backoff_scores(counts, place, total, discount, least), minlength=len(texts))
        mean = [s / w if w else None for s, w in zip(logs.tolist(), words.tolist(), strict=True)]
        return pa.table([group["_id"], pa.array(words, pa.int64()), pa.array(logs.astype(np.float64)), pa.array(mean, pa.float64())],
                        names=["_id", "n_words", "log_score", "mean_log_score"])

    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, f"_id {kind}, n_words long, log_score double, mean_log_score double")
    return out.withColumnRenamed("_id", id_col)
