"""Periodic runs of words, found in tiles of every period octave.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends and that is at least max(24, 3q) words long.

Octave k looks for the periods below 2B and from B (the first, B = 8, for all
below 16) at boundaries, every B words of a document.  A run's matches (the
words that equal the word q later) are at least 2B in a row, so they hold a
boundary with B of them after it.  At a boundary where a fingerprint of B
words comes back q words later, Z-functions over the 4B words after and the 2B
words before it say how far the match with period q goes, at most 2B each way;
a match of 2B words or more whose first q words are no power of a shorter word
is a fragment of a run of period q.  Fragments of neighbouring boundaries
overlap, so the whole run is the union of its fragments.

A tile is a range of boundaries of one document and octave with 2B words
before and 4B behind.  Documents that fit into one tile are solved where they
are read; longer ones are exploded into tiles, which are dealt over the
cluster.  Fragments are shuffled by document and period and stitched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmap.llm.common import slices, stored

FIRST = 8        # spacing of the boundaries of the first octave
LEAST = 24       # least length of a run
RUNS = "array<struct<start:long,length:long,period:long>>"


def octaves(n: int) -> Iterator[tuple[int, int]]:
    """(spacing of the boundaries, least period) of the octaves in which a
    document of n words may have a run."""
    b, low = FIRST, 1
    while max(LEAST, 3 * low) <= n:
        yield b, low
        low, b = 2 * b, 2 * b


def z_function(s: list[int]) -> list[int]:
    """For each place, how many elements from there equal those from the start."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_boundary(codes: np.ndarray, first: int, end: int, c: int, b: int, periods: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(period, start, stop) of the fragments at boundary ``c``: words
    [start, stop) equal those one period later.  The document's words here
    are ``codes[first:end]``."""
    ahead = codes[c:min(c + 4 * b, end)].tolist()
    z = z_function(ahead)
    behind = codes[max(first, c - 2 * b):c][::-1].tolist()
    near = codes[max(first, c - 2 * b):min(c + 2 * b, end)][::-1].tolist()  # from c + 2b - 1 backwards
    back = z_function([*behind, -1, *near])
    top = min(c + 2 * b, end) - 1
    reach = np.maximum.accumulate(np.arange(1, len(z)) + np.array(z[1:], np.int64))  # reach[p-1]: longest start with a period of at most p
    for q in periods.tolist():
        forth = min(z[q], 2 * b)
        before = back[len(behind) + 1 + top - (c + q - 1)] if behind and c + q - 1 <= top else 0
        if forth + before < 2 * b:
            continue
        least = int(np.searchsorted(reach, q)) + 1  # smallest period of the q words from here
        if least < q and q % least == 0:
            continue
        yield q, c - before, c + forth


def fragments(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, only: tuple[int, int] | None = None,
              inner: tuple[int, int] | None = None) -> dict[tuple[int, int], list[list[int]]]:
    """(document, period) -> merged [start, stop) of matches, in places of ``codes``.

    ``codes`` holds the words of several documents one after the other; words
    of different documents never match, as every stretch is kept inside its
    own.  ``only`` and ``inner`` restrict the work to one octave and to the
    boundaries of a range.
    """
    found: dict[tuple[int, int], list[list[int]]] = {}
    longest = int((ends - starts).max()) if len(starts) else 0
    h, width = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019), 1
    h ^= h >> np.uint64(29)
    for b, low in octaves(longest):
        while width < b:  # h[i] becomes a fingerprint of the next 2 * width words
            h = h[:len(h) - width] * np.uint64(0xD6E8FEB86659FD93 + 2 * width) + h[width:]
            h ^= h >> np.uint64(31)
            width *= 2
        if only and (b, low) != only:
            continue
        docs = np.flatnonzero(ends - starts >= max(LEAST, 3 * low))
        # a boundary has room for b words one least period later
        count = np.maximum((ends[docs] - starts[docs] - b - low) // b + 1, 0)
        doc = np.repeat(docs, count)
        c = starts[doc] + b * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
        if inner:
            keep = (c >= inner[0]) & (c < inner[1])
            doc, c = doc[keep], c[keep]
        lags = np.arange(low, 2 * b)
        rows = max(1, 2_000_000 // len(lags))
        for s in range(0, len(c), rows):
            at = c[s:s + rows, None] + lags
            fits = at + b <= ends[doc[s:s + rows], None]
            same = fits & (h[np.where(fits, at, 0)] == h[c[s:s + rows], None])
            for i in np.flatnonzero(same.any(axis=1)).tolist():
                d = int(doc[s + i])
                for q, start, stop in at_boundary(codes, int(starts[d]), int(ends[d]), int(c[s + i]), b, lags[same[i]]):
                    parts = found.setdefault((d, q), [])
                    if parts and start <= parts[-1][1]:
                        parts[-1][1] = max(parts[-1][1], stop)
                    else:
                        parts.append([start, stop])
    return found


def _codes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal numbers for equal words, and where each document starts and ends."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for x in words for w in x], pa.binary())
    ends = np.cumsum(size)
    return flat.dictionary_encode().indices.to_numpy().astype(np.int64), ends - size, ends


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without the repetitions of runs, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def _fields(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("_key", pa.int64()), ("_id", id_type), ("_kind", pa.int8()), ("_text", pa.string()), ("_period", pa.int64()),
                      ("_from", pa.int64()), ("_to", pa.int64()), ("_octave", pa.int64()), ("_low", pa.int64()), ("_first", pa.int64()),
                      ("_words", pa.int64()), ("_codes", pa.binary())])


WHOLE, FRAGMENT, TILE, OPEN = 0, 1, 2, 3  # a document without runs, a fragment, a tile of a long document, a document that may have runs


def cut_into_tiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_words: int = 1 << 16) -> DataFrame:
    """Stored rows: documents without a fragment, with their final text digest
    in ``_text``; other documents with their whole text; the fragments of
    documents of at most ``tile_words`` words; the tiles of longer ones."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36

        def solve(held: list[tuple]) -> pa.RecordBatch:
            """Documents of at most ``tile_words`` words: (key, id, text, words)."""
            codes, starts, ends = _codes([x[3] for x in held])
            out, may = [], set()
            for (d, q), parts in fragments(codes, starts, ends).items():
                may.add(d)
                first = int(starts[d])
                out += [{"_key": held[d][0], "_kind": FRAGMENT, "_period": q, "_from": x - first, "_to": y - first} for x, y in parts]
            for d, (k, i, text, words) in enumerate(held):
                if d in may:
                    out.append({"_key": k, "_id": i, "_kind": OPEN, "_text": text})
                else:
                    out.append({"_key": k, "_id": i, "_kind": WHOLE, "_text": hashlib.sha256(b" ".join(words)).hexdigest()})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        held, size, schema = [], 0, None
        for part in slices(batches):
            schema = _fields(part["_id"].type)
            for i, text in zip(part["_id"].to_pylist(), part["_text"].to_pylist()):
                words = text.encode().split()  # bytes: white space is ASCII only
                key += 1
                if len(words) > tile_words:
                    yield pa.RecordBatch.from_pylist([{"_key": key, "_id": i, "_kind": OPEN, "_text": text}], schema=schema)
                    codes = _codes([words])[0].astype("<u4")
                    for tile in tiles(key, codes, tile_words):
                        yield pa.RecordBatch.from_pylist([tile], schema=schema)
                    continue
                held.append((key, i, text, words))
                size += len(words)
                if size >= 200_000 or len(held) >= 4096:
                    yield solve(held)
                    held, size = [], 0
        if held:
            yield solve(held)

    return stored(rows.mapInArrow(run, f"_key long, _id {kind}, _kind byte, _text string, _period long, _from long, _to long, "
                                       "_octave long, _low long, _first long, _words long, _codes binary"), "runs")


def tiles(key: int, codes: np.ndarray, tile_words: int) -> Iterator[dict]:
    """One row for every octave and range of boundaries of a long document."""
    n = len(codes)
    for b, low in octaves(n):
        span = max(tile_words // b, 2) * b
        for first in range(0, n, span):
            a = max(0, first - 2 * b)
            yield {"_key": key, "_kind": TILE, "_octave": b, "_low": low, "_first": first - a, "_from": a, "_words": span,
                   "_codes": codes[a:min(n, first + span + 4 * b)].tobytes()}


def solve_tiles(cut: DataFrame) -> DataFrame:
    """``_key``, ``_period``, ``_from``, ``_to``: the fragments of all tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            t = part.to_pylist()[0]
            codes = np.frombuffer(t["_codes"], "<u4").astype(np.int64)
            found = fragments(codes, np.zeros(1, np.int64), np.array([len(codes)]), (t["_octave"], t["_low"]),
                              (t["_first"], t["_first"] + t["_words"]))
            out = [(t["_key"], q, x + t["_from"], y + t["_from"]) for (_, q), parts in found.items() for x, y in parts]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_key", "_period", "_from", "_to"])

    dealt = (cut.filter(F.col("_kind") == TILE).select("_key", "_octave", "_low", "_first", "_from", "_words", "_codes")
             .repartition("_key", "_octave", "_from"))
    return dealt.mapInArrow(run, "_key long, _period long, _from long, _to long")


def stitched(found: DataFrame) -> DataFrame:
    """``_key``, ``_runs``: the runs of each document, by start and period.

    Fragments of one document and period that overlap or touch are one match;
    a document has at most one of them per tile and stretch.
    """
    by_period = Window.partitionBy("_key", "_period").orderBy("_from", "_to")
    reach = F.max("_to").over(by_period.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("_new", (reach.isNull() | (F.col("_from") > reach)).cast("int"))
    islands = islands.withColumn("_island", F.sum("_new").over(by_period))
    whole = islands.groupBy("_key", "_period", "_island").agg(F.min("_from").alias("start"), F.max("_to").alias("_to"))
    length = F.col("_to") - F.col("start") + F.col("_period")
    return (whole.withColumn("length", length).filter((F.col("length") >= LEAST) & (F.col("length") >= 3 * F.col("_period")))
            .groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", F.col("_period").alias("period"), "length"))).alias("_runs")))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_words: int = 1 << 16) -> DataFrame:
    """``id_col``, ``runs`` (start, length and period in words, by start, then
    period) and ``collapsed_sha256`` of every whole text: the digest (UTF-8)
    of its words without those that a run holds after its first period, joined
    by one space.

    Words are what ASCII white space separates.  Defined results: a null or
    empty text has no words and no runs; a null or repeated id is passed on,
    each row is a document of its own; an empty table gives an empty result;
    other columns are ignored.
    """
    cut = cut_into_tiles(docs, id_col, text_col, tile_words)
    near = cut.filter(F.col("_kind") == FRAGMENT).select("_key", "_period", "_from", "_to")
    runs = stitched(near.unionByName(solve_tiles(cut)))
    may = cut.filter(F.col("_kind") == OPEN).select("_key", "_id", "_text").join(runs.withColumnRenamed("_key", "_of"), F.col("_key") == F.col("_of"), "left")
    may = may.select("_id", "_text", F.transform(F.coalesce("_runs", F.array()), lambda r: F.struct(
        r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).cast(RUNS).alias("runs"))
    kind = cut.schema["_id"].dataType.simpleString()
    list_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            digests = [hashlib.sha256(_collapsed(text.encode().split(), [(r["start"], r["length"], r["period"]) for r in rs])).hexdigest()
                       for text, rs in zip(part["_text"].to_pylist(), part["runs"].to_pylist())]
            yield pa.RecordBatch.from_arrays([part["_id"], part["runs"].cast(list_type), pa.array(digests, pa.string())], names=["_id", "runs", "collapsed_sha256"])

    done = cut.filter(F.col("_kind") == WHOLE).select("_id", F.array().cast(RUNS).alias("runs"), F.col("_text").alias("collapsed_sha256"))
    out = may.mapInArrow(finish, f"_id {kind}, runs {RUNS}, collapsed_sha256 string").unionByName(done)
    return out.withColumnRenamed("_id", id_col)


def run_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``n_runs``, the run with the greatest exact exponent (ties: smallest
    start, then period; nulls without a run) and a digest of all runs."""
    rows = found.select(F.col(id_col).alias("_id"), "runs", "collapsed_sha256")
    kind = rows.schema["_id"].dataType.simpleString()
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for part in slices(batches, 4096):
            out = []
            for runs in part["runs"].to_pylist():
                if not runs:
                    out.append((0, None, None, None, None, none))
                    continue
                runs = [(r["start"], r["length"], r["period"]) for r in runs]
                s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
                listed = "".join(f"{x},{y},{z}\n" for x, y, z in runs)
                out.append((len(runs), s, n, q, 1000 * n // q, hashlib.sha256(listed.encode()).hexdigest()))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([part["_id"], *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string()),
                                              part["collapsed_sha256"]], names=["_id", *numbers, "runs_sha256", "collapsed_sha256"])

    return rows.mapInArrow(run, f"_id {kind}, {', '.join(f'{c} long' for c in numbers)}, runs_sha256 string, collapsed_sha256 string").withColumnRenamed("_id", id_col)


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text in which, for one id in ten by its checksum h, every word from
    word a on is word a + (i - a) % p of the original; g = floor(h / 10),
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).  Other texts, and
    those without a word or an id, stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)
