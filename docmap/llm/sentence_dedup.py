"""Substring deduplication over sliding runs of sentences.

From every sentence on and up to every sentence, the shortest run of
consecutive sentences (at least ``min_sentences`` of them and ``min_words``
words) is hashed; these cover every longer run whole.  Runs are joined
globally on the hash; of a run that occurs more than once, all occurrences
but the first (least id, then place) are repeats, and every sentence that a
repeat covers is removed.  Only hashes and places are shuffled, and counts
are combined before the shuffle, so a passage that a third of the documents
share costs one partial count per task.  Shuffle files are removed after each
pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmap.llm.common import slices, stored

# A sentence ends after . ! ? (and closing quotes or brackets) before white
# space, after an ideographic full stop, or at a line break; the white space
# belongs to the sentence before.
END = re.compile(r"[.!?…]+[\"')\]”’]*\s+|[。｡！？]+[\"')\]”’」』）】》〉]*\s*|\s*\n\s*")
# Scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han): every
# character counts as a word.
BARE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{BARE}]")
WORD = re.compile(rf"[{BARE}]\s*|[^\s{BARE}]+\s*")
SPACED_WORD = re.compile(r"\S+\s*")
FACTOR = 0x9E3779B97F4A7C15


def is_spaced(text: str) -> bool:
    return text.isascii() or not UNSPACED.search(text)


def anchors(hashes: list[int], cut: int) -> list[int]:
    """Places of the hashes divisible by ``cut``, and where ``cut``
    consecutive hashes have none, of the least of them (the last of equal
    ones): every such stretch has a place, and whether a place is one depends
    on the ``cut - 1`` hashes before and after it at most."""
    out, best, last = [], -1, -1
    for end, h in enumerate(hashes, 1):
        if h % cut == 0:
            out.append(end - 1)
            last = end - 1
        elif end - last > cut:
            if best < end - cut:
                part = hashes[end - cut:end]
                best = end - 1 - part[::-1].index(min(part))
                out.append(best)
            elif h <= hashes[best]:
                best = end - 1
                out.append(best)
    return sorted(out)


def sentences_of(text: str, long_words: int = 20, cut: int = 8) -> list[str]:
    """Consecutive pieces of the text, which they make up whole.

    A sentence of more than ``long_words`` words is cut after every word
    whose hash is divisible by ``cut`` and in every ``cut`` consecutive words
    without one after the word with the least hash: no piece of it has more
    than ``cut`` words, and a shared passage is cut alike in every text but
    for its first and last ``cut - 1`` words.
    """
    out, at = [], 0
    for m in END.finditer(text):
        out.append(text[at:m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    spaced = is_spaced(text)
    least, word = (2 * long_words, SPACED_WORD) if spaced else (long_words, WORD)
    if not any(len(s) > least for s in out):
        return out
    pieces: list[str] = []
    for s in out:
        if len(s) <= least or len(words := word.findall(s)) <= long_words:
            pieces.append(s)
            continue
        ends = list(accumulate(map(len, words), initial=len(s) - sum(map(len, words))))  # leading white space goes with the first piece
        start = 0
        for k in anchors([xxhash.xxh64_intdigest(w.strip().lower()) for w in words], cut):
            pieces.append(s[start:ends[k + 1]])
            start = ends[k + 1]
        if start < len(s):
            pieces.append(s[start:])
    return pieces


def runs_of(texts: list[list[str]], min_sentences: int, min_words: int) -> tuple[np.ndarray, ...]:
    """(signed hash, text, first sentence, number of sentences) of the runs of
    some texts, each given as its pieces: for every sentence the shortest run
    that starts there and the shortest that ends there.

    Every run that is long enough is made up of such runs: the one from its
    first sentence, the one to its last, and for a sentence between them that
    neither covers, the ones that start or end there.
    """
    split = [[p.lower().split() if is_spaced(p) else [w.strip() for w in WORD.findall(p.lower())] for p in pieces]
             for pieces in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    n = int(size.sum())
    x = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(w)) for s in split for w in s), np.uint64, n)
    count = np.fromiter((len(w) for s in split for w in s), np.int64, n)
    of = np.repeat(np.arange(len(split)), size)
    stop = np.cumsum(size)
    start = stop - size
    words = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])  # before each sentence
    here = np.arange(n)
    j = np.maximum(np.searchsorted(words, words[:-1] + min_words), here + min_sentences)
    i = np.minimum(np.searchsorted(words, words[1:] - min_words, "right") - 1, here + 1 - min_sentences)
    from_here = (count > 0) & (j <= stop[of])  # a run starts with a word
    to_here = (count > 0) & (i >= start[of])
    to_here[to_here] &= (count[i[to_here]] > 0) & (j[i[to_here]] != here[to_here] + 1)  # and is listed once
    first = np.concatenate([here[from_here], i[to_here]])
    last = np.concatenate([j[from_here], here[to_here] + 1])
    # sum of x[k] * FACTOR ** (last - 1 - k), from sums over all sentences
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, FACTOR, np.uint64)]))
    inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * inverse[:n])])
    h = (sums[last] - sums[first]) * power[last - 1]
    return h.view(np.int64), of[first], first - start[of[first]], last - first


FILTER_BITS = 27  # a bitmap of 2 ** 27 bits, 16 MB, whatever the size of the corpus


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_x`` (tells rows with one id and different texts apart), ``_text``."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_x"), text.alias("_text")).filter("_text IS NOT NULL")


def _runs(docs: DataFrame, id_col: str, text_col: str, min_sentences: int, min_words: int) -> DataFrame:
    """(_h, _id, _x, _i, _n): runs with their documents."""
    rows = _marked(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, of, first, size = runs_of(list(map(sentences_of, part["_text"].to_pylist())), min_sentences, min_words)
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), part["_id"].take(of), part["_x"].take(of), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))],
                names=["_h", "_id", "_x", "_i", "_n"])

    return rows.mapInArrow(run, f"_h long, _id {kind}, _x long, _i int, _n int")


def _maybe_among(runs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The runs whose hash may be one of the bitmap's."""
    shared = runs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["_h"].to_numpy() & ((1 << FILTER_BITS) - 1)
            yield batch.filter(pa.array((shared.value[at >> 3] & (1 << (at & 7)).astype(np.uint8)) != 0))

    return runs.mapInArrow(run, runs.schema)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the low bits of the hashes, put together by Spark in pieces of
    4 KB: its size is fixed, and a false hit only costs a row."""
    at = F.col("_h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1  # buckets hold 1 to 32768, 32769 to 65536, ..
    pieces = (hashes.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p"))
              .groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).collect())
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for k, b in pieces:
        out[(k - 1) * 4096:k * 4096] = np.frombuffer(b, np.uint8)
    return out


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2,
                  min_words: int = 16) -> DataFrame:
    """(_id, _x, _of): for each text with repeats, the runs to remove as an
    array of (_i, _n); bounded by the sentences of the text.

    The runs are computed once and stored, about ten bytes each.  First their
    hashes alone are shuffled, to find those that occur twice; then only the
    runs that a bitmap of these hashes does not rule out; the join is exact.
    """
    runs = stored(_runs(docs, id_col, text_col, min_sentences, min_words), "sentence-runs", release_shuffles=True)
    twice = stored(runs.groupBy("_h").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").select("_h"), "sentence-hashes", release_shuffles=True)
    again = stored(_maybe_among(runs, _bitmap(twice)).join(twice, "_h"), "repeated-runs", release_shuffles=True)
    place = F.struct(F.col("_id").isNull().alias("_last"), "_id", "_x", "_i")  # a null id comes last
    first = again.groupBy("_h").agg(F.min(place).alias("_first"))
    later = again.join(first, "_h").filter(
        ~(F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_x") == F.col("_first._x")) & (F.col("_i") == F.col("_first._i"))))
    return stored(later.groupBy("_id", "_x").agg(F.collect_set(F.struct("_i", "_n")).alias("_of")), "sentence-repeats", release_shuffles=True)


def cut_runs(text: str, runs: list[dict]) -> tuple[str, int]:
    """(text without the sentences of its runs, sentences removed)."""
    pieces = sentences_of(text)
    gone = bytearray(len(pieces))
    for r in runs:
        gone[r["_i"]:r["_i"] + r["_n"]] = b"\x01" * r["_n"]
    return "".join(p for p, g in zip(pieces, gone, strict=True) if not g), sum(gone)


def drop_repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2,
                            min_words: int = 16, count_as: str | None = None) -> DataFrame:
    """The documents with all their columns and the repeats cut out of
    ``text_col``; with ``count_as`` also the number of sentences removed.

    Defined results: a null text stays null and an empty one empty; a null
    id comes after all others; rows that repeat an id and a text count as
    one document and get the same answer; an empty table gives an empty
    result; other columns are passed on, whatever their names.
    """
    names = docs.columns
    key, at = f"_c{names.index(id_col)}", names.index(text_col)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    runs = repeated_runs(docs, id_col, text_col, min_sentences, min_words)
    joined = plain.join(runs, plain[key].eqNullSafe(runs["_id"]) & (F.xxhash64(plain[f"_c{at}"]) == runs["_x"]), "left").drop("_id", "_x")
    schema = f"{', '.join(f'_c{i} {t}' for i, (_, t) in enumerate(docs.dtypes))}, _gone int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, counts = [], []
            for text, of in zip(part.column(at).to_pylist(), part["_of"].to_pylist(), strict=True):
                text, n = cut_runs(text, of) if text is not None and of else (text, 0)
                texts.append(text)
                counts.append(n)
            columns = part.columns[:len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())],
                                             names=[*[f"_c{i}" for i in range(len(names))], "_gone"])

    cut = joined.mapInArrow(run, schema)
    return cut.toDF(*names, count_as) if count_as else cut.drop("_gone").toDF(*names)
