"""Exact n-gram Jaccard join by grouped prefixes.

A document is the set of its distinct shingles (64-bit hashes of runs of
words).  Under one order of all shingles, rare ones first, two sets whose
Jaccard similarity reaches the threshold share a shingle among their first
``n - ceil(t * n) + 1``.  The join works on ever fewer rows:

* documents with the same set form one class;
* classes with the same prefix and size form one group, and only groups are
  listed under the shingles of their prefix; a shingle of one group alone
  makes no list;
* the first shingle that two linked sets share stands at places i and j of
  their prefixes, so they share at most ``n - i`` and ``m - j``: an entry of
  a list has a ``cap`` for the other set's size, and an entry whose cap is
  below the smallest size of the list is dropped;
* in each list a few pivots are paired with the other classes of the list;
  pairs that the sizes, the caps or too few shared prefix shingles rule out
  go, and every pair left is verified on whole sets;
* after a round, lists whose classes are all connected are done; pivots, which
  have met every other class, leave their list.  In the others the next round takes more pivots (eight times as many each round), but pairs only
  classes that are not connected yet.

So every pair of linked texts is connected in the result, but a list of n
near copies costs about n pairs instead of n * n.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmap.llm.common import slices, stored, worker_state
from docmap.llm.components import components

MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values of a public 64-bit finaliser
STEP = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; ``limit`` bounds the words remembered."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = h
        return h


def shingle_set(text: str, k: int, word_hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; A-Z are lower-cased
    and words are split at ASCII white space.  Fewer words are one run."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - min(k, len(h)) + 1
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = out * np.uint64(STEP) + h[i:i + n]
    out ^= out >> np.uint64(30)
    out *= np.uint64(MIX[0])
    out ^= out >> np.uint64(27)
    out *= np.uint64(MIX[1])
    out ^= out >> np.uint64(31)
    return np.unique(out)


def needed(n: int, percent: int) -> int:
    """ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def is_frequent(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(s), bool)
    return frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s


def prefix_of(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of the set, rare ones first, each kind by hash."""
    if not len(s):
        return s
    take = len(s) - needed(len(s), percent) + 1
    common = is_frequent(s, frequent)
    return np.concatenate([s[~common], s[common]])[:take]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_x`` (tells rows with one id, or none, and different texts
    apart), ``_text``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_x"), text.alias("_text"))


def _least() -> Column:
    """The first row by id (without an id: last), then by the text's digest."""
    return F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_x").alias("x")))


def frequent_shingles(texts: DataFrame, k: int, at_least: int = 8, at_most: int = 1_000_000,
                      chunk: int = 2_000_000) -> np.ndarray:
    """Shingles that many documents share, sorted; they only decide the
    order, so any list gives the same links.

    Every task counts its shingles in chunks and passes on those that occur
    in two or more of its documents; a shingle is frequent when these counts
    add up to ``at_least`` or, where that is more, to the sum of all counts
    divided by ``at_most``: so the list never has more than ``at_most``.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = worker_state(("shingles",), WordHashes), [], 0

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            twice = n > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(values[twice].view(np.int64)), pa.array(n[twice].astype(np.int64))], names=["token", "n"])

        for part in slices(batches):
            for text in part["_text"].to_pylist():
                held.append(shingle_set(text, k, hashes))
                size += len(held[-1])
                if size >= chunk:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = stored(texts.select("_text").mapInArrow(count, "token long, n long")
                    .groupBy("token").agg(F.sum("n").alias("n")), "shingle-counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = counts.filter(F.col("n") >= max(at_least, -(-total // at_most))).select("token").toArrow()["token"]
    return np.sort(found.to_numpy().view(np.uint64)) if len(found) else np.zeros(0, np.uint64)


def _digest(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data, seed=1) - (1 << 63)


def keyed_documents(texts: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(_id, _x, n, cls, grp, prefix) of every document: size and digest of its
    set, digest of prefix and size, and the prefix in the shingles' order.
    Without words the digests are null."""
    kind = texts.schema["_id"].dataType.simpleString()
    sent = texts.sparkSession.sparkContext.broadcast(frequent)  # at most a million hashes, see there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state(("shingles",), WordHashes)
        for part in slices(batches):
            n, cls, grp, prefixes = [], [], [], []
            for text in part["_text"].to_pylist():
                s = shingle_set(text, k, hashes)
                p = prefix_of(s, sent.value, percent)
                n.append(len(s))
                cls.append(_digest(s.tobytes()) if len(s) else None)
                grp.append(_digest(p.tobytes() + len(s).to_bytes(8, "little")) if len(s) else None)
                prefixes.append(p.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part["_id"], part["_x"], pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(grp, pa.int64()),
                 pa.array(prefixes, pa.list_(pa.int64()))], names=["_id", "_x", "n", "cls", "grp", "prefix"])

    return texts.mapInArrow(run, f"_id {kind}, _x long, n long, cls long, grp long, prefix array<long>")


def sets_of(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, s): the set of each class in ``wanted`` (_id, _x, cls), as bytes;
    a class has a row for each copy of the one row that stands for it."""
    want = wanted.toDF("_wid", "_wx", "cls")
    rows = texts.join(want, texts["_id"].eqNullSafe(F.col("_wid")) & (texts["_x"] == F.col("_wx"))).select("cls", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state(("shingles",), WordHashes)
        for part in slices(batches):
            keep, sets = [], []
            for cls, text in zip(part["cls"].to_pylist(), part["_text"].to_pylist(), strict=True):
                s = shingle_set(text, k, hashes).tobytes()
                if s and _digest(s) == cls:  # else another text with the same id and digest
                    keep.append(cls)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "s"])

    return rows.mapInArrow(run, "cls long, s binary")


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The class pairs (a, b) whose sets reach the threshold."""
    rows = (pairs.join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
            .join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            good = [similar(x, y, percent) for x, y in zip(part["sa"].to_pylist(), part["sb"].to_pylist(), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def alike_prefixes(pairs: DataFrame, keyed: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough: the set whose prefix
    ends first shares nothing of it but what is in the other prefix, so both
    share at most that and the longer of the two rests."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "pair-ends")
    if ends.count() <= broadcast_rows:
        ends = F.broadcast(ends)
    prefixes = stored(keyed.join(ends, "cls", "left_semi").select("cls", "n", "prefix").dropDuplicates(["cls"]), "pair-prefixes")
    a, b = (prefixes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("p_a", "p_b")) + F.greatest(F.col("n_a") - F.size("p_a"), F.col("n_b") - F.size("p_b"))
    return (pairs.join(a, "a").join(b, "b").filter(shared * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
            .select("a", "b"))


def cap_of(n: Column, place: Column, percent: int) -> Column:
    """Largest size of a set that may be linked with one of ``n`` shingles if
    the first shared one stands at ``place`` (from 0) of its prefix."""
    return (F.floor((n - place) * (100 + percent) / percent) - n).cast("int")


@dataclass
class Classes:
    """Results of the join: ``documents`` (_id, _x, n, cls), ``links`` (a, b):
    verified class pairs, ``labels`` (cls, comp)."""
    documents: DataFrame
    links: DataFrame | None
    labels: DataFrame | None


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85,
                 first_pivots: int = 4, broadcast_rows: int = 300_000) -> Classes:
    """Classes of equal sets and links between them that connect every two
    classes whose similarity reaches ``percent``."""
    texts = _texts(docs, id_col, text_col)
    keyed = stored(keyed_documents(texts, k, percent, frequent_shingles(texts, k)), "shingle-keys")
    documents = keyed.select("_id", "_x", "n", "cls")
    # one row for each class, with its first row by id and text
    classes = keyed.filter("cls IS NOT NULL").groupBy("cls").agg(
        _least().alias("f"), F.first("n").cast("int").alias("n"), F.first("grp").alias("grp")).select(
        "cls", F.col("f.id").alias("_id"), F.col("f.x").alias("_x"), "n", "grp")
    # groups are listed under the shingles of their prefix; a group of several
    # classes also has a list of its own, named by its digest
    listed = keyed.select(F.col("n").cast("int").alias("n"), "grp", F.posexplode("prefix").alias("place", "token")).select(
        "token", "grp", "n", cap_of(F.col("n"), F.col("place"), percent).alias("cap"))
    useful = (listed.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.min("n").alias("low"),
                                          F.max("cap").alias("high"))
              .filter("lo != hi AND high >= low").select("token", "low"))
    several = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n")).filter("times > 1")
    lists = stored(listed.join(useful, "token").filter("cap >= low").select("token", "grp", "cap").distinct()
                   .unionByName(several.select(F.col("grp").alias("token"), "grp", cap_of(F.col("n"), F.lit(0), percent).alias("cap"))),
                   "prefix-lists")
    active = stored(classes.join(lists.select("grp").distinct(), "grp", "left_semi"), "classes")
    # the classes of each list
    entries = lists.join(active.select("grp", "cls", "n"), "grp").select("token", "cls", "n", "cap")
    met, links, labels, sets, k_pivots = None, None, None, None, first_pivots
    while True:
        rows = entries.withColumn("comp", F.col("cls")) if labels is None else (
            entries.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
        # lists with classes that are not connected; the component with most
        # classes of a list is its main one
        open_lists = (rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("low"),
                                                        F.max("cap").alias("high"))
                      .groupBy("token").agg(F.max(F.struct("times", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"),
                                            F.min("low").alias("low"), F.max("high").alias("high"))
                      .filter("comps > 1 AND high >= low").select("token", F.col("most.comp").alias("main")))
        rows = stored(rows.join(open_lists, "token"), "open-lists")
        if rows.isEmpty():
            break
        # pivots: of each of k hash slots of a list, the class outside it with
        # the largest cap for its size (the one with least of its own)
        slot = F.pmod(F.xxhash64("cls", F.lit(k_pivots)), F.lit(k_pivots)).alias("slot")
        pivots = stored(rows.filter("comp != main").groupBy("token", slot)
                        .agg(F.min(F.struct((-F.col("cap") / F.col("n")).alias("order"), "cls", "n", "cap", "comp")).alias("p"))
                        .select("token", "p.*"), "pivots")
        p = pivots.select("token", F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("cap").alias("p_cap"), F.col("comp").alias("pc"))
        pairs = (rows.join(p, "token").filter(
            (F.col("comp") != F.col("pc")) & (F.col("n") <= F.col("p_cap")) & (F.col("pn") <= F.col("cap"))
            & (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent))
            .select(F.least("cls", "p").alias("a"), F.greatest("cls", "p").alias("b")).distinct())
        if met is not None:
            pairs = pairs.join(met, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        met = pairs if met is None else stored(met.unionByName(pairs), "met")
        pairs = stored(alike_prefixes(pairs, keyed, percent, broadcast_rows), "close-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        if sets is not None:
            ends = ends.join(sets.select("cls"), "cls", "left_anti")
        wanted = stored(active.join(ends, "cls", "left_semi").select("_id", "_x", "cls"), "wanted")
        n_wanted = wanted.count()
        if n_wanted:
            more = stored(sets_of(texts, F.broadcast(wanted) if n_wanted <= broadcast_rows else wanted, k), "shingle-sets")
            if more.count() > n_wanted:  # a row that stands for its class has copies
                more = stored(more.dropDuplicates(["cls"]), "shingle-sets")
            sets = more if sets is None else sets.unionByName(more)
        if sets is not None:
            new = stored(verified(pairs, sets, percent), "links")
            links = new if links is None else links.unionByName(new)
            if not new.isEmpty():
                labels = merge_labels(labels, new)
        entries = stored(rows.select("token", "cls", "n", "cap")
                         .join(pivots.select("token", "cls"), ["token", "cls"], "left_anti"), "entries")
        k_pivots *= 8
    return Classes(documents, links, labels)


def merge_labels(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """Labels after adding links: components of the old components."""
    if labels is None:
        return components(new).select(F.col("node").alias("cls"), "comp")
    of = labels.withColumnRenamed("comp", "c")
    ends = (new.join(of.withColumnRenamed("cls", "a"), "a", "left").withColumn("a", F.coalesce("c", "a")).drop("c")
            .join(of.withColumnRenamed("cls", "b"), "b", "left").withColumn("b", F.coalesce("c", "b")).drop("c"))
    joined = components(ends).withColumnRenamed("comp", "new")
    nodes = labels.unionByName(new.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
                               .join(labels, "cls", "left_anti").withColumn("comp", F.col("cls")))
    return stored(nodes.join(joined, nodes["comp"] == joined["node"], "left")
                  .select("cls", F.coalesce("new", "comp").alias("comp")), "labels")


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(_id, _x, n, comp, first): every row with the component of its class
    and the first row of it by id and text (both null without words)."""
    found = join_classes(docs, id_col, text_col, k, percent)
    rows = found.documents
    with_comp = rows.withColumn("comp", F.col("cls")) if found.labels is None else (
        rows.join(found.labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    least = stored(with_comp.filter("comp IS NOT NULL").groupBy("comp").agg(_least().alias("first")), "least-ids")
    return with_comp.join(least, "comp", "left").select("_id", "_x", "n", "comp", "first")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                          percent: int = 85) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles``, ``component_id``,
    the least id that links reach (the document's own included).

    Defined results: a null text counts as empty; a document without words
    has 0 shingles and is linked with nothing, so its component is its own
    id; a document with a null id takes part, but null is no least id unless
    the component has no other; rows that repeat an id and a text are linked
    with each other; an empty table gives an empty result; other columns are
    ignored.  Two sets count as the same when their 64-bit digests agree.
    """
    return _components(docs, id_col, text_col, k, percent).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("_id")).otherwise(F.col("first.id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                     percent: int = 85) -> DataFrame:
    """Of each component the first row by id (a null id last), then by a digest
    of the text; with all columns, whatever their names.

    Defined results: rows that repeat the id and the text that stay all stay;
    of rows with one id and different texts each is judged by its own text; a
    row without words (a null text too) stays; an empty table gives an empty
    result.
    """
    gone = (_components(docs, id_col, text_col, k, percent).filter("comp IS NOT NULL")
            .filter(~(F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("_x") == F.col("first.x"))))
            .select(F.col("_id").alias("_gone_id"), F.col("_x").alias("_gone_x")).distinct())
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    text = F.coalesce(plain[f"_c{names.index(text_col)}"], F.lit(""))
    same = plain[f"_c{names.index(id_col)}"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(text) == gone["_gone_x"])
    return plain.join(gone, same, "left_anti").toDF(*names)
