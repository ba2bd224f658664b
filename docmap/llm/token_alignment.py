"""Alignment of two tokenizers over the same text, with corpus-wide counts.

Two vocabularies cut the bytes of a text at different places.  Where tokens
of both end at the same byte the text is cut into groups; a token of one side
is linked to every token of the other side in its group.  Inside a task the
work is columnar: token lists are flattened with their parent indices, token
lengths become end offsets by a cumulative sum per document, an Acero hash
join on (document, end) finds the common ends, a second one on the group makes
the links, and ``Table.group_by`` counts them per document and per block of
documents.  Spark adds up the blocks' partial counts, joins them back to the
pairs of each block, and brings a block's counts to its documents.

What is shuffled: one row per distinct id pair of a block (not of a document),
and the documents' pair lists once, by block.  A block holds a bounded number
of text bytes (or one longer document), so no group grows with the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmap.llm.bpe import byte_symbols
from docmap.llm.common import slices, stored, worker_state

# Fixed value: the split pattern of byte-level BPE files of this kind.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A single space between two other characters: no token of either side crosses
# it (``Pair`` makes sure), so the texts between such places encode by themselves.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Ids(dict):
    """Text between two such spaces -> its ids as uint32 bytes.  Between two
    calls it remembers a bounded number of short ones."""

    def __init__(self, encode, limit: int = 300_000):
        super().__init__()
        self.encode, self.limit = encode, limit  # encode: list of texts -> list of id lists

    def lists(self, texts: list[str]) -> pa.ListArray:
        """The ids of each of some distinct texts."""
        new = [t for t in texts if t not in self]
        found = self.encode(new)
        ends = [0, *accumulate(map(len, found))]
        data = np.fromiter(chain.from_iterable(found), np.uint32, ends[-1]).tobytes()
        self.update(zip(new, [data[4 * x:4 * y] for x, y in zip(ends, ends[1:])]))
        known = [self[t] for t in texts]
        if len(self) > self.limit:
            self.clear()
        else:
            for t in new:
                if len(t) > 48:
                    del self[t]
        ids = np.frombuffer(b"".join(known), np.int32)
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(len(x) // 4 for x in known)], pa.int32()), pa.array(ids))


class Pair:
    """Both tokenizers, the bytes of each token, and each token as text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        value = {s: b for b, s in byte_symbols().items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["id"] for t in spec["added_tokens"]}
        plain = {bytes(value[c] for c in s): i for s, i in vocab.items() if i not in special}
        self.size_a = max([*vocab.values(), *special]) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if [vocab[x + y] for x, y in merges] == list(range(256, 256 + len(merges))):
            import tiktoken  # ids are merge ranks: same result, several times faster
            own = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=plain, special_tokens={})
            encode_a = lambda texts: [own.encode_ordinary(" " + s) for s in texts]
        else:
            from tokenizers import Tokenizer
            slow = Tokenizer.from_file(path_a)
            slow.encode_special_tokens = True
            encode_a = lambda texts: [slow.encode(" " + s, add_special_tokens=False).ids for s in texts]
        pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = pieces.vocab_size()
        names = [pieces.id_to_piece(i) for i in range(self.size_b)]
        bytes_a = [b""] * self.size_a
        for b, i in plain.items():
            bytes_a[i] = b
        bytes_b = [bytes([int(m[1], 16)]) if pieces.is_byte(i) and (m := BYTE_PIECE.fullmatch(s)) else
                   s.replace("▁", " ").encode() for i, s in enumerate(names)]
        if any("▁" in s[1:] and s.strip("▁") for s in names):
            raise ValueError(f"{path_b}: a piece has a space after another character; texts cannot be cut at spaces")
        self.a, self.b = Ids(encode_a), Ids(lambda texts: pieces.encode(texts, num_threads=1))
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (bytes_a, bytes_b))
        # ids as text with the mark that follows them: inside a side, after A's part, after the group
        every = [*range(self.size_a), *range(self.size_b)]
        self.text = pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in every], pa.large_binary())


def _joined(table: pa.Array, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of a binary table one after the other, and their ends."""
    taken = table.take(pa.array(at))
    if not len(taken):
        return memoryview(b""), np.zeros(1, np.int64)
    _, offsets, data = taken.buffers()
    return memoryview(data or b""), np.frombuffer(offsets, np.int64)[:len(taken) + 1]


def _ends(tokens: pa.ListArray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, parent row and end offset within the row of every list element."""
    ids = pc.list_flatten(tokens)
    parent = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
    total = pc.cumulative_sum(pa.array(length[ids])).to_numpy(zero_copy_only=False)
    first = tokens.offsets.to_numpy()[:-1]
    before = np.concatenate([[0], total])[first]
    return ids.to_numpy(), parent, total - before[parent]


def _encoded(pair: Pair, parts: list[list[str]]) -> tuple[pa.ListArray, pa.ListArray]:
    """The ids of both sides for each list of chunks: every distinct chunk is
    encoded once, and its ids are taken where it stands."""
    ends = np.array([0, *accumulate(map(len, parts))])
    coded = pa.array(chain.from_iterable(parts), pa.string()).dictionary_encode()
    texts = coded.dictionary.to_pylist()
    out = []
    for side in (pair.a, pair.b):
        taken = side.lists(texts).take(coded.indices)
        out.append(pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[ends], pa.int32()), taken.flatten()))
    return out[0], out[1]


def _same_bytes(table: pa.Array, tokens: pa.ListArray, wanted: list[bytes]) -> np.ndarray:
    """Whether the tokens of each list spell its text."""
    data, ends = _joined(table, pc.list_flatten(tokens).to_numpy())
    at = ends[tokens.offsets.to_numpy()]
    return np.fromiter((bytes(data[x:y]) == w for x, y, w in zip(at, at[1:], wanted)), bool, len(wanted))


def align(pair: Pair, parts: list[list[str]]) -> tuple[pa.Table, list[tuple | None]]:
    """Links of some texts, each given as the pieces between ``BETWEEN``.

    Returns (row, pair, links) with pair = A id * size of B + B id, and for
    each row its (n_a, n_b, n_groups, n_links, groups as bytes ending in
    ``;``), or None where the tokens of a side do not spell space + text.
    """
    a, b = _encoded(pair, parts)
    wanted = [f" {' '.join(p)}".encode() for p in parts]
    good = _same_bytes(pair.bytes_a, a, wanted) & _same_bytes(pair.bytes_b, b, wanted)
    if not good.all():
        keep = np.flatnonzero(good)
        table, found = align(pair, [parts[i] for i in keep]) if len(keep) else (_pairs([], [], []), [])
        table = table.set_column(0, "row", pa.array(keep[table["row"].to_numpy()] if len(keep) else [], pa.int64()))
        rest = iter(found)
        return table, [next(rest) if ok else None for ok in good]

    ids_a, row_a, end_a = _ends(a, pair.length_a)
    ids_b, row_b, end_b = _ends(b, pair.length_b)
    common = pa.table({"row": row_a, "end": end_a, "ia": np.arange(len(ids_a))}).join(
        pa.table({"row": row_b, "end": end_b, "ib": np.arange(len(ids_b))}), ["row", "end"], join_type="inner", use_threads=False)
    last_a, last_b = (np.sort(common[c].to_numpy()) for c in ("ia", "ib"))  # last tokens of the groups, in text order
    closes_a, closes_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    closes_a[last_a] = 1
    closes_b[last_b] = 1
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b

    # equal ids inside a group are counted before the join, so that a long
    # group of few ids makes few rows
    count = [("id", "count")]
    left = pa.table({"group": group_a, "id": ids_a}).group_by(["group", "id"], use_threads=False).aggregate(count)
    right = pa.table({"group": group_b, "id": ids_b}).group_by(["group", "id"], use_threads=False).aggregate(count)
    links = left.rename_columns({"id": "a", "id_count": "n"}).join(
        right.rename_columns({"id": "b", "id_count": "m"}), "group", join_type="inner", use_threads=False)
    row_of = row_a[last_a]
    n = links["n"].to_numpy() * links["m"].to_numpy()
    row = row_of[links["group"].to_numpy()]
    table = _pairs(row, links["a"].to_numpy().astype(np.int64) * pair.size_b + links["b"].to_numpy(), n)

    # the groups as text: A tokens of a group, then its B tokens
    side = pair.size_a + pair.size_b
    at = np.empty(len(ids_a) + len(ids_b), np.int64)
    at[np.arange(len(ids_a)) + np.concatenate([[0], last_b + 1])[group_a]] = ids_a + closes_a * side
    at[np.arange(len(ids_b)) + last_a[group_b] + 1] = ids_b + pair.size_a + closes_b * 2 * side
    data, ends = _joined(pair.text, at)
    off_a, off_b = a.offsets.to_numpy(), b.offsets.to_numpy()
    text_at = ends[off_a + off_b]
    rows = len(parts)
    n_groups = np.bincount(row_of, minlength=rows)
    n_links = np.zeros(rows, np.int64)
    np.add.at(n_links, row, n)
    return table, [(int(off_a[i + 1] - off_a[i]), int(off_b[i + 1] - off_b[i]), int(n_groups[i]), int(n_links[i]),
                    data[text_at[i]:text_at[i + 1]]) for i in range(rows)]


def _packed(numbers: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Consecutive pieces of some numbers from 0, each as one byte with the
    width and the numbers in the least width that holds all of them."""
    top = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    data, mark = numbers.astype(f"<u{width}").tobytes(), bytes([width])
    return [mark + data[x * width:y * width] for x, y in zip(ends.tolist(), ends[1:].tolist())]


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _pairs(row, pair, links) -> pa.Table:
    """(row, pair, links), one row for each pair of a row."""
    t = pa.table({"row": pa.array(row, pa.int64()), "pair": pa.array(pair, pa.int64()), "links": pa.array(links, pa.int64())})
    t = t.group_by(["row", "pair"], use_threads=False).aggregate([("links", "sum")])
    return t.select(["row", "pair", "links_sum"]).rename_columns(["row", "pair", "links"])


class Block:
    """Documents of one block: what is known of each, and their pairs."""

    def __init__(self, pair: Pair, run_bytes: int):
        self.pair, self.run_bytes = pair, run_bytes
        self.ids: list = []
        self.sums: list[list] = []   # n_a, n_b, n_groups, n_links
        self.hashes: list = []
        self.bad: set[int] = set()
        self.tables: list[pa.Table] = []
        self.waiting: list[tuple[int, list[str]]] = []
        self.held = self.taken = 0   # text waiting, text taken in

    def add(self, doc_id, text: str | None) -> None:
        self.ids.append(doc_id)
        self.sums.append([0, 0, 0, 0])
        self.hashes.append(None)
        if not text:
            return
        doc, part, size = len(self.ids) - 1, [], 0
        chunks = BETWEEN.split(text)
        if len(text) < self.run_bytes:
            self._wait(doc, chunks, len(text))
            return
        for chunk in chunks:  # a long text goes through ``align`` in several parts
            part.append(chunk)
            size += len(chunk) + 1
            if size >= self.run_bytes:
                self._wait(doc, part, size)
                part, size = [], 0
        if part:
            self._wait(doc, part, size)

    def _wait(self, doc: int, part: list[str], size: int) -> None:
        self.waiting.append((doc, part))
        self.held += size
        self.taken += size
        if self.held >= self.run_bytes:
            self.run()

    def run(self) -> None:
        if not self.waiting:
            return
        docs = np.array([d for d, _ in self.waiting])
        table, found = align(self.pair, [p for _, p in self.waiting])
        for doc, row in zip(docs.tolist(), found):
            if row is None:
                self.bad.add(doc)
                continue
            self.sums[doc] = [x + y for x, y in zip(self.sums[doc], row)]
            if self.hashes[doc] is None:
                self.hashes[doc] = hashlib.sha256(row[4][:-1])
            else:
                self.hashes[doc].update(b";")
                self.hashes[doc].update(row[4][:-1])
        self.tables.append(table.set_column(0, "row", pa.array(docs[table["row"].to_numpy()], pa.int64())))
        self.waiting, self.held = [], 0

    def rows(self, block: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """One row per document and one per distinct pair of the block."""
        self.run()
        table = pa.concat_tables(self.tables) if self.tables else _pairs([], [], [])
        row, pairs, links = (table[c].to_numpy() for c in ("row", "pair", "links"))
        if self.bad:
            ok = ~np.isin(row, list(self.bad))
            row, pairs, links = row[ok], pairs[ok], links[ok]
        if len(self.tables) > 1:  # parts of one long document may share pairs
            row, pairs, links = (_pairs(row, pairs, links)[c].to_numpy() for c in ("row", "pair", "links"))
        coded = pa.array(pairs).dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        order = np.lexsort((at, row))
        ends = np.searchsorted(row[order], np.arange(len(self.ids) + 1))
        at, links = at[order], links[order]
        zero = [0, 0, 0, 0]
        sums = np.array([zero if i in self.bad else s for i, s in enumerate(self.sums)], np.int64).reshape(-1, 4)
        n = len(self.ids)
        yield _batch({
            "_block": pa.array(np.full(n, block)), "_id": pa.array(self.ids, id_type),
            **{c: pa.array(sums[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "groups_sha256": pa.array(["" if h is None or i in self.bad else h.hexdigest() for i, h in enumerate(self.hashes)]),
            "_pairs": pa.array(_packed(at, ends), pa.binary()), "_links": pa.array(_packed(links, ends), pa.binary())}, n, id_type)
        held = pa.array(np.bincount(at, minlength=len(distinct)).astype(np.int64))
        for start in range(0, len(distinct), 20_000):
            part = distinct[start:start + 20_000]
            yield _batch({"_block": pa.array(np.full(len(part), block)), "_at": pa.array(np.arange(start, start + len(part), dtype=np.int32)),
                          "_a": pa.array((part // self.pair.size_b).astype(np.int32)), "_b": pa.array((part % self.pair.size_b).astype(np.int32)),
                          "_held": held.slice(start, len(part))}, len(part), id_type)


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("_block", pa.int64()), ("_id", id_type), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                      ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("_pairs", pa.binary()), ("_links", pa.binary()),
                      ("_at", pa.int32()), ("_a", pa.int32()), ("_b", pa.int32()), ("_held", pa.int64())])


def _batch(columns: dict, n: int, id_type: pa.DataType) -> pa.RecordBatch:
    schema = _schema(id_type)
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = 2_000_000) -> DataFrame:
    """Documents and distinct pairs of every block, as stored rows: a document
    has ``_pairs`` (places in its block's pairs) and ``_links`` (how often), a
    pair has ``_at``, ``_a``, ``_b`` and ``_held`` (documents of the block)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = worker_state(("pair", path_a, path_b), lambda: Pair(path_a, path_b))
        number, block, id_type = TaskContext.get().partitionId() << 32, None, None
        for part in slices(batches):
            id_type = part["_id"].type
            for doc_id, text in zip(part["_id"].to_pylist(), part["_text"].to_pylist()):
                block = block or Block(pair, block_bytes)
                block.add(doc_id, text)
                if block.taken >= block_bytes or len(block.ids) >= 20_000:
                    yield from block.rows(number, id_type)
                    number, block = number + 1, None
        if block:
            yield from block.rows(number, id_type)

    return stored(rows.mapInArrow(run, f"_block long, _id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                       "_pairs binary, _links binary, _at int, _a int, _b int, _held long"), "alignment")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a``, ``b``, ``documents`` and ``best`` (no other pair of this A id is
    held by more documents) of every linked id pair of the corpus."""
    counts = (blocks.filter("_at IS NOT NULL").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b"))
              .agg(F.sum("_held").alias("documents")))
    most = counts.groupBy(F.col("a").alias("_of")).agg(F.max("documents").alias("_most"))
    # at most one row for each id of A's vocabulary
    return counts.join(F.broadcast(most), F.col("a") == F.col("_of")).select(
        "a", "b", "documents", (F.col("documents") == F.col("_most")).alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = 2_000_000) -> DataFrame:
    """``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256`` of every whole text.

    ``path_a`` is a byte-level BPE file, ``path_b`` a sentence-piece model with
    byte fallback that puts a space before the text.  Special tokens' strings
    are plain text.  A pair's count is the number of documents (rows) that hold
    it linked at least once; ``n_best`` counts the links whose count is the
    highest of their A id, ``count_sum`` adds the counts up over all links.

    Defined results: a null or empty text, and one whose tokens of either side
    do not spell space + text, has zeros and the empty string; a null or
    repeated id is passed on, each row counts as a document of its own; an
    empty table gives an empty result; other columns are ignored.
    """
    blocks = aligned_blocks(docs, path_a, path_b, id_col, text_col, block_bytes)
    schema = T.StructType([T.StructField("_id", blocks.schema["_id"].dataType)] + [
        T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [
        T.StructField("groups_sha256", T.StringType())])
    counts = pair_counts(blocks)
    known = (blocks.filter("_at IS NOT NULL").select(F.col("_block").alias("_of"), "_at", "_a", "_b")
             .join(counts, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b"))).select("_of", "_at", "documents", "best"))
    held = blocks.filter("_at IS NULL").select("_block", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_pairs", "_links")

    def score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs["_at"].to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place] = pairs["documents"].to_numpy()
        best[place] = pairs["best"].to_numpy()
        n_best, total = [], []
        for at, n in zip(docs["_pairs"].to_pylist(), docs["_links"].to_pylist()):
            at, n = _unpacked(at), _unpacked(n)
            n_best.append(int(n[best[at]].sum()))
            total.append(int(n @ count[at]))
        return pa.table([docs["_id"], docs["n_a"], docs["n_b"], docs["n_groups"], docs["n_links"], pa.array(n_best, pa.int64()),
                         pa.array(total, pa.int64()), docs["groups_sha256"]], names=schema.names)

    out = held.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(score, schema)
    return out.withColumnRenamed("_id", id_col)
