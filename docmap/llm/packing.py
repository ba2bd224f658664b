"""Cost-balanced packing of token sequences of a fixed capacity.

A piece of n tokens costs ``linear * n + quadratic * n**2`` (attention is
quadratic in the length of a piece).  Pieces are taken by descending cost
and put in the sequence of lowest cost that still has room for them; a piece
that fits nowhere whole is cut to fill the sequence of lowest cost with any
room.  Every task packs the rows it reads, block by block with a bounded
number of tokens, and carries what does not fill a sequence into the next
block, so nothing is shuffled and only the last few tokens of a task end in
shorter sequences, whose lengths are powers of two (which need no padding).
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmap.llm.bpe import SPLIT, byte_symbols
from docmap.llm.common import slices, worker_state

Piece = tuple[int, int, int]  # document's place in the block, first token, tokens


def cost(tokens: int, linear: float, quadratic: float) -> float:
    return linear * tokens + quadratic * tokens * tokens


def assign(pieces: list[Piece], rooms: list[int], linear: float, quadratic: float,
           ) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill sequences with the given rooms; (pieces by sequence, pieces left).

    All rooms are filled exactly if the pieces hold as many tokens.  Ties go
    to the longer, then earlier piece and to the sequence that comes first.
    """
    room = np.array(rooms, dtype=np.int64)
    costs = np.zeros(len(rooms))
    filled: list[list[Piece]] = [[] for _ in rooms]
    queue = [(-n, doc, start) for doc, start, n in pieces]
    heapq.heapify(queue)
    left: list[Piece] = []
    while queue:
        n, doc, start = heapq.heappop(queue)
        n = -n
        fits = room >= n
        if not fits.any():
            fits = room > 0
            if not fits.any():
                left.append((doc, start, n))
                continue
        k = int(np.argmin(np.where(fits, costs, np.inf)))
        take = min(n, int(room[k]))
        filled[k].append((doc, start, take))
        room[k] -= take
        costs[k] += cost(take, linear, quadratic)
        if take < n:
            heapq.heappush(queue, (take - n, doc, start + take))
    return filled, left


class Packer:
    """Packs a stream of (key, ids); yields finished sequences."""

    def __init__(self, capacity: int, block_tokens: int, linear: float, quadratic: float):
        self.capacity, self.block_tokens, self.costs = capacity, block_tokens, (linear, quadratic)
        self.docs: list[tuple[object, bytes, int]] = []  # key, ids, tokens of the document before these ids
        self.totals: list[int] = []
        self.waiting = 0

    def add(self, key: object, ids: bytes) -> Iterator[list[tuple]]:
        self.docs.append((key, ids, 0))
        self.totals.append(len(ids) // 4)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block_tokens:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[list[tuple]]:
        """Sequences of the block; without ``last``, less than one sequence
        of tokens stays for the next block."""
        cap = self.capacity
        pieces: list[Piece] = []
        for i, (_, ids, _) in enumerate(self.docs):
            n, at = len(ids) // 4, 0
            while n - at >= cap:  # full sequences of one document
                yield [self.row((i, at, cap))]
                at += cap
            if n > at:
                pieces.append((i, at, n - at))
        rest = sum(p[2] for p in pieces)
        rooms = [cap] * (rest // cap)
        if last:
            rooms += [1 << b for b in reversed(range(cap.bit_length())) if (rest % cap) >> b & 1]
        filled, left = assign(pieces, rooms, *self.costs)
        for sequence in filled:
            yield [self.row(p) for p in sequence]
        docs, totals = self.docs, self.totals
        self.docs = [(docs[i][0], docs[i][1][4 * at:4 * (at + n)], docs[i][2] + at) for i, at, n in sorted(left)]
        self.totals = [totals[i] for i, _, _ in sorted(left)]
        self.waiting = sum(p[2] for p in left)

    def row(self, p: Piece) -> tuple:
        key, ids, before = self.docs[p[0]]
        return key, before + p[1], p[2], ids[4 * p[1]:4 * (p[1] + p[2])], self.totals[p[0]]


def packed(rows: DataFrame, id_col: str, load: Callable[[], Callable[[list], list[bytes]]], capacity: int,
           block_tokens: int, linear: float, quadratic: float) -> DataFrame:
    """Pack the rows (_id, _value); ``load`` gives, in a worker, the function
    from values to their ids as uint32 bytes."""
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = load()
        packer = Packer(capacity, block_tokens, linear, quadratic)
        base = TaskContext.get().partitionId() << 33
        number, out, waiting, id_type = 0, [], 0, None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        def sequences() -> Iterator[list[tuple]]:
            nonlocal id_type
            for part in slices(batches):
                id_type = part["_id"].type
                for key, ids in zip(part["_id"].to_pylist(), to_ids(part["_value"].to_pylist()), strict=True):
                    yield from packer.add(key, ids)
            yield from packer.pack(last=True)

        for sequence in sequences():
            at = 0
            for key, start, n, ids, total in sequence:
                out.append((key, start, n, ids, total, base + number, at))
                at += n
            number += 1
            waiting += at
            if waiting >= block_tokens:
                yield batch()
                out, waiting = [], 0
        if out:
            yield batch()

    schema = f"_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def pack_ids(encoded: DataFrame, capacity: int = 2048, id_col: str = "doc_id", ids_col: str = "ids",
             block_tokens: int = 1 << 18, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """Pack documents given as ids (little-endian uint32 bytes); see
    ``pack_texts``.  Null or empty ids have no piece."""
    rows = encoded.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("_value"))
    return packed(rows, id_col, lambda: list, capacity, block_tokens, linear, quadratic)


# Marks that the split pattern keeps together, none of which starts a
# contraction.
MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"


class LibraryWords:
    """White-space token or word -> ids (uint32 bytes) by the tokenizers library.

    In Latin text, tokens not seen lately are split into words, and words
    not seen lately go through the library's model (they are normalised and
    split already); any other text goes through the library whole.  ``limit`` bounds what is remembered.
    """

    def __init__(self, path: str, end: bytes, limit: int = 1_200_000):
        self.ids: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = {b: ord(c) for b, c in byte_symbols().items()}
        self.words = regex.compile(SPLIT).findall
        self.other = re.compile(r"[^\x00-ɏ]").search
        self.end, self.limit = end, limit

    def simple(self, text: str) -> bool:
        """Latin letters only, white space as in ``split``, no special strings."""
        if any(c in text for c in ("<|", "\x1c", "\x1d", "\x1e", "\x1f")):
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not self.other(text)
        return True

    def learn_words(self, words: list[str]) -> None:
        model, ids, symbols = self.model.tokenize, self.ids, self.symbols
        for w in words:
            # the model reads bytes as the characters that stand for them
            spelled = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(symbols)
            ids[w] = array("I", [t.id for t in model(spelled)]).tobytes()

    def learn(self, tokens: set[str]) -> None:
        if len(self.ids) + 2 * len(tokens) > self.limit:
            self.ids.clear()
        words = {t for t in tokens if t.isalpha()}  # these are words
        mixed = []
        for t in tokens - words:
            head = t.rstrip(MARKS)
            # letters and marks after them are two words; else the pattern tells
            parts = (head, t[len(head):]) if head.isalpha() and head != t else self.words(t)
            mixed.append((t, parts))
            words.update(parts)
        self.learn_words([w for w in words if w not in self.ids])
        known = self.ids.__getitem__
        self.ids.update([(t, b"".join(map(known, parts))) for t, parts in mixed])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [t.lower().split() if self.simple(t) else None for t in texts]
        found = [list(map(self.ids.get, tokens)) if tokens is not None else [] for tokens in split]
        missing = [[i for i, ids in enumerate(f) if ids is None] if None in f else () for f in found]
        self.learn({tokens[i] for tokens, at in zip(split, missing, strict=True) for i in at})
        out = []
        for text, tokens, ids, at in zip(texts, split, found, missing, strict=True):
            for i in at:
                ids[i] = self.ids[tokens[i]]
            if tokens is None:
                ids = [array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()]
            ids.append(self.end)
            out.append(b"".join(ids))
        return out


def pack_texts(docs: DataFrame, path: str, end_id: int | None = 1, capacity: int = 2048, id_col: str = "doc_id",
               text_col: str = "text", block_tokens: int = 1 << 18, linear: float = 1.0,
               quadratic: float = 1 / 1024) -> DataFrame:
    """Tokenise whole texts and pack them; one row per piece: ``id_col``,
    ``start`` (ids of its document before it), ``length``, ``ids`` (uint32
    bytes), ``doc_tokens``, ``sequence_id``, ``offset`` (gapless from 0).

    ``path`` names a file of the tokenizers library; ``end_id`` is appended
    to every document.  Defined results: a null or empty text is its end id
    alone; a null id is passed on; repeated rows are packed each; an empty
    table has no pieces; other columns are ignored.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_value"))
    end = b"" if end_id is None else array("I", [end_id]).tobytes()

    def load() -> Callable[[list], list[bytes]]:
        return worker_state(("words", path, end), lambda: LibraryWords(path, end)).encode_all

    return packed(rows, id_col, load, capacity, block_tokens, linear, quadratic)
