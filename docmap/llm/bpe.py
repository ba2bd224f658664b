"""Word-level BPE encoding and decoding from a public tokenizer file.

A word is encoded with a priority queue of (merge rank, position) over a
doubly linked list of its symbols; entries whose symbols were merged in the
meantime are stale and skipped.  Words repeat, so each worker keeps the ids
of recent words.  Decoding joins the vocabulary strings of the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmap.llm.common import slices, worker_state

# Fixed values of the tokenizer file's format: the split pattern and the
# printable stand-ins for bytes that are not printable.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_symbols() -> dict[int, str]:
    """Byte -> character that stands for it in the vocabulary."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordBpe(dict):
    """Maps a normalised word to its ids (little-endian uint32 bytes).

    A dict subclass, so that a repeated word costs one lookup; ``limit``
    bounds the number of words remembered.
    """

    def __init__(self, path: str, limit: int = 400_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab[symbols[b]] for b in range(256)]
        self.last = [vocab[symbols[b] + self.suffix] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.strings = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for s, i in vocab.items():
            self.strings[i] = s.encode()
        self.special = {}
        for t in spec["added_tokens"]:
            self.strings[t["id"]] = t["content"].encode()
            self.special[t["content"]] = t["id"]
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(SPLIT).findall
        self.limit = limit

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        data = word.encode()
        n = len(data)
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if n == 1:
            return ids
        merges = self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [(*merges[pair], i) for i in range(n - 1) if (pair := (ids[i], ids[i + 1])) in merges]
        heapq.heapify(queue)
        while queue:
            _, new, i = heapq.heappop(queue)
            j = after[i]
            # stale: the left or the right symbol has changed since
            if ids[i] < 0 or j >= n or (found := merges.get((ids[i], ids[j]))) is None or found[1] != new:
                continue
            ids[i] = new
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := (new, ids[k])) in merges:
                    heapq.heappush(queue, (*merges[pair], i))
            h = before[i]
            if h >= 0 and (pair := (ids[h], new)) in merges:
                heapq.heappush(queue, (*merges[pair], h))
        return [x for x in ids if x >= 0]

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.merge(word)).tobytes()
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids

    def normalised(self, text: str) -> str:
        """Composed and lower-cased letter by letter (no final-sigma rule)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32 bytes, without added
        special tokens; special strings inside the text get their ids."""
        if self.special_at is None or "<|" not in text:
            return b"".join(map(self.__getitem__, self.words(self.normalised(text))))
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += map(self.__getitem__, self.words(self.normalised(text[at:m.start()])))
            out.append(array("I", [self.special[m[0]]]).tobytes())
            at = m.end()
        out += map(self.__getitem__, self.words(self.normalised(text[at:])))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary strings of the ids, joined by one space (the file
        names no decoder), in UTF-8."""
        found = array("I")
        found.frombytes(ids)
        return b" ".join(map(self.strings.__getitem__, found))


def loaded(path: str) -> WordBpe:
    """The tokenizer of a file, kept by the Python worker."""
    return worker_state(("bpe", path), lambda: WordBpe(path))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
               as_binary: bool = False) -> DataFrame:
    """``id_col``, ``ids``: the token ids of every whole text, as an array,
    or with ``as_binary`` as little-endian unsigned 32-bit bytes.

    Defined results: a null or empty text has no ids; a null id is passed
    on; repeated rows are encoded each; other columns are ignored.
    """
    rows = _texts(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part in slices(batches):
            ids = [bpe.encode(t) for t in part["_text"].to_pylist()]
            column = pa.array(ids, pa.binary()) if as_binary else pa.array(
                [array("I", x).tolist() for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part["_id"], column], names=["_id", "ids"])

    out = rows.mapInArrow(run, f"_id {kind}, ids {'binary' if as_binary else 'array<int>'}")
    return out.withColumnRenamed("_id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``decoded``: the text of each array of ids (null: empty)."""
    rows = encoded.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part in slices(batches):
            texts = [bpe.decode(array("I", x).tobytes()).decode() for x in part["_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["_id"], pa.array(texts, pa.string())], names=["_id", "decoded"])

    return rows.mapInArrow(run, f"_id {kind}, decoded string").withColumnRenamed("_id", id_col)


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every
    whole text: encode and decode in one pass, without moving the ids."""
    rows = _texts(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part in slices(batches):
            counts, ids_sha, text_sha = [], [], []
            for text in part["_text"].to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part["_id"], pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)
