"""Language identification with labelled spans of mixed-language text.

The model holds, per language, how often hashed character n-grams of its
words occur (a table of fixed size) and how its words are spread over
scripts.  The script of a word narrows the candidate languages; every
candidate gets a log-probability for the word; Viterbi over the words with a
penalty for switching labels the text with spans.

The Viterbi path is one language throughout whenever no stretch of words
favours another language by more than half the penalty; that is tested with
array operations, and only the other texts run the word-by-word recursion.
Both give the same labels.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmap.llm.common import gram_buckets, least_hashed, slices, worker_state

# Unicode ranges of scripts (first letter of a word decides).
SCRIPTS = (
    ("latin", ((0x0041, 0x024F), (0x1E00, 0x1EFF))),
    ("greek", ((0x0370, 0x03FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x0400, 0x052F),)),
    ("armenian", ((0x0530, 0x058F),)),
    ("hebrew", ((0x0590, 0x05FF),)),
    ("arabic", ((0x0600, 0x077F), (0x08A0, 0x08FF))),
    ("devanagari", ((0x0900, 0x097F),)),
    ("bengali", ((0x0980, 0x09FF),)),
    ("tamil", ((0x0B80, 0x0BFF),)),
    ("thai", ((0x0E00, 0x0E7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF))),
)
OTHER_SCRIPT = len(SCRIPTS)
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def script_of(word: str) -> int:
    c = ord(word[0])
    for i, (_, ranges) in enumerate(SCRIPTS):
        for low, high in ranges:
            if low <= c <= high:
                return i
    return OTHER_SCRIPT


@dataclass
class Model:
    """``scores``: languages x buckets log-probabilities; ``scripts``:
    languages x scripts, True where the language uses the script."""
    langs: list[str]
    scores: np.ndarray
    scripts: np.ndarray
    switch: float = 12.0
    other_script: float = 20.0


def sample_labelled(docs: DataFrame, id_col: str, lang_col: str, per_lang: int, at_most: int) -> DataFrame:
    """Ids of at most ``per_lang`` documents of each language and
    ``at_most`` in all: those with the least hashes of their ids."""
    keys = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    return least_hashed(keys.distinct(), "_lang", "_id", per_lang).orderBy("_rank", "_lang").limit(at_most).select("_id", "_lang")


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       per_lang: int = 1000, at_most: int = 20_000, buckets: int = 1 << 16) -> Model:
    """Count n-grams of a bounded sample of labelled documents (whole texts,
    bounds as in ``sample_labelled``).  The driver gets one count per
    language and bucket: at most ``buckets`` rows for each language.
    Rows with null text, language or id teach nothing."""
    chosen = F.broadcast(sample_labelled(docs, id_col, lang_col, per_lang, at_most))
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text IS NOT NULL")
            .join(chosen, "_id").select("_lang", "_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(part["_lang"].to_pylist(), part["_text"].to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
            for lang, of in words.items():
                if not of:
                    continue
                times = np.fromiter(of.values(), np.float64, len(of))
                bucket, word = gram_buckets(list(of), buckets)
                grams = np.bincount(bucket, weights=times[word], minlength=buckets + OTHER_SCRIPT + 1)
                for w, n in of.items():
                    grams[buckets + script_of(w)] += n
                at = np.flatnonzero(grams)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(grams[at].astype(np.int64))],
                    names=["lang", "bucket", "n"])

    found = (rows.mapInArrow(count, "lang string, bucket long, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(found["lang"].to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    table = np.zeros((len(langs), buckets + OTHER_SCRIPT + 1))
    if langs:
        table[[place[x] for x in found["lang"].to_pylist()], found["bucket"].to_numpy()] = found["n"].to_numpy()
    counts, scripts = table[:, :buckets] + 0.1, table[:, buckets:]
    scores = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(langs, scores, scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1))


class WordScores:
    """Scores of words for every language, kept for the words seen lately
    (at most ``limit``); ``table`` holds one row for each of them."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.model, self.limit = model, limit
        self.rows: dict[str, int] = {}
        self.table = np.zeros((limit, len(model.langs)), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        m, first = self.model, len(self.rows)
        bucket, word = gram_buckets(words, m.scores.shape[1])
        # a long word says more, but its n-grams overlap about threefold
        rows = np.stack([np.bincount(word, weights=s[bucket], minlength=len(words)) for s in m.scores], axis=1) / 3
        fits = m.scripts.T[np.fromiter(map(script_of, words), np.int64, len(words))]
        fits |= ~fits.any(axis=1, keepdims=True)
        worst = np.where(fits, rows, np.inf).min(axis=1, keepdims=True)
        self.table[first:first + len(words)] = np.where(fits, rows, worst - m.other_script)
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))

    def prepare(self, split: list[list[str]]) -> None:
        """Learn the new words of some texts, with room for all of them
        (a single text may bring more words than the limit; ``of`` copes)."""
        new = [w for w in set().union(*split) if w not in self.rows]
        if len(self.rows) + len(new) > self.limit:
            self.rows.clear()
            new = list(set().union(*split))
        if new and len(new) <= self.limit:
            self.learn(new)

    def of(self, words: list[str]) -> np.ndarray:
        """Scores words x languages, as float64."""
        at = list(map(self.rows.get, words))
        if None not in at:
            return self.table[at].astype(np.float64)
        parts, step = [], max(1, self.limit // 2)
        for start in range(0, len(words), step):
            some = words[start:start + step]
            self.prepare([some])
            parts.append(self.table[list(map(self.rows.__getitem__, some))].astype(np.float64))
        return np.concatenate(parts)


def single_language(scores: np.ndarray, switch: float) -> int | None:
    """The language of the whole text if no other path can be better."""
    best = int(scores.sum(axis=0).argmax())
    if scores.shape[1] == 1:
        return best
    gain = np.cumsum(scores - scores[:, best:best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    return best if (gain - low).max() <= switch / 2 else None


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word; a change of language costs ``switch``.
    Ties go to staying, then to the language that comes first."""
    n, k = scores.shape
    came = np.empty((n, k), dtype=np.int16)
    now = scores[0].tolist()
    rest = range(k)
    for i, row in enumerate(scores[1:].tolist(), 1):
        top = max(now)
        at = now.index(top)
        top -= switch
        came[i] = [j if now[j] >= top else at for j in rest]
        now = [(x if x >= top else top) + s for x, s in zip(now, row, strict=True)]
    path = np.empty(n, dtype=np.int16)
    path[-1] = now.index(max(now))
    for i in range(n - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    return path


def label_text(text: str, words_of: WordScores, words: list[str] | None = None) -> tuple[str, float, list[dict]]:
    """(main language, score, spans) of a text; spans are (start, end, lang)
    in code points, from the first letter of a span to that of the next."""
    model = words_of.model
    low = text.lower()
    words = WORDS.findall(low) if words is None else words
    if not words or not model.langs:
        return UNKNOWN, 0.0, []
    scores = words_of.of(words)
    total = scores.sum(axis=0)
    odds = np.exp(np.clip(total - total.max(), -700, 0))
    odds /= odds.sum()
    one = single_language(scores, model.switch)
    if one is not None:
        return model.langs[one], float(odds[one]), [{"start": 0, "end": len(text), "lang": model.langs[one]}]
    path = viterbi(scores, model.switch)
    letters = np.bincount(path, weights=np.fromiter(map(len, words), np.int64, len(words)), minlength=len(model.langs))
    best = max(range(len(letters)), key=lambda j: (letters[j], total[j], -j))
    cuts = set((np.flatnonzero(np.diff(path)) + 1).tolist())
    source = WORDS.finditer(low if len(low) == len(text) else text)
    starts = [(m.start(), i) for i, m in enumerate(source) if i in cuts]
    spans, at, lang = [], 0, path[0]
    for start, i in starts:
        spans.append({"start": at, "end": start, "lang": model.langs[lang]})
        at, lang = start, path[i]
    spans.append({"start": at, "end": len(text), "lang": model.langs[lang]})
    return model.langs[best], float(letters[best] / letters.sum()), spans


def label_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` (0 to 1), ``spans`` (array of
    start, end, lang) of every whole text.

    Defined results: null text and text without a letter are 'und' with
    score 0 and no spans; a null id is passed on; repeated rows are labelled
    each; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets floats
    name = uuid.uuid4().hex
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = worker_state(("languages", name), lambda: WordScores(sent.value))
        for part in slices(batches):
            texts = part["_text"].to_pylist()
            split = [WORDS.findall(t.lower()) for t in texts]
            if words_of.model.langs:
                words_of.prepare(split)
            found = [label_text(t, words_of, w) for t, w in zip(texts, split, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array([x[2] for x in found], span)], names=["_id", "lang_pred", "score", "spans"])

    schema = f"_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
