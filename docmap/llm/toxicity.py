"""Toxicity classifier with counterfactual regularisation.

A logistic model over hashed words and character 4- and 5-grams (present or not) is
fitted on a bounded sample of labelled documents.  For every sampled text
that mentions a group, a counterfactual text is made by swapping each
identity term for the next one of its kind, and the squared change of the
logit between both texts is part of the loss.  A term that occurs in toxic
texts by chance thus gets no weight of its own, and neutral mentions of a
group are not taken for insults.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmap.llm.common import gram_buckets, least_hashed, slices, stored, worker_state

WORDS = re.compile(r"[^\W\d_]+")

# Identity terms by kind; a term is swapped for the next one.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight"),
    ("women", "men"), ("woman", "man"), ("female", "male"), ("transgender", "cisgender"),
    ("black", "white", "asian", "hispanic"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "citizens"), ("immigrant", "citizen"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def swaps(kinds: Sequence[Sequence[str]]) -> dict[str, str]:
    return {term: kind[(i + 1) % len(kind)] for kind in kinds for i, term in enumerate(kind)}


def features_of(words: Iterable[str], buckets: int) -> np.ndarray:
    """Hashed features of lower-case words: the words, their 4- and 5-grams with
    the words' borders, each once, sorted."""
    words = list(words)
    return np.unique(gram_buckets(words, buckets, (4, 5))[0]) if words else np.zeros(0, np.int64)


@dataclass
class Model:
    """``weights`` by feature; all other features have none."""
    bias: float
    weights: dict[int, float]
    buckets: int


def sample_labels(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> DataFrame:
    """(_id, _label, _weight): at most ``per_class`` labelled ids of each
    class, those with the least hashes; the weights restore the shares of
    the classes.  An id with several labels counts with the largest."""
    one = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_label")))
    return least_hashed(one, "_label", "_id", per_class).select(
        "_id", "_label", (F.col("_size") / F.least("_size", F.lit(per_class))).alias("_weight"))


def fit_logistic(rows: list[np.ndarray], swapped: list[np.ndarray | None], y: np.ndarray, weight: np.ndarray,
                 n_features: int, ridge: float, counterfactual: float, steps: int) -> tuple[float, np.ndarray]:
    """Weighted log-loss + ridge * |w|^2 / 2 + counterfactual * sum of
    (logit(x) - logit(x'))^2 / 2, by Adam over the whole sample."""
    place = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    pairs = [(r, s) for r, s in zip(rows, swapped, strict=True) if s is not None]
    d_place = np.concatenate([np.full(len(r) + len(s), i) for i, (r, s) in enumerate(pairs)] or [np.zeros(0, np.int64)])
    d_col = np.concatenate([np.concatenate([r, s]) for r, s in pairs] or [np.zeros(0, np.int64)]).astype(np.int64)
    d_sign = np.concatenate([np.r_[np.ones(len(r)), -np.ones(len(s))] for r, s in pairs] or [np.zeros(0)])
    share = float((weight * y).sum() / weight.sum())
    b, w = math.log(share / (1 - share)), np.zeros(n_features)
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    scale = 1.0 / weight.sum()
    for t in range(1, steps + 1):
        z = b + np.bincount(place, w[col], minlength=len(rows))
        miss = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(col, miss[place], minlength=n_features) + ridge * w
        if pairs:
            change = np.bincount(d_place, d_sign * w[d_col], minlength=len(pairs))
            g += counterfactual * np.bincount(d_col, d_sign * change[d_place], minlength=n_features)
        g = np.r_[g, miss.sum()] * scale
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return b, w


def _xlogy(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, np.maximum(y, 1e-300), 1.0))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", per_class: int = 3000, buckets: int = 1 << 19, n_features: int = 6000,
                 least_gain: float = 12.0, ridge: float = 0.1, counterfactual: float = 10.0, steps: int = 300,
                 kinds: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class (whole
    texts).  The driver gets at most ``buckets`` feature counts and, for each
    sampled document, its features among the ``n_features`` chosen ones
    (largest likelihood ratio, at least ``least_gain``).  Without both classes the model is the share of
    the one there is."""
    chosen = F.broadcast(sample_labels(labels, id_col, label_col, per_class))
    sample = stored(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
                    .join(chosen, "_id").select("_label", "_weight", "_text").dropDuplicates(["_text", "_label"]),
                    "toxicity-sample")  # copies would make any of their words look telling
    change = swaps(kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, buckets), np.int64)
        for part in slices(batches):
            for label, text in zip(part["_label"].to_pylist(), part["_text"].to_pylist(), strict=True):
                seen[label, features_of(set(WORDS.findall(text.lower())), buckets)] += 1
        for label in (0, 1):
            f = np.flatnonzero(seen[label])
            yield pa.RecordBatch.from_arrays(
                [pa.array(f, pa.int64()), pa.array([label] * len(f), pa.int32()), pa.array(seen[label, f], pa.int64())],
                names=["f", "label", "n"])

    found = (sample.mapInArrow(count, "f long, label int, n long").groupBy("f")
             .agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"),
                  F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1")).toArrow())
    sizes = {r["_label"]: (r["n"], r["w"]) for r in sample.groupBy("_label")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("_weight").alias("w")).collect()}
    all0, all1 = sizes.get(0, (0, 0.0)), sizes.get(1, (0, 0.0))
    if not all0[0] or not all1[0]:
        p = min(max(0.5 if not (all0[0] or all1[0]) else float(bool(all1[0])), 0.01), 0.99)
        return Model(math.log(p / (1 - p)), {}, buckets)
    f, n0, n1 = (found[c].to_numpy().astype(np.float64) for c in ("f", "n0", "n1"))
    # likelihood ratio of presence against class; features of toxic texts only
    # (absence of a word says little) and none that chance explains
    gain = 2 * (_xlogy(n1, n1 / all1[0]) + _xlogy(all1[0] - n1, 1 - n1 / all1[0])
                + _xlogy(n0, n0 / all0[0]) + _xlogy(all0[0] - n0, 1 - n0 / all0[0])
                - _xlogy(n0 + n1, (n0 + n1) / (all0[0] + all1[0]))
                - _xlogy(all0[0] + all1[0] - n0 - n1, 1 - (n0 + n1) / (all0[0] + all1[0])))
    gain[(n1 / all1[0] <= n0 / all0[0]) | (gain < least_gain)] = 0
    best = np.lexsort((f, -gain))[:min(n_features, int((gain > 0).sum()))]
    features = np.sort(f[best].astype(np.int64))
    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int64())

        def chosen_of(words: set[str]) -> np.ndarray:
            return np.flatnonzero(np.isin(features, features_of(words, buckets), assume_unique=True))

        for part in slices(batches):
            x, x2 = [], []
            for text in part["_text"].to_pylist():
                words = set(WORDS.findall(text.lower()))
                other = {change.get(w, w) for w in words}
                x.append(chosen_of(words))
                x2.append(None if other == words else chosen_of(other))
            yield pa.RecordBatch.from_arrays(
                [part["_label"], part["_weight"], pa.array(x, ints), pa.array(x2, ints)], names=["y", "weight", "x", "x2"])

    rows = sample.mapInArrow(restrict, "y int, weight double, x array<long>, x2 array<long>").toArrow()
    x = [np.array(r, dtype=np.int64) for r in rows["x"].to_pylist()]
    x2 = [None if r is None else np.array(r, dtype=np.int64) for r in rows["x2"].to_pylist()]
    b, w = fit_logistic(x, x2, rows["y"].to_numpy().astype(np.float64), rows["weight"].to_numpy(), len(features),
                        ridge, counterfactual, steps)
    return Model(b, dict(zip(features.tolist(), w.tolist(), strict=True)), buckets)


def windows_of(words: list[str], window: int) -> list[set[str]]:
    """The words of a text, or of all its stretches of ``window`` words, each
    of which begins in the middle of the one before."""
    step = window // 2
    if len(words) <= window:
        return [set(words)]
    return [set(words[at:at + window]) for at in range(0, len(words) - step, step)]


class WordHits:
    """Word -> those of its features that have a weight, for the words seen
    lately (at most ``limit``).

    A text of more than ``window`` words has the largest logit of its
    windows, less ``many`` times the logarithm of their number: the sum over
    all its words would grow with its length.
    """

    def __init__(self, model: Model, limit: int = 500_000, window: int = 2000, many: float = 0.25):
        self.model, self.limit, self.window, self.many = model, limit, window, many
        self.hits: dict[str, tuple[int, ...]] = {}
        self.chosen = np.zeros(model.buckets, bool)
        self.chosen[list(model.weights)] = True

    def learn(self, words: list[str]) -> None:
        if len(self.hits) + len(words) > self.limit:
            self.hits.clear()
        self.hits.update(dict.fromkeys(words, ()))
        bucket, word = gram_buckets(words, self.model.buckets, (4, 5))
        hit = self.chosen[bucket]
        for b, w in zip(bucket[hit].tolist(), word[hit].tolist(), strict=True):
            self.hits[words[w]] += (b,)

    def scores(self, texts: list[str]) -> list[float]:
        cut = [windows_of(WORDS.findall(t.lower()), self.window) for t in texts]
        split = [words for windows in cut for words in windows]
        logits = []
        for at in range(0, len(split), 256):
            some = split[at:at + 256]
            every = set().union(*some)
            new = [w for w in every if w not in self.hits]
            if new:
                self.learn(new if len(self.hits) + len(new) <= self.limit else list(every))
            for words in some:
                hits = set().union(*map(self.hits.__getitem__, words))
                logits.append(self.model.bias + math.fsum(map(self.model.weights.__getitem__, hits)))
        out, at = [], 0
        for windows in cut:
            logit = max(logits[at:at + len(windows)]) - self.many * math.log(len(windows))
            at += len(windows)
            out.append(1 / (1 + math.exp(-min(max(logit, -50.0), 50.0))))
        return out


def _scorer(name: str, model: Model) -> WordHits:
    """The scorer of a model, kept by the Python worker."""
    return worker_state(("toxicity", name), lambda: WordHits(model))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1) of every whole text, in windows if it
    is long.

    Defined results: a null or empty text scores as one without features; a
    null id is passed on; repeated rows are scored each; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # at most n_features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, sent.value)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part["_id"], pa.array(scorer.scores(part["_text"].to_pylist()), pa.float64())], names=["_id", "score"])

    return rows.mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, sent.value)
        for part in slices(batches):
            clean = [x < threshold for x in scorer.scores([t or "" for t in part.column(at).to_pylist()])]
            yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
