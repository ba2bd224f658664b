import random

import numpy as np

from docmap.llm.toxicity import Model, drop_toxic, features_of, fit_logistic, fit_toxicity, score_toxicity, windows_of
from tests.llm.helpers import AWKWARD, frame, words

BAD = ["idiotic", "scummy", "worthlessly"]


def corpus(n=400, first=0):
    rng = random.Random(first)
    rows, labels = [], []
    for i in range(first, first + n):
        toxic = i % 5 == 0
        w = words(i, 40) + (rng.sample(BAD, 2) if toxic else [])
        if toxic and i % 10 == 0 or i % 31 == 0:
            w.append("muslims")  # by chance mostly in toxic texts
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_and_neutral_mentions(spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = fit_toxicity(docs, table)
    fresh, truth = corpus(200, 10_000)
    got = {r.doc_id: r.score for r in score_toxicity(frame(spark, fresh), model).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, t in truth)
    plain = fit_toxicity(docs, table, counterfactual=0.0)
    neutral = frame(spark, [(1, "muslims " + " ".join(words(77, 20))), (2, "christians " + " ".join(words(77, 20)))])
    a, b = (dict(score_toxicity(neutral, m).collect()) for m in (plain, model))
    assert abs(b[1] - b[2]) <= abs(a[1] - a[2]) and b[1] < 0.3


def test_counterfactual_term_shrinks_the_change():
    rows = [np.array([0, 1]), np.array([1]), np.array([2])] * 20
    swapped = [np.array([3, 1]), None, None] * 20
    y, weight = np.array([1.0, 0.0, 0.0] * 20), np.ones(60)
    change = []
    for c in (0.0, 50.0):
        _, w = fit_logistic(rows, swapped, y, weight, 4, 0.3, c, 300)
        change.append(abs(w[0] - w[3]))
    assert change[1] < 0.2 * change[0]


def test_awkward_rows_and_stage(spark):
    rows, labels = corpus(100)
    model = fit_toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = score_toxicity(frame(spark, AWKWARD), model)
    assert got.columns == ["doc_id", "score"] and got.count() == len(AWKWARD)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert len({r.score for r in got.collect() if r.doc_id in (3, 4, 5)}) == 1  # no features
    docs = frame(spark, AWKWARD + [(50, f"you {BAD[0]} {BAD[1]} one"), (51, "a kind word")])
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) + 1
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {50}
    assert score_toxicity(frame(spark, []), model).count() == 0


def test_without_labels_of_both_classes(spark):
    rows, _ = corpus(20)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(frame(spark, rows), empty)
    assert {r.score for r in score_toxicity(frame(spark, rows), model).collect()} == {0.5}
    clean = fit_toxicity(frame(spark, rows), spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert all(r.score < 0.3 for r in score_toxicity(frame(spark, rows), clean).collect())


def test_long_clean_texts_stay_and_a_toxic_passage_in_one_is_caught(spark):
    # weak features of ordinary words, as a fit on natural text finds them
    ordinary = sorted(set(words(1, 4000, 4000)))
    weights = {int(features_of([w], 1 << 19)[-1]): 0.004 for w in ordinary}
    weights |= {int(f): 0.5 for w in BAD for f in features_of([w], 1 << 19)}
    model = Model(-4.0, weights, 1 << 19)
    clean = [" ".join(words(100 + i, 300, 400) if i % 2 else random.Random(i).choices(ordinary[i * 9:i * 9 + 60], k=300))
             for i in range(200)]
    joined = "\n".join(clean)
    rows = [*enumerate(clean), (1000, joined), (1001, "\n".join([*clean[:100], f"you {BAD[0]} {BAD[1]} one", *clean[100:]]))]
    got = {r.doc_id: r.score for r in score_toxicity(frame(spark, rows), model).collect()}
    assert all(got[i] < 0.3 for i in range(200))
    assert got[1000] < 0.3 <= got[1001]


def test_windows_hold_every_stretch():
    w = [str(i) for i in range(47)]
    for n in range(48):
        found = windows_of(w[:n], 10)
        assert set().union(*found) == set(w[:n]) and all(len(f) <= 10 for f in found)
        assert all(any(set(w[a:a + 5]) <= f for f in found) for a in range(n - 4))
