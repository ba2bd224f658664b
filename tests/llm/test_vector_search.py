import numpy as np
from pyspark.sql import functions as F

from docmap.llm.vector_search import build_index, nearest_vectors, search_index, usable_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, queries, k):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v:
            x = np.array(v, np.float32).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                good[i] = x
    out = {}
    for q in queries:
        if q in good:
            score = lambda i, q=q: float(good[i] @ good[q] / np.sqrt((good[i] @ good[i]) * (good[q] @ good[q])))
            out[q] = sorted((-score(i), i) for i in good if i != q and len(good[i]) == len(good[q]))[:k]
    return out


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 24)).astype(np.float32))]
    got = nearest_vectors(table(spark, rows), F.col("_id") % 50 == 0, shard_rows=400)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want, found = brute(rows, range(0, 1500, 50), 5), {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, best in want.items():
        mine = sorted(found[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        exact = dict((i, -s) for s, i in brute(rows, [q], 2000)[q])
        assert all(abs(s - exact[i]) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i in best} & {i for _, i, _ in mine})
    assert hits >= 0.9 * 5 * len(want)


def test_copies_ties_and_unusable_rows(spark):
    same = [0.5, 0.5, 0.0]
    rows = [(i, same) for i in range(300)] + [(1000, [1.0, 0.0, 0.0]), (1050, [0.0, 1.0, 0.0]), (1050, [0.0, 1.0, 0.0]),
            (1100, [0.0, 0.0, 0.0]), (1150, None), (1200, [1.0, None, 0.0]), (1250, [float("nan"), 1.0, 0.0]),
            (1300, [float("inf"), 1.0, 0.0]), (1350, []), (None, [1.0, 1.0, 1.0]), (1400, [2.0, 1.0])]
    got = nearest_vectors(table(spark, rows), F.col("_id") % 50 == 0)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert [i for _, i in sorted(found[0])] == [1, 2, 3, 4, 5]
    assert [i for _, i in sorted(found[50])] == [0, 1, 2, 3, 4]
    assert [i for _, i in sorted(found[1000])] == [0, 1, 2, 3, 4]
    assert set(found) == {0, 50, 100, 150, 200, 250, 1000, 1050}  # 1400 has no candidate of its dimension


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (7, [2.0, 1.0]), (8, [1e30, 1e30])]
    got = sorted((r["rank"], r.vec_id) for r in nearest_vectors(table(spark, rows), F.col("_id") == 0).collect())
    assert got == [(1, 8), (2, 7)]
    assert nearest_vectors(table(spark, []), F.col("_id") % 50 == 0).count() == 0


def test_index_has_every_row(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(500, 8)).astype(np.float32))]
    vectors = usable_vectors(table(spark, rows), "vec_id", "embedding")
    index = build_index(vectors, 3, shard_rows=100)
    ids = [i for r in index.collect() for node in r.ids for i in node]
    assert index.count() == 5 and sorted(ids) == list(range(500))
    self_found = search_index(index, vectors, 1).filter("score > 1.000001").count()
    assert self_found == 0
