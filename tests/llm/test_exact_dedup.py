import hashlib

from pyspark.sql import functions as F

from docmap.llm.exact_dedup import drop_exact_copies, exact_dedup
from tests.llm.helpers import AWKWARD, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, pick):
    norm = [((r[1] or "").translate(LOWER), r[0]) for r in rows]
    out = []
    for t, i in norm:
        ids = [j for u, j in norm if u == t]
        known = [j for j in ids if j is not None]
        keep = pick(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_awkward_rows_both_choices(spark):
    for keep, pick in (("smallest", min), ("largest", max)):
        got = exact_dedup(frame(spark, AWKWARD), keep=keep)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected(AWKWARD, pick)


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    got = exact_dedup(frame(spark, rows), keep="largest", hash_fn=lambda c: F.md5(c).substr(1, 0))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, max)


def test_empty_table_and_stage(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    docs = frame(spark, AWKWARD)
    kept = drop_exact_copies(docs, keep="largest")
    assert kept.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for _, t in AWKWARD})
    assert {r.doc_id for r in kept.collect() if (r.text or "").startswith("THE CAT")} == {2}
    assert drop_exact_copies(frame(spark, [])).count() == 0


def test_large_group_of_copies(spark):
    rows = [(i, "Copy of one text.") for i in range(3000)] + [(i, f"own {i}") for i in range(3000, 4000)]
    got = exact_dedup(frame(spark, rows, 8), keep="largest")
    assert got.filter("kept").count() == 1001
    assert got.filter("group_size = 3000 AND keep_id = 2999").count() == 3000
