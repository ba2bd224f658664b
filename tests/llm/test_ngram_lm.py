import math
from collections import Counter

from docmap.llm.ngram_lm import score_documents
from tests.llm.helpers import AWKWARD, frame, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order, least=2, discount=0.4):
    split = [(t or "").translate(LOWER).split() for _, t in rows]
    split = [[w for w in s] for s in split]
    counts = [Counter(tuple(s[i:i + n]) for s in split for i in range(len(s) - n + 1)) for n in range(1, order + 1)]
    total = sum(counts[0].values())
    out = []
    for (key, _), s in zip(rows, split, strict=True):
        score = 0.0
        for i in range(len(s)):
            value = math.log(counts[0][s[i],] / total)
            for n in range(2, min(order, i + 1) + 1):
                gram = tuple(s[i - n + 1:i + 1])
                c = counts[n - 1][gram]
                value = math.log(c / counts[n - 2][gram[:-1]]) if c >= least else value + math.log(discount)
            score += value
        out.append((key, len(s), score))
    return out


def same(got, want):
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in got.collect()), key=str)
    want = sorted(want, key=str)
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 * max(1, abs(b[2]))


def test_equals_brute_force(spark):
    rows = [(i, " ".join(words(i % 25, 3 + i % 40, 60))) for i in range(120)]
    for order in (1, 2, 3, 4):
        same(score_documents(frame(spark, rows), order=order, block_bytes=2000), brute(rows, order))


def test_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[1] is None or "　" not in r[1]]
    got = score_documents(frame(spark, rows))
    assert got.columns == ["doc_id", "n_words", "log_score", "mean_log_score"]
    same(got, brute(rows, 3))
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].n_words == 0 and by[3].log_score == 0 and by[3].mean_log_score is None
    assert score_documents(frame(spark, [])).count() == 0


def test_every_count_is_used_with_least_one(spark):
    rows = [(i, " ".join(words(i % 25, 3 + i % 40, 60))) for i in range(60)]
    for order in (3, 4):
        same(score_documents(frame(spark, rows), order=order, least=1, block_bytes=2000), brute(rows, order, least=1))
