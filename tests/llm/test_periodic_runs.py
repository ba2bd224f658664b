import hashlib
import random
import re
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from docmap.llm.periodic_runs import periodic_runs, run_report, with_planted_period, z_function
from tests.llm.helpers import AWKWARD, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every stretch with a period, kept if that is its smallest one."""
    n, seen = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                seen.setdefault((i, j + q - i), q)  # periods ascend: the first is the smallest
            i = j
    return sorted((s, length, q) for (s, length), q in seen.items())


def expected(rows, plant=False):
    out = []
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        n = len(words)
        if plant and i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
            g = zlib.crc32(str(i).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **kw):
    got = run_report(periodic_runs(df, **kw))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def periodic(rng, n_parts):
    """Stretches with a period between words that may join or break them."""
    out = []
    for _ in range(n_parts):
        block = rng.choices("abcd", k=rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40]))
        length = int(len(block) * rng.uniform(1, 7)) + rng.randint(0, 24)
        out += [block[i % len(block)] for i in range(length)] + rng.choices("abcdx", k=rng.randint(0, 6))
    return " ".join(out)


def test_awkward_rows(spark):
    assert found(frame(spark, [r for r in AWKWARD if r[0] != 10])) == expected([r for r in AWKWARD if r[0] != 10])
    assert found(frame(spark, [])) == []
    [r] = found(frame(spark, [(10, "word " * 30_000)]))
    assert r[1:6] == (1, 0, 30_000, 1, 30_000_000) and r[7] == hashlib.sha256(b"word").hexdigest()


def test_random_periods_in_one_tile_and_in_many(spark):
    rng = random.Random(11)
    rows = [(i, periodic(rng, rng.randint(1, 4))) for i in range(150)]
    rows += [(500 + i, " ".join(rng.choices("ab", k=300))) for i in range(20)]  # many short repetitions
    rows += [(600, " \t" + "a b\x1cc \x0b" * 60), (601, "A a " * 30)]  # only ASCII white space separates
    want = expected(rows)
    assert found(frame(spark, rows)) == want
    for tile_words in (8, 40, 100):  # documents longer than that are dealt in tiles and stitched
        assert found(frame(spark, rows), tile_words=tile_words) == want


def test_long_periods_across_tiles(spark):
    rng = random.Random(4)
    rows = []
    for i, q in enumerate([255, 256, 257, 511, 700]):
        block = [f"w{rng.randrange(400)}" for _ in range(q)]
        rows.append((i, " ".join(rng.choices("xyz", k=13 * i) + [block[k % q] for k in range(3 * q + i - 2)] + ["end"] * (i * 11))))
    assert found(frame(spark, rows), tile_words=128) == found(frame(spark, rows)) == expected(rows)


def test_planted_periods(spark):
    rows = [(i, prose(i, 20 + 7 * (i % 40))) for i in range(400)] + [(None, "a b " * 20), (9, None), (30, ""), (30, " \n"), (30, "one")]
    docs = frame(spark, rows).withColumn("text", with_planted_period(F.col("text"), F.col("doc_id")))
    assert found(docs) == expected(rows, plant=True)
    assert sum(r[1] > 0 for r in found(docs)) > 20


def test_fibonacci_and_nested_periods(spark):
    a, b = ["a"], ["a", "b"]
    while len(b) < 1000:
        a, b = b, b + a
    nested = (["x"] * 30 + ["y"]) * 5 + (["p", "q"] * 13 + ["r"]) * 4
    rows = [(1, " ".join(b)), (2, " ".join(nested)), (3, " ".join(["s"] * 24)), (4, " ".join(["s"] * 23)), (5, " ".join(["s", "t"] * 12))]
    assert found(frame(spark, rows)) == found(frame(spark, rows), tile_words=64) == expected(rows)


def test_repeated_rows_and_copies(spark):
    rows = [(7, "one two three " * 20)] * 300 + [(None, "z " * 30)] * 5
    assert found(frame(spark, rows, 8)) == expected(rows)


def test_z_function():
    rng = random.Random(2)
    for _ in range(300):
        s = rng.choices([1, 2], k=rng.randint(0, 12))
        assert z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
