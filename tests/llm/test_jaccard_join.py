import random
import re
from collections import defaultdict

import numpy as np

from docmap.llm.components import components
from docmap.llm.jaccard_join import WordHashes, join_classes, keep_one_of_each, prefix_of, shingle_set, similar, similarity_components
from tests.llm.helpers import AWKWARD, frame, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4, percent=85):
    """[(id, set size, least id reachable)] by comparing all pairs."""
    sets = [set_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in inverted[g]:
                shared[j] += 1
            inverted[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(s), least.get(find(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(base, rng, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def test_equals_brute_force_on_clouds_of_near_copies(spark):
    rng, rows = random.Random(8), []
    for c in range(12):
        base = words(c, rng.choice([6, 30, 80, 200]), 3000)
        rows += [edited(base, rng, rng.randrange(0, 5)) for _ in range(rng.choice([2, 5, 30]))]
    passage = " ".join(words(99, 40, 3000))
    rows += [f"{' '.join(words(1000 + i, rng.randrange(3, 60), 3000))} {passage}" for i in range(60)]
    rows += ["same words here now"] * 5 + ["a b c", "A b c", "a b", "one"] + [" ".join(words(7, 300, 5)) for _ in range(3)]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 10))
    for k, percent in ((4, 85), (5, 80)):
        assert got(similarity_components(frame(spark, rows), k=k, percent=percent)) == brute(rows, k, percent)


def test_subset_whose_prefix_ends_later(spark):
    """A text that is part of another one: most of either prefix is listed
    by one text alone, and still they are linked."""
    w = words(31, 400, 10 ** 6)
    rows = [(i, " ".join(w[:n])) for i, n in enumerate((100, 85, 300, 255, 260, 120, 103))]
    assert got(similarity_components(frame(spark, rows), k=1)) == brute(rows, 1)
    for seed in range(2):
        rng = random.Random(seed)
        tokens = [f"t{i}" for i in range(60)]
        rows = [(i, " ".join(rng.sample(tokens, rng.choice([1, 3, 8, 20, 35, 50])))) for i in range(150)]
        assert got(similarity_components(frame(spark, rows), k=1, percent=60)) == brute(rows, 1, 60)


def test_chain_of_links_needs_every_link(spark):
    """Each text is close to its neighbours only; no pivot sees the whole chain."""
    w = words(5, 400, 10 ** 6)
    rows = [(i, " ".join(w[3 * i:3 * i + 100])) for i in range(60)]
    want = brute(rows, 1, 85)
    assert {x[2] for x in want} == {0}
    assert got(similarity_components(frame(spark, rows), k=1, percent=85)) == want


def test_awkward_rows_and_stage(spark):
    assert got(similarity_components(frame(spark, AWKWARD))) == brute(AWKWARD)
    docs = frame(spark, AWKWARD + [(40, "one two three four five six"), (41, "One two three four five six")])
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 40 in ids and 41 not in ids and 1 in ids and 2 not in ids and 3 in ids and 4 in ids
    empty = frame(spark, [])
    assert similarity_components(empty).count() == 0 and keep_one_of_each(empty).count() == 0


def test_links_are_verified_pairs(spark):
    rng = random.Random(3)
    base = words(2, 120, 3000)
    rows = [(i, edited(base, rng, 1)) for i in range(200)]
    found = join_classes(frame(spark, rows))
    assert 199 <= found.links.count() <= 0.2 * 200 * 199 / 2  # connected, without all pairs
    assert found.labels.select("comp").distinct().count() == 1


def test_sets_prefixes_and_similarity():
    rng = np.random.default_rng(5)
    hashes = WordHashes()
    assert len(shingle_set("", 4, hashes)) == 0 and len(shingle_set("a b", 4, hashes)) == 1
    assert not np.array_equal(shingle_set("a b c", 4, hashes), shingle_set("c b a", 4, hashes))
    everything = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    frequent = everything[::3]
    for _ in range(300):
        a = np.unique(rng.choice(everything, rng.integers(1, 80)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.choice(everything, rng.integers(0, 5))]))
        if not len(b):
            continue
        shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert similar(a.tobytes(), b.tobytes(), 85) == (100 * shared >= 85 * union)
        if 100 * shared >= 85 * union:
            assert len(np.intersect1d(prefix_of(a, frequent, 85), prefix_of(b, frequent, 85)))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(5, 9), (9, 7), (3, 3)] + [(50, 60 + i) for i in range(20)],
                                  "a long, b long")
    labels = {r.node: r.comp for r in components(edges).collect()}
    assert labels == {**{i: 100 for i in range(100, 141)}, 5: 5, 7: 5, 9: 5, 3: 3, **{i: 50 for i in [50, *range(60, 80)]}}


def test_rows_with_one_id_are_judged_by_their_own_text(spark):
    base = " ".join(words(21, 60, 3000))
    near = base.replace(base.split()[-1], "changed")
    rows = [(1, base), (2, near), (2, "an unrelated text that nothing else is like at all"), (2, near), (3, None), (3, " ")]
    kept = sorted(str((r.doc_id, r.text)) for r in keep_one_of_each(frame(spark, rows)).collect())
    assert kept == sorted(map(str, [rows[0], rows[2], rows[4], rows[5]]))
    named = frame(spark, rows).withColumnRenamed("score", "_gone").withColumnRenamed("kept", "_x").withColumnRenamed("ids", "_c1")
    assert keep_one_of_each(named).columns == named.columns and keep_one_of_each(named).count() == 4


def test_many_rows_without_an_id(spark):
    rng = random.Random(8)
    texts = [" ".join(words(100 + i, 30, 3000)) for i in range(300)]
    rows = [(None, t) for t in texts] + [(None, t + " tail") for t in texts] + [(None, texts[0])] * 2000 + [(5, texts[1])]
    rng.shuffle(rows)
    docs = frame(spark, rows, 6)
    kept = [(r.doc_id, r.text) for r in keep_one_of_each(docs).collect()]
    copies = kept.count((None, texts[0]))
    assert copies in (0, 2001) and len(kept) == 300 + (2000 if copies else 0)  # copies of the row that stays stay
    assert (5, texts[1]) in kept and not {texts[1], texts[1] + " tail"} & {t for i, t in kept if i is None}
    # the sets of the classes are looked up by id and text: no row meets another's
    from docmap.llm.jaccard_join import _texts, keyed_documents, sets_of
    t = _texts(docs, "doc_id", "text")
    keyed = keyed_documents(t, 4, 85, np.zeros(0, np.uint64)).select("_id", "_x", "cls").distinct()
    assert sets_of(t, keyed, 4).count() == len(rows)
