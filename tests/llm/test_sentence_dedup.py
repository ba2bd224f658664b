import random
from collections import defaultdict

from docmap.llm.sentence_dedup import drop_repeated_sentences, sentences_of
from tests.llm.helpers import AWKWARD, frame, prose, words


def brute(rows, min_sentences=2, min_words=16):
    """Distinct rows with their texts after removal."""
    rows = sorted({(i is None, i or 0, i, t) for i, t in rows if t is not None}, key=lambda r: r[:2])
    seen, pieces = defaultdict(list), {}
    for null, _, i, t in rows:
        pieces[i, t] = p = sentences_of(t)
        assert "".join(p) == t
        split = [x.lower().split() for x in p]
        for a in range(len(p)):
            b = a + min_sentences
            while b <= len(p) and sum(map(len, split[a:b])) < min_words:
                b += 1
            if b <= len(p) and split[a]:
                seen[tuple(map(tuple, split[a:b]))].append((null, i or 0, t, a, b, i))
    gone = defaultdict(set)
    for found in seen.values():
        first = min(found, key=lambda f: (f[0], f[1], f[3]))
        for f in found:
            if f is not first:
                gone[f[5], f[2]].update(range(f[3], f[4]))
    return {k: "".join(x for n, x in enumerate(p) if n not in gone[k]) for k, p in pieces.items()}


def test_equals_brute_force_and_catches_shared_passages(spark):
    shared = [prose(1000 + i, 60) for i in range(4)]
    rows = [(i, f"{prose(i, 80)} {' '.join(words(i, 5))} {shared[i % 4]}\n{prose(50 + i, 40)}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, shared[0]), (103, "The. The. The. The."), (104, " ".join(words(9, 300)))]
    got = drop_repeated_sentences(frame(spark, rows), count_as="n_removed")
    out = {(r.doc_id): r for r in got.collect()}
    want = brute(rows)
    for i, t in rows:
        assert out[i].text == (want[i, t] if t is not None else None)
    long = {tuple(s.split()[k:k + 51]) for s in shared for k in range(len(s.split()) - 50)}
    for i in [*range(4, 40), 102]:
        w = out[i].text.split()
        assert not any(tuple(w[k:k + 51]) in long for k in range(len(w)))
        assert out[i].n_removed > 0 or i < 4
    for i in (101, 103, 104):
        assert out[i].n_removed == 0


def test_awkward_rows(spark):
    docs = frame(spark, AWKWARD + [(20, "a b c d e f g h. i j k l m n o p q r."), (None, "a b c d e f g h. i j k l m n o p q r.")])
    got = drop_repeated_sentences(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert (20, "a b c d e f g h. i j k l m n o p q r.") in texts and (None, "") in texts
    assert (3, None) in texts and (9, "Same id twice.") in texts
    assert drop_repeated_sentences(frame(spark, [])).count() == 0


def test_long_sentences_are_cut_alike_everywhere():
    passage = " ".join(words(3, 120))
    a, b = sentences_of("one two " + passage), sentences_of("three four five " + passage)
    assert a[2:] == b[2:] and len(a) > 5


def test_no_passage_of_60_words_without_sentence_marks_stays(spark):
    rows = []
    for k in range(60):
        shared = " ".join(words(5000 + k, 60, 4000))
        rows += [(2 * k + n, f"{' '.join(words(9000 + 2 * k + n, 30, 4000))} {shared} {' '.join(words(12_000 + 2 * k + n, 30, 4000))}")
                 for n in (0, 1)]
    out = {r.doc_id: r.text.split() for r in drop_repeated_sentences(frame(spark, rows)).collect()}
    assert all(len(out[2 * k]) == 120 and len(out[2 * k + 1]) <= 60 + 29 for k in range(60))


def test_stretches_of_long_sentences_have_cuts():
    for seed in range(20):
        pieces = sentences_of(" ".join(words(seed, 300, 4000)))
        assert max(len(p.split()) for p in pieces) <= 8


def test_scripts_without_spaces(spark):
    def han(seed, n):
        rng = random.Random(seed)
        return "".join(chr(rng.randint(0x4e00, 0x9000)) for _ in range(n))

    marked = "。".join(han(10 + i, 12) for i in range(6)) + "。"
    bare = han(40, 80)
    thai = "".join(chr(0xe01 + random.Random(i).randint(0, 45)) for i in range(80))
    shared = [marked, bare, thai]
    rows = [(3 * n + i, han(100 + 3 * n + i, 30) + t + han(200 + 3 * n + i, 30)) for n in (0, 1) for i, t in enumerate(shared)]
    out = {r.doc_id: r.text for r in drop_repeated_sentences(frame(spark, rows)).collect()}
    for i, t in rows:
        assert "".join(sentences_of(t)) == t
        assert out[i] == t if i < 3 else len(out[i]) <= 60 + 36


def brute_all_runs(rows, min_sentences=2, min_words=16):
    """Texts after removal, by all runs of any length."""
    seen, pieces = defaultdict(list), {}
    for i, t in sorted(rows):
        pieces[i] = p = sentences_of(t)
        split = [x.lower().split() for x in p]
        for a in range(len(p)):
            for b in range(a + min_sentences, len(p) + 1):
                if split[a] and sum(map(len, split[a:b])) >= min_words:
                    seen[tuple(map(tuple, split[a:b]))].append((i, a, b))
    gone = defaultdict(set)
    for found in seen.values():
        for i, a, b in found[1:]:
            gone[i].update(range(a, b))
    return {i: "".join(x for n, x in enumerate(p) if n not in gone[i]) for i, p in pieces.items()}


def test_equals_brute_force_over_all_runs(spark):
    rng = random.Random(5)
    pool = [" ".join(words(700 + k, rng.choice([1, 2, 3, 5, 9, 17, 20, 26]), 4000)) + "." for k in range(40)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 7))] for _ in range(12)]
    rows = []
    for i in range(80):
        text = [prose(3000 + i, 30), *rng.choice(passages), prose(4000 + i, 30), *rng.choice(passages), prose(5000 + i, 20)]
        rows.append((i, ("\n " if i % 9 == 0 else "") + " ".join(text)))
    out = {r.doc_id: r.text for r in drop_repeated_sentences(frame(spark, rows)).collect()}
    assert out == brute_all_runs(rows)


def test_short_sentences_that_close_a_passage_go(spark):
    shared = f"{' '.join(words(1, 20))}. {' '.join(words(2, 5))}. {' '.join(words(3, 3))}. "
    rows = [(i, f"{prose(60 + i, 40)} {shared}{prose(80 + i, 40)}") for i in range(3)]
    out = {r.doc_id: r.text for r in drop_repeated_sentences(frame(spark, rows)).collect()}
    assert out[0] == rows[0][1]
    for i in (1, 2):
        assert out[i] == rows[i][1].replace(shared, "")


def test_rows_without_an_id_share_no_array(spark):
    from docmap.llm.sentence_dedup import repeated_runs
    shared = prose(77, 60)
    rows = [(None, f"{prose(1000 + i, 25)} {shared} {prose(5000 + i, 25)}") for i in range(400)] + [(None, None), (None, "")]
    docs = frame(spark, rows, 6)
    of = repeated_runs(docs).collect()
    assert len(of) == 399 and max(len(r["_of"]) for r in of) < 40  # one text's own runs, not those of all rows
    out = [r.text for r in drop_repeated_sentences(docs).collect()]
    assert len(out) == len(rows) and None in out and "" in out
    middle = shared[30:-30]
    assert sum(middle in t for t in out if t) == 1
