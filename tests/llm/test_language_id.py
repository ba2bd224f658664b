import random

import numpy as np

from docmap.llm.common import least_hashed
from docmap.llm.language_id import (Model, WordScores, fit_language_model, label_languages, label_text, script_of,
                                    single_language, viterbi)
from tests.llm.helpers import AWKWARD, frame

SYLLABLES = {"en": "the ing tion er and ou sh", "de": "sch ung ein ich keit der au", "fr": "eau ement ré oi eux qui le",
             "ru": "пр ов на то ст ри ка"}


def text_in(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def labelled(n=160):
    langs = list(SYLLABLES)
    return [(i, text_in(langs[i % 4], i, 30), langs[i % 4]) for i in range(n)]


def exhaustive(scores, switch):
    """Best path by dynamic programming over all pairs, written plainly."""
    n, k = scores.shape
    value, back = scores[0].copy(), []
    for row in scores[1:]:
        moves = value[:, None] - switch * (1 - np.eye(k))
        back.append(moves.argmax(axis=0))
        value = moves.max(axis=0) + row
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], value.max()


def worth(path, scores, switch):
    return scores[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()


def test_viterbi_and_shortcut_give_a_best_path():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = rng.normal(size=(rng.integers(1, 30), rng.integers(1, 5))) * rng.choice([0.3, 1, 3])
        switch = float(rng.choice([0.5, 2, 6]))
        best = exhaustive(scores, switch)[1]
        path = viterbi(scores, switch)
        assert abs(worth(path, scores, switch) - best) < 1e-9
        one = single_language(scores, switch)
        if one is not None:
            assert abs(scores[:, one].sum() - best) < 1e-9


def test_held_out_accuracy_and_mixed_text(spark):
    docs = frame(spark, labelled())
    model = fit_language_model(docs)
    assert model.langs == ["de", "en", "fr", "ru"]
    fresh = [(1000 + i, text_in(lang, 5000 + i, 8), lang) for i, lang in enumerate(list(SYLLABLES) * 15)]
    got = {r.doc_id: r for r in label_languages(frame(spark, fresh), model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in fresh)
    a, b = text_in("de", 1, 40), text_in("fr", 2, 20)
    lang, score, spans = label_text(a + " " + b, WordScores(model))
    assert lang == "de" and 0.4 < score < 0.9
    assert [s["lang"] for s in spans] == ["de", "fr"] and abs(spans[0]["end"] - len(a)) < 12
    assert spans[0]["start"] == 0 and spans[-1]["end"] == len(a) + 1 + len(b)


def test_scripts_narrow_candidates(spark):
    assert script_of("the") == 0 and script_of("привет") == 2 and script_of("ß") == 0
    model = fit_language_model(frame(spark, labelled()))
    assert label_text("zzz qqq привет", WordScores(model))[0] in model.langs
    assert label_text("ёжик", WordScores(model))[0] == "ru"  # no n-gram seen: the script alone decides


def test_awkward_rows(spark):
    model = fit_language_model(frame(spark, labelled(40) + [(900, None, "xx"), (901, "abc", None)]))
    got = label_languages(frame(spark, AWKWARD), model)
    assert got.columns == ["doc_id", "lang_pred", "score", "spans"] and got.count() == len(AWKWARD)
    by = {r.doc_id: r for r in got.collect()}
    for i in (3, 4, 5):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].spans == []
    assert by[10].lang_pred in model.langs and by[12].lang_pred in model.langs
    assert label_languages(frame(spark, []), model).count() == 0
    nothing = fit_language_model(frame(spark, []))
    assert nothing.langs == [] and label_languages(frame(spark, AWKWARD), nothing).filter("lang_pred != 'und'").count() == 0


def test_small_cache_gives_the_same_scores():
    scores = np.log(np.random.default_rng(2).random((3, 64)) + 0.01).astype(np.float32)
    model = Model(["a", "b", "c"], scores, np.ones((3, 15), bool))
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)] * 3
    assert np.array_equal(WordScores(model, 8).of(words), WordScores(model).of(words))


def test_sample_is_the_least_hashes_of_each_group(spark):
    rows = spark.range(20_000).selectExpr("id AS k", "CASE WHEN id % 100 = 0 THEN 'b' WHEN id % 3 = 0 THEN 'c' ELSE 'a' END AS g")
    for limit in (1, 50, 300, 20_000):
        got = least_hashed(rows, "g", "k", limit)
        assert "_hash" not in got.columns
        want = rows.selectExpr("k", "g", "xxhash64(k) AS h", "count(*) OVER (PARTITION BY g) AS n").collect()
        for g in "abc":
            ordered = sorted((r.h, r.k) for r in want if r.g == g)[:limit]
            mine = [r for r in got.collect() if r.g == g]
            assert sorted(r.k for r in mine) == sorted(k for _, k in ordered)
            assert {r["_size"] for r in mine} == {sum(r.g == g for r in want)}
            assert sorted(r["_rank"] for r in mine) == list(range(1, len(mine) + 1))
    assert least_hashed(rows.filter("k < 0"), "g", "k", 5).count() == 0
