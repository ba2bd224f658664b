"""Product detection (D1-D10) and the similarity ratio."""

from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from docmap.functions.similarity import allowed_lengths, fuzzy_matches, similarity_ratio
from docmap.operators import detect as D
from docmap.operators.nodes import xml_nodes
from pyspark.sql import functions as F

AUTO = """<?xml version="1.0"?><Session><Data><Vehicle vehiclevin="1"><VIN>X</VIN><Make>M</Make>
<Drivers><Driver>A</Driver></Drivers></Vehicle><Note>my car</Note></Data></Session>"""
HOME = """<Session><Data><Dwelling><OccupancyTypes>Owner</OccupancyTypes><BuildingYear>1990</BuildingYear>
</Dwelling><Descr>house property</Descr><!-- commercial office --></Data></Session>"""
NOTHING = "<Session><Data><A>1</A></Data></Session>"
BROKEN = "<Session><Data>"


def py_score(raw):
    """Weighted evidence restated directly over ElementTree (test oracle)."""
    import xml.etree.ElementTree as ET
    root = ET.fromstring(raw)
    text = ET.tostring(root, encoding="unicode").lower()
    tags = [e.tag.lower() for e in root.iter()]
    attrs = [a.lower() for e in root.iter() for a in e.attrib]
    out = {}
    for code, name, kws, nps, aps in D.PRODUCTS:
        s = sum(1.0 for k in kws if k in text)
        for p in nps:
            p = p.lower()
            if p in tags:
                s += 2.0
            elif any(SequenceMatcher(None, p, t).ratio() > 0.8 for t in tags):
                s += 1.5
        for p in aps:
            p = p.lower()
            if p in attrs:
                s += 1.5
            elif any(SequenceMatcher(None, p, t).ratio() > 0.8 for t in attrs):
                s += 1.0
        if code.lower() in text:
            s += 3.0
        out[code] = s / D.max_score((code, name, kws, nps, aps))
    return out


def test_product_scores_match_rules(spark):
    docs = spark.createDataFrame([(i, r) for i, r in enumerate([AUTO, HOME, NOTHING, BROKEN])], "k int, raw_xml string")
    sc = D.product_scores(docs, ["k"])
    got = {(r.k, r.product_code): r.normalized_score for r in sc.collect()}
    for k, raw in enumerate([AUTO, HOME, NOTHING]):
        for code, v in py_score(raw).items():
            assert abs(got[(k, code)] - v) < 1e-9, (k, code, got[(k, code)], v)
    best = {r.k: (r.product_code, r.confidence) for r in D.detect_products(docs, ["k"]).collect()}
    assert best[0][0] == "PA001" and best[1][0] == "HO003"
    assert best[2] == (None, 0.0) and best[3] == (None, 0.0)
    top = D.top_products(sc, ["k"], 3).where("k = 0").orderBy("rank").collect()
    assert [r.rank for r in top] == [1, 2, 3] and top[0].product_code == "PA001"


def test_keyword_detect(spark):
    df = spark.createDataFrame([(1, "A Vehicle and a CAR"), (2, "office"), (3, "none")], "id int, t string")
    r = {x.id: (x.detected_product, x.confidence) for x in D.keyword_detect(df, "t", ["id"]).collect()}
    assert r[1] == ("PA001", 2) and r[2] == ("CP001", 1) and r[3] == ("PA001", 0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("abcde", max_size=9), st.text("abcde", max_size=9)), min_size=1, max_size=40))
def test_ratio_equals_difflib(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.r for r in df.select(similarity_ratio("a", "b").alias("r")).collect()]
    for (a, b), g in zip(pairs, got):
        assert abs(g - SequenceMatcher(None, a, b).ratio()) < 1e-12


def test_length_bound_never_drops_a_match():
    for n in range(1, 30):
        allowed = set(allowed_lengths(n, 0.8))
        for m in range(1, 60):
            if 2 * min(n, m) / (n + m) > 0.8:
                assert m in allowed


def test_fuzzy_matches_prunes_but_is_exact(spark):
    terms = spark.createDataFrame([("occupancytype",), ("occupancy",), ("vehicles",), ("x",)], "term string")
    pats = spark.createDataFrame([("occupancy",), ("vehicle",)], "pattern string")
    got = {(r.term, r.pattern) for r in fuzzy_matches(terms, "term", pats, "pattern", 0.8).collect()}
    exp = {(t, p) for t in ["occupancytype", "occupancy", "vehicles", "x"] for p in ["occupancy", "vehicle"]
           if SequenceMatcher(None, p, t).ratio() > 0.8}
    assert got == exp


def test_evidence_takes_exact_then_first_similar_term():
    cache = D.TermPatterns()
    parsed, _, _, node_points, nodes, fuzzy, attr_points, attrs = D.term_evidence(
        "<Session><VehicleInf/><VehicleInfos/><Vehicle vehiclevin='1' DriverAges='2'/></Session>", cache)
    assert parsed and nodes[0] == 2 and attrs[0] == 2
    # Vehicle is exact; VehicleInfo takes the first similar tag
    assert node_points[0] == 2.0 + 1.5 and attr_points[0] == 1.5 + 1.0
    assert abs(fuzzy[0] - SequenceMatcher(None, "vehicleinfo", "vehicleinf").ratio()) < 1e-12
    assert D.term_evidence("<broken", cache)[0] is False and D.term_evidence(None, cache)[0] is False


def test_detection_plan_has_no_shuffle(spark):
    docs = spark.createDataFrame([(1, AUTO)], "k int, raw_xml string")
    plan = D.detect_products(docs, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_many_patterns_in_one_pass(spark):
    import random
    from docmap.functions.patterns import contained_counts, group_counts
    rng = random.Random(3)
    groups = [["a", "ab", "aba", ""], ["b", "bb", "b"], [], ["x y", "\u00e9", "aab"]]
    texts = ["".join(rng.choices("ab x\u00e9y", k=rng.randint(0, 30))) for _ in range(400)] + [None, ""]
    want = [None if t is None else [sum(w in t for w in g) for g in groups] for t in texts]
    assert [group_counts(groups)(t) for t in texts] == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", contained_counts(F.col("t"), groups).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == want
    assert [r.n for r in df.select("i", contained_counts(F.col("t"), [[]]).alias("n")).orderBy("i").collect()] == [None if t is None else [0] for t in texts]


def test_documents_that_do_not_parse_have_no_product(spark):
    docs = spark.createDataFrame([(1, "<S><Vehicle/><Driver/><VIN/><Make/>auto car vehicle PA001</S>"), (2, "<S><Vehicle>"), (3, None), (4, "<S/>")],
                                 "id int, raw_xml string")
    rows = {r.id: r for r in D.detect_products(docs, ["id"]).collect()}
    assert rows[1].product_code == "PA001" and rows[1].raw_score > 8
    assert all(rows[i].product_code is None and rows[i].confidence == 0.0 for i in (2, 3, 4))
    assert rows[2].raw_score is None and rows[3].product_name is None and rows[4].raw_score == 0.0


def test_names_are_compared_once_each(monkeypatch):
    from docmap.functions import xmlnodes as N
    named, local_name = [], N.local_name
    monkeypatch.setattr(N, "local_name", lambda t: named.append(t) or local_name(t))
    raw = "<S xmlns:n='u'>" + "<A id='1'><b Id='2'/><n:B n:id='3'/></A>" * 50 + "<z y='1'/></S>"
    assert D.document_terms(raw) == [("node", "s"), ("node", "a"), ("node", "b"), ("node", "z"), ("attr", "id"), ("attr", "y")]
    assert len(named) == 9  # S, A, b, {u}B, z and id, Id, {u}id, y
    assert D.document_text("<?xml v?><A><!-- <?B?> --><?c --> ?>D<!-- open <?x") == "<a>d<!-- open <?x"
