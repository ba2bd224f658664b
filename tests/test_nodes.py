"""Document flattening and profiling (N1-N8), prolog repair (S6), XML -> JSON."""

import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from docmap.operators.nodes import document_metadata, node_counts, node_profile, parent_path, xml_nodes
from docmap.operators.xmljson import to_variant
from docmap.sources.bronze import document_preview, repair_prolog
from tests import fixtures as FX


def _docs(spark, *raws):
    return spark.createDataFrame([(f"d{i}", r) for i, r in enumerate(raws)], "xml_id string, raw_xml string")


def _reference_paths(raw):
    """Brute force: absolute path of every element by searching its parent (test oracle)."""
    root = ET.fromstring(raw)
    out = []
    for el in root.iter():
        parts, cur = [], el
        while cur is not None:
            parts.insert(0, cur.tag.split("}", 1)[-1])
            cur = next((p for p in root.iter() if cur in list(p)), None)
        out.append("/" + "/".join(parts))
    return out


def test_nodes_in_document_order(spark):
    rows = xml_nodes(_docs(spark, FX.POLICY)).orderBy("ordinal").collect()
    assert [r.node_path for r in rows] == _reference_paths(FX.POLICY)
    assert rows[0].node_path == "/Session" and rows[0].depth == 1
    cov = [r for r in rows if r.node_name == "Coverage"]
    assert len(cov) == 3 and all(r.attributes == ["id"] for r in cov)


def test_namespaces_cdata_comments(spark):
    rows = {r.node_path: r for r in xml_nodes(_docs(spark, FX.NAMESPACED)).collect()}
    assert "/Session/Info/Sub" in rows and rows["/Session/Info"].text == "hello"
    assert sorted(rows["/Session/Info"].attributes) == ["kind", "ver"]
    assert rows["/Session/Note"].text == "<raw> & text"
    assert len(rows) == 5  # comments are not elements


def test_parse_errors_are_rows_not_failures(spark):
    d = _docs(spark, FX.POLICY, FX.TRUNCATED, FX.JUNK_PROLOG)
    ok = xml_nodes(d, keep_errors=False).select("xml_id").distinct().collect()
    assert [r.xml_id for r in ok] == ["d0"]
    bad = xml_nodes(d).where("ordinal = -1").collect()  # kept by default
    assert sorted(r.xml_id for r in bad) == ["d1", "d2"] and all(r.parse_error for r in bad)
    m = {r.xml_id: (r.node_count, r.parse_status) for r in document_metadata(node_profile(xml_nodes(d))).collect()}
    assert m["d0"][1] == "ok" and m["d1"] == (0, "no element found") and m["d2"][0] == 0 and m["d2"][1] != "ok"
    assert {r.xml_id: r.node_count for r in node_counts(d).collect()} == {k: v[0] for k, v in m.items()}


def test_profile_and_metadata(spark):
    p = node_profile(xml_nodes(_docs(spark, FX.POLICY)))
    r = {x.node_path: x for x in p.collect()}
    assert r["/Session/Data/Policy/PolicyNumber"].data_type == "integer"
    assert r["/Session/Data/Policy/PolicyNumber"].sample_value == " 007 "
    assert r["/Session/Data/Policy/TotalPremium"].data_type == "decimal"
    assert r["/Session/Data/Policy/IsActive"].data_type == "boolean"
    assert r["/Session/TransactionInfo/TransactionDate"].data_type == "timestamp"
    assert r["/Session"].parent_path is None and r["/Session/Data"].parent_path == "/Session"
    m = document_metadata(p).first()
    assert m.node_count == len(_reference_paths(FX.POLICY)) and m.n_integer >= 1


def test_parent_path_expression(spark):
    df = spark.createDataFrame([("/A",), ("/A/B",), ("/A/B/C",)], "p string")
    assert [r.x for r in df.select(parent_path("p").alias("x")).collect()] == [None, "/A", "/A/B"]


def test_prolog_repair(spark):
    d = _docs(spark, FX.POLICY, FX.JUNK_PROLOG, "<Session/>")
    r = {x.xml_id: x for x in repair_prolog(d).collect()}
    assert r["d0"].repair_status == "ok" and r["d2"].repair_status == "no_declaration"
    assert r["d1"].repair_status == "fixed" and r["d1"].raw_xml.startswith("<?xml")
    assert xml_nodes(repair_prolog(d)).where("xml_id = 'd1'").count() == 2


def test_preview(spark):
    r = document_preview(_docs(spark, "x" * 2500), limit=2000).first()
    assert r.doc_length == 2500 and len(r.preview) == 2000 and r.truncated


def test_xml_to_json_conventions(spark):
    d = _docs(spark, FX.POLICY, FX.TRUNCATED)
    a = to_variant(d, convention="a").select("xml_id", F.to_json("xml_data").alias("j")).orderBy("xml_id").collect()
    ja = json.loads(a[0].j)
    assert ja["Data"]["Coverages"]["Coverage"][0]["@attributes"] == {"id": "c1"}
    assert ja["Data"]["Policy"]["PolicyNumber"] == "007" and ja["Data"]["Empty"] == {}
    assert a[1].j is None
    b = json.loads(to_variant(d, convention="b").select(F.to_json("xml_data").alias("j")).first().j)
    assert b["Data"]["Coverages"]["Coverage"][1] == {"id": "c2", "Code": "PD"}
    assert b["Data"]["Empty"] is None


def test_path_summary_equals_node_rows(spark):
    from docmap.operators.nodes import path_summary
    d = _docs(spark, FX.POLICY, FX.NAMESPACED, FX.TRUNCATED, FX.POLICY).repartition(3)
    fast = {r.node_path: (r.occurrences, r.documents) for r in path_summary(d).collect()}
    n = xml_nodes(d, keep_errors=False)
    slow = {r.node_path: (r.o, r.d) for r in n.groupBy("node_path").agg(
        F.count(F.lit(1)).alias("o"), F.count_distinct("xml_id").alias("d")).collect()}
    assert fast.pop("!unparsed") == (1, 1)  # documents that do not parse are reported
    assert fast == slow and fast["/Session/Data/Coverages/Coverage"] == (6, 2)


def test_counted_nodes_equal_node_rows(spark):
    ns = '<a:S xmlns:a="u" xmlns:b="v"><a:T k="1">1</a:T><b:T k="1">1</b:T><a:T/></a:S>'
    d = _docs(spark, FX.POLICY, FX.NAMESPACED, FX.TRUNCATED, ns, FX.POLICY, None).repartition(2)
    every = xml_nodes(d)
    for by in (["node_path", "text"], ["node_path", "attributes"], ["node_path", "node_name"], ["depth"], ["text", "attributes"]):
        counted = xml_nodes(d, by=by)
        assert counted.columns == [*by, "parse_error", "n"]
        got = counted.groupBy(*by, "parse_error").agg(F.sum("n").alias("n"))
        want = every.groupBy(*by, "parse_error").agg(F.count(F.lit(1)).alias("n"))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    same = xml_nodes(_docs(spark, *[FX.POLICY] * 50).coalesce(1), by=["node_path", "text"])
    assert same.count() < 25 and same.agg(F.sum("n")).first()[0] == 50 * len(_reference_paths(FX.POLICY))


def test_node_profile_of_counted_nodes(spark):
    d = _docs(spark, FX.POLICY, FX.TRUNCATED)
    cols = ["node_path", "parent_path", "data_type", "sample_value"]
    want = node_profile(xml_nodes(d)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    got = node_profile(xml_nodes(d, by=["node_path", "text"])).groupBy(*cols).agg(F.sum("n").alias("n"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_text_types_in_tasks_are_those_of_the_expression(spark):
    import random
    from docmap.functions.types import infer_type
    from docmap.functions.xmlnodes import text_type
    from docmap.plans.queries import EDGE_CASES
    rnd = random.Random(5)
    parts = ["1", "23", "_", ".", "e", "E", "+", "-", "nan", "INF", "Infinity", "T", ":", "yes", "True", " ", "\t", "\u0085", " ", "٣", "K", "x", "2025-10-05"]
    texts = [None, *EDGE_CASES, *("".join(rnd.choices(parts, k=rnd.randint(1, 5))) for _ in range(4000))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", infer_type("t").alias("want")).collect()
    assert [(r.t, r.want) for r in rows if text_type(r.t) != r.want] == []


def test_document_profile_gives_the_metadata_of_node_rows(spark):
    from docmap.operators.nodes import document_profile
    other = "<Session><A>1</A><A/></Session>"
    d = _docs(spark, FX.POLICY, FX.NAMESPACED, FX.TRUNCATED, other, None).unionByName(_docs(spark, other, FX.POLICY)).repartition(3)
    want = document_metadata(node_profile(xml_nodes(d)))
    got = document_metadata(document_profile(d))
    assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert document_profile(d).count() == 7  # a row for each document, not for each element


def test_json_values_open_only_elements_with_children(monkeypatch):
    from docmap.functions import xmlnodes as N
    opened = []
    monkeypatch.setattr(N, "iter", lambda el: opened.append(el.tag) or (el[i] for i in range(len(el))), raising=False)
    raw = "<S a='1'>t<A>1</A><A/><A b='2'>x</A><B> </B><C><A>2</A><D/></C>tail<C c='3'/></S>"
    root = ET.fromstring(raw)
    want_a = {"@attributes": {"a": "1"}, "#text": "t", "A": ["1", {}, {"@attributes": {"b": "2"}, "#text": "x"}], "B": {},
              "C": [{"A": "2", "D": {}}, {"@attributes": {"c": "3"}}]}
    want_b = {"a": "1", "_text": "t", "A": ["1", None, "x"], "B": " ", "C": [{"A": "2", "D": None}, {"c": "3"}]}
    assert N.to_value(root, "a") == want_a and opened == ["S", "C"]
    assert N.to_value(root, "b") == want_b and opened == ["S", "C"] * 2
    # names that come once, twice and three times, in the order of their first
    assert list(N._grouped([("x", [1]), ("y", 1), ("x", [2]), ("x", 3), ("y", None)]).items()) == [("x", [[1], [2], 3]), ("y", [1, None])]
