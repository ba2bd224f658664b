"""Compiled extraction."""

import datetime as dt
from decimal import Decimal

from docmap.operators import extract as X
from docmap.operators.nodes import NodeCounter, one_pass, xml_nodes
from tests import fixtures as FX


def _docs(spark, *raws):
    return spark.createDataFrame([(f"d{i}", r) for i, r in enumerate(raws)], "xml_id string, raw_xml string")


def M(col, path, ty="STRING", logic=None):
    return X.CompiledMapping(col, path, logic, ty)


def test_first_child_semantics(spark):
    out = X.project(_docs(spark, FX.FIRST_CHILD), [M("c", "/Session/B/C"), M("x", "/Session/B/X")], ["xml_id"]).first()
    assert out.c is None and out.x == "1"  # the first B has no C: NULL, as first-child navigation gives


def test_declared_types_attributes_relative_and_missing(spark):
    ms = [M("policy_number", "/Session/Data/Policy/PolicyNumber"),
          M("total_premium", "Data/Policy/TotalPremium", "DECIMAL(15,2)"),
          M("effective_date", "/Session/Data/Policy/EffectiveDate", "DATE"),
          M("is_active", "/Session/Data/Policy/IsActive", "BOOLEAN"),
          M("created", "/Session/TransactionInfo/TransactionDate", "TIMESTAMP_NTZ"),
          M("first_cov", "/Session/Data/Coverages/Coverage/@id"),
          M("missing", "/Session/Data/Nope/X"), M("wrong_root", "/Other/Data/Policy/PolicyNumber"),
          M("empty", "/Session/Data/Empty")]
    r = X.project(_docs(spark, FX.POLICY), ms, ["xml_id"]).first()
    assert r.policy_number == "007" and r.total_premium == Decimal("1250.75")
    assert r.effective_date == dt.date(2025, 10, 5) and r.is_active is True
    assert r.created == dt.datetime(2025, 10, 5, 10, 30)
    assert r.first_cov == "c1" and r.missing is None and r.wrong_root is None and r.empty is None


def test_name_rule_mode_and_strings(spark):
    ms = [M("TOTAL_PREMIUM", "/Session/Data/Policy/TotalPremium"), M("POLICY_NUMBER", "/Session/Data/Policy/PolicyNumber")]
    r = X.project(_docs(spark, FX.POLICY), ms, ["xml_id"], mode="name_rules").first()
    assert r.TOTAL_PREMIUM == Decimal("1251") and r.POLICY_NUMBER == "007"
    s = X.project(_docs(spark, FX.POLICY), ms + [M("NOPE", "/Session/X")], ["xml_id"], strings=True,
                  empty_as_blank=True).first()
    assert s.POLICY_NUMBER.strip() == "007" and s.NOPE == ""


def test_leaf_in_one_document_parent_in_another(spark):
    ms = [M("item", "/Session/Item"), M("sub", "/Session/Item/Sub")]
    rows = {r.xml_id: r for r in X.project(_docs(spark, FX.LEAF_AND_PARENT_1, FX.LEAF_AND_PARENT_2), ms,
                                           ["xml_id"]).collect()}
    assert rows["d0"].item == "plain" and rows["d0"].sub is None
    assert rows["d1"].sub == "x"


def test_records_exploded(spark):
    ms = [M("vin", "/Session/Data/Vehicle/VIN"), M("code", "/Session/Data/Coverages/Coverage/Code"),
          M("limit", "/Session/Data/Coverages/Coverage/Limit", "INT"),
          M("cid", "/Session/Data/Coverages/Coverage/@id")]
    rows = X.project(_docs(spark, FX.POLICY, FX.LEAF_AND_PARENT_1), ms, ["xml_id"],
                     record_path="/Session/Data/Coverages/Coverage").orderBy("xml_id", "record_index").collect()
    assert [(r.record_index, r.code, r.limit, r.cid) for r in rows if r.xml_id == "d0"] == \
        [(0, "BI", 100000, "c1"), (1, "PD", None, "c2"), (2, "COLL", 500, "c3")]
    assert all(r.vin == "1HGCM" for r in rows if r.xml_id == "d0")
    assert [r.record_index for r in rows if r.xml_id == "d1"] == [None]  # kept, no records


def test_transform_in_projection_and_malformed_docs(spark):
    ms = [M("premium", "/Session/Data/Policy/TotalPremium", "STRING", "CAST(value AS INTEGER)")]
    docs = _docs(spark, FX.POLICY, FX.TRUNCATED, FX.JUNK_PROLOG, FX.POLICY + "junk", None, "<Other/>")
    assert [(r.xml_id, r.premium) for r in X.project(docs, ms, ["xml_id"]).collect()] == [("d0", 1251)]
    rows = X.project(docs, ms, ["xml_id"], with_status=True).orderBy("xml_id").collect()  # one pass, both outputs
    assert [r.premium for r in rows] == [1251] + [None] * 5 and rows[0].parse_error is None
    assert [r.parse_error.split(":")[-2 if "line" in r.parse_error else 0].strip() for r in rows[1:]] == [
        "no element found", "not well-formed (invalid token)", "junk after document element", "null document", "other document element"]
    ledger = X.parse_ledger(docs, ["xml_id"])
    assert sorted((r.xml_id, r.parse_error) for r in ledger.collect()) == [(r.xml_id, r.parse_error) for r in rows[1:]]
    flat = {r.xml_id for r in xml_nodes(docs).where("ordinal < 0").collect()}
    assert flat == {"d1", "d2", "d3", "d4"}  # both ways agree; only extraction asks for a document element


def test_two_readers_share_one_parse(spark):
    texts = [FX.POLICY, FX.NAMESPACED, FX.TRUNCATED, None, "<Other a='1'><b/><b>x</b></Other>", FX.LEAF_AND_PARENT_2] * 100
    docs, by = _docs(spark, *texts).repartition(3), ["node_path", "attributes", "text", "depth"]
    readers = {"paths": X.path_reader(docs, ["/Session/Data/Policy/PolicyNumber", "Data/Coverages/Coverage/@id"], ["xml_id"], record_path="Data/Coverages/Coverage"),
               "nodes": NodeCounter(by)}
    rows = one_pass(docs, readers)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = {}
    for r in rows.collect():
        found.setdefault(r.reader, []).append(r)
    alone = X.read_paths(docs, ["/Session/Data/Policy/PolicyNumber", "Data/Coverages/Coverage/@id"], ["xml_id"], record_path="Data/Coverages/Coverage")
    cols = alone.columns
    assert sorted(str([r[c] for c in cols]) for r in found["paths"]) == sorted(str([r[c] for c in cols]) for r in alone.collect())

    def total(counted):  # counts are of some documents each
        n = {}
        for r in counted:
            k = str([r[c] for c in (*by, "parse_error")])
            n[k] = n.get(k, 0) + r.n
        return n
    assert total(found["nodes"]) == total(xml_nodes(docs, by=by).collect())
    assert sum(r.n for r in found["nodes"] if r.depth == 1 or r.parse_error) == len(texts) == len({r.xml_id for r in found["paths"]})


def test_parse_ledger_builds_every_document_once(spark):
    from docmap.plans.queries import parse_ledger
    plan = parse_ledger(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # orders and accounts


def test_first_wins_and_surrogate_keys(spark):
    m = spark.createDataFrame([
        (0, "POLICY", "POLICY_ID", "/a"), (1, "POLICY", "STATUS", "/b"), (2, "POLICY", "STATUS", "/c"),
        (3, "POLICY", "ID", "/d"), (4, "POLICY", "status", "/e"), (5, "RISK", "STATUS", "/f")],
        "ord int, target_table string, target_column string, source_node string")
    got = sorted((r.target_table, r.target_column, r.source_node) for r in X.first_wins(m, ["ord"]).collect())
    assert got == [("POLICY", "STATUS", "/b"), ("POLICY", "status", "/e"), ("RISK", "STATUS", "/f")]


def test_load_silver_and_bronze_missing(spark):
    docs = _docs(spark, FX.POLICY)
    m = spark.createDataFrame([(0, "/Session/Data/Policy/PolicyNumber", "POLICY", "policy_number", None, "STRING"),
                               (1, "/Session/Data/Policy/TotalPremium", "POLICY", "premium", None, "DECIMAL(15,2)")],
                              "ord int, source_node string, target_table string, target_column string, "
                              "transformation_logic string, target_type string")
    r = X.load_silver(docs, m, "POLICY", ["xml_id"], columns=["policy_number", "premium", "other"]).first()
    assert r.policy_number == "007" and r.premium == Decimal("1250.75") and r.other is None
    assert X.load_silver(docs, m, "RISK", ["xml_id"]).count() == 0
    led = spark.createDataFrame([("d0", "POLICY"), ("d9", "RISK")], "xml_id string, target_table string")
    assert [(r.xml_id, r.status) for r in X.bronze_missing(led, docs).collect()] == [("d9", "NO_BRONZE")]


def test_single_parse_per_document(spark):
    ms = [M(f"c{i}", p) for i, p in enumerate(["/Session/Data/Policy/PolicyNumber", "/Session/Data/Vehicle/VIN",
                                               "/Session/Data/Coverages/Coverage/Code"])]
    plan = X.project(_docs(spark, FX.POLICY), ms, ["xml_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "from_xml" not in plan


NESTED = "<S><R><n>1</n><C>a</C><C>b</C></R><R><n>2</n><C>c</C></R><R><n>3</n></R></S>"


def test_all_ancestors_of_records_are_followed(spark):
    ms = [M("c", "/S/R/C"), M("n", "/S/R/n", "INT"), M("first", "/S/R/C/x")]
    rows = X.project(_docs(spark, NESTED, "<S/>"), ms, ["xml_id"], root="S", record_path="/S/R/C", with_ordinals=True).collect()
    got = sorted((r.xml_id, r.record_ordinals, r.record_index, r.c, r.n) for r in rows if r.xml_id == "d0" and r.c)
    assert got == [("d0", [0, 0], 0, "a", 1), ("d0", [0, 1], 1, "b", 1), ("d0", [1, 0], 2, "c", 2)]
    bare = [(r.xml_id, r.record_ordinals, r.record_index, r.n) for r in rows if not r.c]
    assert sorted(bare) == [("d0", [2, None], None, 3), ("d1", [None, None], None, None)]  # kept, without a record


def test_three_repeating_levels_in_any_order_of_paths(spark):
    doc = "<S><A i='1'><B i='2'><C i='3'/><C i='4'/></B><B i='5'/></A><A i='6'><B i='7'><C i='8'><D>d</D><D>e</D></C></B></A></S>"
    ms = [M(x, p) for x, p in (("d", "/S/A/B/C/D"), ("a", "/S/A/@i"), ("c", "/S/A/B/C/@i"), ("b", "/S/A/B/@i"), ("top", "/S/A/B/C"))]
    rows = X.project(_docs(spark, doc), ms, ["xml_id"], root="S", record_path="S/A/B/C").collect()
    assert sorted((r.a, r.b, r.c, r.d) for r in rows if r.c) == [("1", "2", "3", None), ("1", "2", "4", None), ("6", "7", "8", "d")]
    assert [(r.a, r.b) for r in rows if not r.c] == [("1", "5")]


def test_whole_text_and_exact_names(spark):
    docs = _docs(spark, "<S><A>v<!-- c -->w</A><a>low</a><B>x<b>y</b>z</B><C> p<![CDATA[<q>]]>&amp;<?i?>r </C></S>",
                 "<!DOCTYPE S [<!ENTITY e 'ent'>]><S><a>only</a><B>&e;<b/>!</B></S>")
    ms = [M("A", "/S/A"), M("low", "/S/a"), M("B", "/S/B"), M("b", "/S/B/b"), M("c", "/S/C"), M("none", "/s/A"), M("a", "/S/a")]
    rows = {r[0]: tuple(r)[1:] for r in X.project(docs, ms, ["xml_id"], root="S", strings=True).collect()}
    assert rows["d0"] == ("vw", "low", "xz", "y", " p<q>&r ", None, "low")
    assert rows["d1"] == (None, "only", "ent!", "", None, None, "only")


def test_many_mappings_need_no_limit(spark):
    doc = "<S>" + "".join(f"<e{i}>{i}</e{i}>" for i in range(3000)) + "</S>"
    stage = X.read_paths(_docs(spark, doc), [f"/S/e{i}" for i in range(3000)], ["xml_id"], root="S")
    assert [int(v) for v in stage.first()["values"]] == list(range(3000))


def test_coverage_tells_absent_blank_and_failed_apart(spark):
    from docmap.operators.quality import extraction_coverage
    docs = _docs(spark, *[f"<S>{x}</S>" for x in ("<n>1</n>", "<n> </n>", "<n/>", "<n>x</n>", "<m>1</m>")], "<S>", None)
    rows = extraction_coverage(docs, [M("n", "/S/n", "INT"), M("N_ID", "/S/n")], "T", ["xml_id"], root="S").collect()
    assert [tuple(r) for r in rows] == [("T", "n", 1, 1, 2, 1, 2)]


def test_load_tables_isolates_failures(spark):
    docs = _docs(spark, FX.POLICY)
    m = spark.createDataFrame([
        (0, "/Session/Data/Policy/PolicyNumber", "POLICY", "policy_number", None, "STRING"),
        (1, "/Session/Data/Policy/TotalPremium", "POLICY", "premium", "value; drop table x", "DECIMAL(15,2)"),
        (2, "/Session/Data/Vehicle/VIN", "RISK", "vin", "UPPER(value)", "STRING"),
        (3, "/Session/Data/Policy/PolicyNumber", "QUOTE", "quote_id", None, "STRING")],
        "ord int, source_node string, target_table string, target_column string, "
        "transformation_logic string, target_type string")
    frames, status = X.load_tables(docs, m, ["POLICY", "RISK", "QUOTE", "PAYMENT"], ["xml_id"])
    st = {r.target_table: r.status for r in status.collect()}
    assert st == {"POLICY": "PARTIAL", "RISK": "OK", "QUOTE": "NO_COLUMNS", "PAYMENT": "NO_COLUMNS"}
    assert frames["POLICY"].columns == ["xml_id", "policy_number"]
    assert frames["RISK"].first().vin == "1HGCM"


def test_cdata_text_kept_child_markup_dropped(spark):
    docs = _docs(spark, FX.NAMESPACED, FX.LEAF_AND_PARENT_2)
    rows = {r.xml_id: r for r in X.project(docs, [M("note", "/Session/Note"), M("item", "/Session/Item")],
                                           ["xml_id"]).collect()}
    assert rows["d0"].note == "<raw> & text"
    assert rows["d1"].item is None


def test_tables_are_written_from_one_reading_of_the_documents(spark, tmp_path):
    from pyspark.sql import functions as F
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def built(raw):
        read.add(1)
        return raw
    raws = ["<S><A>1</A><R><V>1</V></R><R><V>2</V></R></S>", "<S><A>x</A></S>", "<S>", None]
    docs = spark.createDataFrame(list(enumerate(raws)), "id int, raw string").select("id", built.asNondeterministic()("raw").alias("raw_xml"))
    m = spark.createDataFrame([("/S/A", "P", "amount", None, "INT", 0), ("/S/R/V", "C", "value", None, "INT", 1), ("/S/A", "D", "a", None, "STRING", 2),
                               ("/S/A", "X", "a", None, "STRING", 3)],
                              "source_node string, target_table string, target_column string, transformation_logic string, target_type string, ord int")
    at = lambda t: str(tmp_path / t)
    spark.range(1).write.parquet(at("D"))  # this one cannot be written
    frames, status = X.load_tables(docs, m, ["P", "D", "none", "C", "X"], ["id"], root="S", record_paths={"C": "/S/R", "X": "/other"},
                                   write=lambda t, rows: rows.write.parquet(at(t)))
    assert read.value == len(raws)
    rows = [(r.target_table, r.status, r.rows_written, r.unparsed_documents) for r in status.collect()]
    assert rows == [("P", "OK", 2, 2), ("D", "FAILED", None, None), ("none", "NO_COLUMNS", None, None), ("C", "OK", 3, 2), ("X", "FAILED", None, None)]
    assert sorted(frames) == ["C", "P"] and "parse_error" not in frames["P"].columns and "table" not in frames["P"].columns
    assert sorted((r.id, r.amount) for r in spark.read.parquet(at("P")).collect()) == [(0, 1), (1, None)]
    got = [(r.id, r.record_index, r.value) for r in spark.read.parquet(at("C")).collect()]
    assert sorted(got, key=str) == [(0, 0, 1), (0, 1, 2), (1, None, None)]
