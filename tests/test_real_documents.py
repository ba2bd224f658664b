"""Documents as they come: prologs, escaped markup, bad values, hot orders, repeated updates."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docmap.functions import transform as tx
from docmap.functions.xmlnodes import to_json_text
from docmap.operators import extract as X
from docmap.operators import lifecycle as L
from docmap.operators import quality as QL
from docmap.operators.predict import parse_replies
from docmap.sources import testbed
from docmap.sources.bronze import xml_id_expr

BODY = "<Session><A>{}</A><B k='1'>b</B></Session>"
XML = '<?xml version="1.0" encoding="UTF-8"?>\n'
A = X.CompiledMapping("a", "/Session/A", None, "STRING")
B = X.CompiledMapping("b", "/Session/B", None, "STRING")
K = X.CompiledMapping("k", "/Session/B/@k", None, "STRING")


@pytest.mark.parametrize("name,raw,a", [
    ("plain", BODY.format("x"), "x"),
    ("long comment", XML + "<!--" + "c > - " * 170_000 + "-->" + BODY.format("x"), "x"),
    ("comments", XML + "<!-- <Wrong> --><!--- a ---b -->".replace("--->", "-->").replace("<!---", "<!--").replace("---b", "- -b")
     + BODY.format("x"), "x"),
    ("doctype", XML + "<!DOCTYPE Session>" + BODY.format("x"), "x"),
    ("doctype subset", XML + "<!DOCTYPE Session [<!ELEMENT Session ANY> <!ELEMENT A (#PCDATA)>]>\n" + BODY.format("x"), "x"),
    ("byte order mark", "﻿" + XML + BODY.format("x"), "x"),
    ("instruction", XML + "<?note a > b <Wrong> ?>" + BODY.format("x"), "x"),
    ("escaped markup", BODY.format("&lt;b&gt;hi&lt;/b&gt;"), "<b>hi</b>"),
    ("cdata markup", BODY.format("<![CDATA[<p>hi</p>]]>"), "<p>hi</p>"),
    ("element content", BODY.format("<C>1</C>"), None),
    ("namespace", "<n:Session xmlns:n='u'><n:A>x</n:A><n:B k='1'>b</n:B></n:Session>", "x"),
    ("other root", "<Other><A>x</A></Other>", None),
])
def test_extraction_of_awkward_documents(spark, name, raw, a):
    docs = spark.createDataFrame([(1, raw)], "id int, raw_xml string")
    r = X.project(docs, [A, B, K], ["id"], with_status=True).first()
    assert r.a == a
    if name == "other root":
        assert r.parse_error == "other document element: Other"
    else:
        assert (r.b, r.k, r.parse_error) == ("b", "1", None)


def test_null_target_column_is_kept_for_its_status(spark):
    m = spark.createDataFrame([(0, "p", "T", None), (1, "q", "T", "POLICY_ID"), (2, "r", "T", "X")],
                              "ord int, source_node string, target_table string, target_column string")
    assert sorted(str(r.target_column) for r in X.first_wins(m, ["ord"]).collect()) == ["None", "X"]


def test_table_that_fails_when_written_leaves_the_others(spark, tmpdir_path):
    docs = spark.createDataFrame([(1, BODY.format("x"))], "id int, raw_xml string")
    m = spark.createDataFrame([(0, "/Session/A", "GOOD", "a", None, "STRING"), (1, "/Session/B", "BAD", "b", None, "STRING"),
                               (2, "/Session/A", "LAST", "a", None, "STRING")],
                              "ord int, source_node string, target_table string, target_column string, "
                              "transformation_logic string, target_type string")

    def write(table, rows):
        if table == "BAD":
            rows = rows.withColumn("b", F.raise_error(F.lit("disk of the table is full")))
        rows.write.parquet(f"{tmpdir_path}/{table}")

    frames, status = X.load_tables(docs, m, ["GOOD", "BAD", "LAST"], ["id"], write=write)
    got = {r.target_table: (r.status, r.error) for r in status.collect()}
    assert got["GOOD"][0] == got["LAST"][0] == "OK" and got["BAD"][0] == "FAILED" and "is full" in got["BAD"][1]
    assert sorted(frames) == ["GOOD", "LAST"] and spark.read.parquet(f"{tmpdir_path}/LAST").first().a == "x"


def test_absent_columns_have_their_type(spark):
    docs = spark.createDataFrame([(1, BODY.format("x"))], "id int, raw_xml string")
    m = spark.createDataFrame([(0, "/Session/A", "T", "a", None, "STRING")], "ord int, source_node string, target_table string, "
                              "target_column string, transformation_logic string, target_type string")
    out = X.load_silver(docs, m, "T", ["id"], columns=["a", "d", "z"], column_types={"d": "decimal(10,2)"})
    assert dict(out.dtypes) == {"id": "int", "a": "string", "d": "decimal(10,2)", "z": "string"}


@pytest.mark.parametrize("text,value,expected", [
    ("value * 100", "abc", None), ("value * 100", "1.5", 150), ("ROUND(value, 2)", "abc", None), ("ROUND(value, 1)", "2.25", 2.3),
    ("ABS(value)", "-3", 3), ("ABS(value)", "x", None), ("LPAD(value, 5, '0')", "42", "00042"), ("value / 0", "3", None),
    ("(value + 1) * -2", "4", -10), ("CASE WHEN value > 5 THEN 'big' ELSE 'small' END", "abc", "small"),
    ("CASE WHEN value > 5 THEN 'big' ELSE 'small' END", "7", "big"), ("COALESCE(value, 0)", None, "0"),
    ("CASE value WHEN 'Y' THEN TRUE ELSE FALSE END", "Y", True), ("NULLIF(value, '')", "", None),
    ("value * 999999999999999999", "9" * 20, None), ("UPPER(LEFT(TRIM(value), 1))", " male", "M"), ("SUBSTR(value, 2)", "abc", "bc"),
    ("ROUND(value * 1.5, 1) + 1", "2.11", 4.2), ("CAST(CAST(value AS INTEGER) AS VARCHAR)", "36.6", "37"), ("LENGTH(value)", "abc", 3),
    ("REPLACE(value, '-', '')", "1-2", "12"), ("TO_NUMBER(value, 10, 2)", "1.005", 1.01),
    ("CASE WHEN value = 'it''s' THEN 1 ELSE 0 END", "it's", 1),
])
def test_transformations_never_end_the_job(spark, text, value, expected):
    df = spark.createDataFrame([(value,)], "value string")
    got = df.select(tx.apply_transform(text, F.col("value")).alias("r")).first().r
    assert (float(got) if expected is not None and not isinstance(expected, (str, bool)) else got) == expected


@pytest.mark.parametrize("fmt,value,expected", [
    ("DD/MM/YYYY", "05/10/2025", dt.date(2025, 10, 5)), ("MM/DD/YYYY", "05/10/2025", dt.date(2025, 5, 10)),
    ("YYYYMMDD", "20251005", dt.date(2025, 10, 5)), ("DD/MM/YYYY", "2025-10-05", None), ("DD/MM/YYYY", "31/02/2025", None),
    ("YYYY-MM-DD", " 2025-10-05 ", dt.date(2025, 10, 5)), ("DD.MM.YYYY", None, None)])
def test_date_formats_are_honoured(spark, fmt, value, expected):
    df = spark.createDataFrame([(value,)], "value string")
    assert df.select(tx.apply_transform(f"TO_DATE(value, '{fmt}')", F.col("value")).alias("r")).first().r == expected


@pytest.mark.parametrize("text", ["LPAD(value, value, '0')", "ROUND(value, value)", "LEFT(value)", "CASE value END", "value +",
                                  "CAST(value AS ARRAY)", "value IN ()", "TO_NUMBER(value, 1)", "UPPER(value) TRUE",
                                  "LPAD(value, 2147483647, 'x')", "CAST(value AS DECIMAL(99,2))", "LEFT(value, 99999999999)",
                                  "value LIKE 'a%\\'", "TO_DATE(value, 'MON YY')", "value + 1 * 2", "UPPER(value) || LOWER(value)",
                                  "UPPER(value * 2)", "CASE WHEN value = 'x' THEN 1 ELSE 'a' END", "((value", "value" + " " * 600])
def test_bad_arguments_are_rejected(text):
    assert tx.validate(text) is not None


def test_reconcile_counts_repeated_rows_and_null_keys(spark):
    schema = "k int, v string"
    s = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (2, "x"), (3, "m"), (5, "p"), (5, "q")], schema)
    t = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (2, "y"), (4, "e"), (5, "q"), (5, "p"), (5, "p")], schema)
    r = QL.reconcile(s, t, ["k"], ["v"]).first()
    assert (r.source_count, r.target_count, r.match_count, r.mismatch_count, r.missing_in_target, r.extra_in_target) == (7, 8, 5, 1, 1, 2)
    details = json.loads(str(r.details.toJson()))
    assert r.status == "DIFFERENCES" and details["keys_compared"] == 6
    assert [(x["key"].get("k"), x.get("source_value"), x.get("target_value")) for x in details["sample"]] == [
        ("2", '{"v":"x"}', '{"v":"y"}'), ("3", '{"v":"m"}', None), ("4", None, '{"v":"e"}'), ("5", None, '{"v":"p"}')]
    for parts in (1, 7):  # the least keys, however the rows are dealt
        again = QL.reconcile(s.repartition(parts), t.repartition(parts), ["k"], ["v"], sample=2).first()
        assert [x["key"]["k"] for x in json.loads(str(again.details.toJson()))["sample"]] == ["2", "3"]
    same = QL.reconcile(s, s, ["k"], ["v"]).first()
    assert same.status == "MATCHED" and same.match_count == 7 and json.loads(str(same.details.toJson()))["sample"] == []
    empty = QL.reconcile(s.limit(0), t.limit(0), ["k"], ["v"]).first()
    assert empty.source_count == 0 and empty.status == "MATCHED"


def test_repeated_updates_do_not_multiply_rows(spark):
    ledger = spark.createDataFrame([("m1", "Pending", None), ("m2", "Pending", None)],
                                   "mapping_id string, approval_status string, approved_by string")
    ledger = ledger.withColumn("approved_date", F.lit(None).cast("date"))
    a = spark.createDataFrame([("m1", "ann", dt.date(2025, 1, 2)), ("m1", "bob", dt.date(2025, 1, 3))],
                              "mapping_id string, approved_by string, approved_date date")
    rows = sorted((r.mapping_id, r.approval_status, r.approved_by, r.updated) for r in L.approve(ledger, a).collect())
    assert rows == [("m1", "Approved", "bob", True), ("m2", "Pending", None, False)]


def test_replies_with_one_key_are_judged_apart(spark):
    good = '[{"source_node": "a", "target_column": "b", "confidence_score": 0.9}]'
    replies = spark.createDataFrame([(1, good, "T"), (1, "no json", "T"), (2, '[{"source_node": "a"}]', "T"), (3, "[]", "T")],
                                    "k int, reply string, routed_table string")
    assert [(r.k, r.source_node) for r in parse_replies(replies, ["k"]).collect()] == [(1, "a")]


def test_deep_documents_give_json_or_an_error_row():
    deep = "<a>" * 400 + "x" + "</a>" * 400
    text, err = to_json_text(f"<r>{deep}</r>")
    assert err is None and text.count('{"a"') == 400
    text, err = to_json_text("<a>" * 10_000 + "</a>" * 10_000)
    assert text is None and err or text.count('"a"') == 9_999


def test_document_ids_use_the_whole_digest(spark):
    r = spark.range(1).select(xml_id_expr(F.lit("p"), F.lit("x")).alias("i")).first()
    assert len(r.i) == len("XML-") + 64


def test_metadata_check_counts_nodes(spark):
    n = spark.createDataFrame([("/a", "a", "string"), ("/b", "", "string")], "node_path string, node_name string, data_type string")
    assert tuple(QL.metadata_check(n).first()) == (True, "", 1)
    assert tuple(QL.metadata_check(n.limit(0)).first()) == (False, "empty", 0)


def test_hot_order_of_equal_items_becomes_many_documents(spark):
    items = spark.range(20_000).select(
        F.when(F.col("id") < 19_000, 7).otherwise(F.col("id")).cast("bigint").alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
        F.lit(5).cast("bigint").alias("l_partkey"), F.lit(6).cast("bigint").alias("l_suppkey"), F.lit(1.0).alias("l_quantity"),
        F.lit(2.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.lit("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.lit("1998-01-01").cast("timestamp").alias("l_shipdate"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = testbed.order_parts(items)
        got = parts.select("o_orderkey", "part", F.size("recs").alias("n"), F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    hot = [r for r in got if r.o_orderkey == 7]
    assert sum(r.n for r in got) == 20_000 and sum(r.n for r in hot) == 19_000
    assert max(r.n for r in hot) <= testbed.RECORDS_PER_PART + 1 and len(hot) > 1000
    assert len({r.p for r in hot}) >= 8


def test_records_are_joined_where_they_were_grouped(spark):
    """Whole and split orders, orders without line items, and null keys keep their documents."""
    items = spark.range(60).select(
        F.when(F.col("id") < 40, 7).when(F.col("id") < 58, F.col("id")).cast("bigint").alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
        F.when(F.col("id") != 50, 5).cast("bigint").alias("l_partkey"), F.lit(6).cast("bigint").alias("l_suppkey"), F.lit(1.0).alias("l_quantity"),
        F.lit(2.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.lit("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.lit("1998-01-01").cast("timestamp").alias("l_shipdate"))
    orders = spark.createDataFrame([(7, "a"), (41, "b"), (41, "again"), (50, "c"), (900, "no lines"), (None, "null")], "o_orderkey long, name string")
    split = testbed.split_orders(items)
    assert [tuple(r) for r in split.collect()] == [(7, 3)]  # the null key is no order
    docs = testbed.parts_of_orders(orders, items, split, keep_empty=True)
    got = sorted((r.name, str(r.part), r.n) for r in docs.select("name", "part", F.coalesce(F.size("recs"), F.lit(0)).alias("n")).collect() if r.name != "a")
    none = [n for *_, n in got if n <= 0]
    assert [g[:2] for g in got] == [("again", "0"), ("b", "0"), ("c", "None"), ("no lines", "0"), ("null", "0")] and len(none) == 2
    assert docs.where("name = 'a'").agg(F.sum(F.size("recs")), F.count("part")).first() == (40, 3)
    assert testbed.parts_of_orders(orders, items, split, keep_empty=False).where("recs IS NULL").count() == 0


def test_records_are_sorted_without_an_interpreted_comparison(spark):
    import datetime as dt
    from docmap.sources import testbed
    rows = [(1, n, 5, s, q, 1.0, 0.0, 0.0, "A", f, dt.datetime(2000, 1, 1)) for n, s, q, f in
            [(2, 7, 1.0, "F"), (1, 7, None, "F"), (1, 7, 1.0, None), (1, 6, 1.0, "F"), (1, 7, 1.0, "F")]]
    items = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double,"
                                  "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    parts = testbed.order_parts(items)
    assert "lambda" not in parts._jdf.queryExecution().optimizedPlan().toString()
    recs = [(r.ln, r.sk, r.t1, r.t6) for r in parts.first().recs]
    assert recs == [(1, 6, 1.0, "F"), (1, 7, None, "F"), (1, 7, 1.0, None), (1, 7, 1.0, "F"), (2, 7, 1.0, "F")]
