"""Mapping contract, control tables and logs, generic files, view ids, numbering across ranges, golden scores."""

import json

import pytest
from pyspark.sql import functions as F

from docmap.operators import detect as D
from docmap.operators import extract as X
from docmap.operators import lifecycle as L
from docmap.operators import quality as QL
from docmap.operators import references as R
from docmap.operators.cost import row_number_within
from docmap.operators.predict import split_by_contract
from docmap.schemas import CONTROL_TABLES
from docmap.sources import sinks as K
from docmap.sources.catalog import create_tables

GOOD = {"source_node": "/a", "target_table": "T", "target_column": "c", "transformation_logic": None, "confidence_score": 0.5,
        "reasoning": ""}


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"notes": "x"}, "extra: notes"), ({"reasoning": ...}, "missing: reasoning"), ({"source_node": None}, "null field"),
    ({"confidence_score": 1.5}, "confidence outside 0 to 1"), ({"confidence_score": "high"}, "confidence outside 0 to 1"),
])
def test_contract(spark, change, reason):
    m = {k: v for k, v in {**GOOD, **change}.items() if v is not ...}
    df = spark.createDataFrame([(1, json.dumps(m)), (2, None), (3, "[1]")], "k int, m string")
    good, bad = split_by_contract(df, "m", ["k"])
    assert {r.k: r.reason for r in bad.collect()} == {2: "not an object", 3: "not an object"} | ({1: reason} if reason else {})
    assert [(r.k, r.target_column, r.confidence_score) for r in good.collect()] == ([] if reason else [(1, "c", 0.5)])


def test_control_tables_and_logs(spark, tmpdir_path):
    create_tables(spark, tmpdir_path, {"LOGPOL": [("policy_number", "STRING")]})
    try:
        create_tables(spark, tmpdir_path, {"LOGPOL": [("policy_number", "STRING")]})  # already there
        results = spark.createDataFrame([("x1", "B", True), ("x1", "A", True), ("x1", "C", False), ("x2", "A", False)],
                                        "xml_id string, target_table string, ok boolean")
        K.log_execution(L.execution_record(results))
        K.log_execution(L.execution_record(results.where("xml_id = 'x2'")))
        rows = sorted((r.xml_id, r.tables_succeeded, r.tables_failed, r.status) for r in spark.table("execution_log").collect())
        assert rows == [("x1", "A,B", "C", "Partial"), ("x2", "", "A", "Failed"), ("x2", "", "A", "Failed")]
        s = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
        K.log_reconciliation(QL.reconcile(s, s.where("k = 1"), ["k"], ["v"]))
        r = spark.table("reconciliation_log").first()
        assert (r.source_count, r.missing_in_target, r.status) == (2, 1, "DIFFERENCES") and "keys_compared" in r.details
        assert spark.table("bronze_documents").count() == 0
    finally:
        for t in [*CONTROL_TABLES, "silver_logpol"]:
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_generic_file_for_products_without_any(spark):
    files = spark.createDataFrame([("pa001_history.csv",), ("other.csv",)], "file_name string")
    out = R.with_generic_file(R.file_relevance(files, fuzzy=False), ["PA001", "HO003"], "all.csv")
    assert {(r.product_code, r.file_name, r.is_generic) for r in out.collect()} == {
        ("PA001", "pa001_history.csv", False), ("HO003", "all.csv", True)}


def test_view_starts_with_its_document_id(spark):
    docs = spark.createDataFrame([("XML-1", "<Session><A> x </A></Session>")], "xml_id string, raw_xml string")
    m = [X.CompiledMapping("a", "/Session/A", None, "STRING"), X.CompiledMapping("b", "/Session/B", None, "STRING")]
    v = X.string_view(docs, m, empty_as_blank=True)
    assert v.columns == ["SOURCE_XML_ID", "a", "b"] and tuple(v.first()) == ("XML-1", " x ", "")


def test_bad_transformations_are_named_once(spark):
    m = spark.createDataFrame([("a", "UPPER(value)"), ("b", "drop table x"), ("c", None), ("d", "drop table x")],
                              "target_column string, transformation_logic string")
    got = {r.target_column: r.transform_error for r in X.quarantine_transforms(m).collect()}
    assert got["a"] is None and got["c"] is None and got["b"] and got["b"] == got["d"]


def test_numbers_run_on_across_range_partitions(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), "id")
    got = row_number_within(df, ["g"], ["id"], "rn", partitions=7)
    by = {}
    for r in got.collect():
        by.setdefault(r.g, []).append((r.id, r.rn))
    assert len(by) == 41
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
    everything = row_number_within(df.withColumn("g", F.lit("one")), ["g"], ["id"], "rn", partitions=5)
    assert everything.where("rn != id + 1").count() == 0


def test_first_per_group_keeps_columns_and_order(spark):
    df = spark.createDataFrame([("k", 2, "b", 9), ("k", 1, "a", 8), ("j", 5, "c", 7)], "key string, ord int, v string, w int")
    out = R.first_per_group(df, ["key"], ["ord"])
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [("j", 5, "c", 7), ("k", 1, "a", 8)]


def test_maximum_scores_of_the_products():
    assert [D.max_score(p) for p in D.PRODUCTS] == [26.5, 24.5, 19.0, 17.0, 19.0]


@pytest.mark.parametrize("raw,product,score", [
    ("<S><Vehicle/><Driver/><VIN/><Make/><Model/><VehicleInfo/><T>automobile car</T></S>", "PA001", 0.6792),
    ("<S><Dwelling/><PropertyDetails/><BuildingYear/><ConstructionType/><Occupanc/><T>homeowner residence house</T></S>", "HO003", 0.6735),
    ("<S><CommercialBuilding/><BusinessName/><T>office</T></S>", "CP001", 0.3684),
])
def test_golden_scores(spark, raw, product, score):
    docs = spark.createDataFrame([(1, raw)], "k int, raw_xml string")
    r = D.detect_products(docs, ["k"]).first()
    assert r.product_code == product and round(r.confidence, 4) == score
