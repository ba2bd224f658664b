"""Ledger lifecycle (K3, K7, L1-L17), quality (Q1-Q14), cost and running sums."""

from decimal import Decimal

from pyspark.sql import functions as F

from docmap.operators import cost as C
from docmap.operators import lifecycle as L
from docmap.operators import quality as QL

LEDGER = [("m1", "X1", "POLICY", "Pending", "Not Started", 0.9, 1), ("m2", "X1", "RISK", "Approved", "Failed", 0.4, 2),
          ("m3", "X2", "POLICY", "Approved", "Completed", None, 3), ("m4", "X2", "RISK", "Approved", "Not Started", 0.5, 4)]
SCHEMA = "mapping_id string, xml_id string, target_table string, approval_status string, execution_status string, " \
         "confidence_score double, ord int"


def test_ids_lists_updates(spark):
    led = spark.createDataFrame(LEDGER, SCHEMA)
    ids = {r.ord: r.mapping_id for r in L.assign_mapping_ids(
        led.drop("mapping_id").withColumn("transformation_logic", F.lit(None).cast("string")), ["ord"]).collect()}
    assert ids == {1: "MAP-X1-0000", 2: "MAP-X1-0001", 3: "MAP-X2-0000", 4: "MAP-X2-0001"}
    assert [r.mapping_id for r in L.pending(led).collect()] == ["m1"]
    assert sorted(r.mapping_id for r in L.executable(led).collect()) == ["m2", "m4"]
    appr = spark.createDataFrame([("m1", "ann", None)], "mapping_id string, approved_by string, user_notes string")
    a = {r.mapping_id: r for r in L.approve(led.withColumn("approved_by", F.lit(None).cast("string"))
                                            .withColumn("user_notes", F.lit("old")), appr).collect()}
    assert a["m1"].approval_status == "Approved" and a["m1"].approved_by == "ann" and a["m1"].user_notes == "old"
    assert a["m2"].updated is False
    rj = {r.mapping_id: r.approval_status for r in L.reject_documents(
        led, spark.createDataFrame([("X2",)], "xml_id string")).collect()}
    assert rj == {"m1": "Pending", "m2": "Approved", "m3": "Rejected", "m4": "Rejected"}


def test_run_status_and_summaries(spark):
    res = spark.createDataFrame([("X1", "POLICY", True), ("X1", "RISK", False), ("X2", "POLICY", True),
                                 ("X3", "RISK", False)], "xml_id string, target_table string, ok boolean")
    r = {x.xml_id: (x.tables_succeeded, x.tables_failed, x.status) for x in L.execution_record(res).collect()}
    assert r == {"X1": ("POLICY", "RISK", "Partial"), "X2": ("POLICY", "", "Success"), "X3": ("", "RISK", "Failed")}
    st = spark.createDataFrame([("X1", True), ("X1", False), ("X1", None)], "xml_id string, processed boolean")
    s = L.staging_status(st).first()
    assert (s.total, s.processed, s.pending) == (3, 1, 1)
    led = spark.createDataFrame(LEDGER, SCHEMA)
    stats = QL.confidence_stats(led).first()
    assert stats.total == 4 and stats.high_confidence == 1 and stats.low_confidence == 1
    issues = QL.mapping_issues(led.withColumn("source_node", F.lit("/a")).withColumn("target_column", F.lit("c"))
                               .withColumn("source_data_type", F.lit("string")).withColumn("target_data_type", F.lit("DATE"))
                               .withColumn("transformation_logic", F.lit(None).cast("string")))
    msgs = sorted(r.message for r in issues.collect())
    assert "Low confidence (0.00) for /a → c" in msgs and "Low confidence (0.40) for /a → c" in msgs
    assert "Type mismatch without transformation: string → date" in msgs


def test_latest_and_choose_stage(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "id int, t int")
    assert [r.id for r in L.latest(df, "t", ["id"], 3).collect()] == [17, 14, 11]
    common = spark.createDataFrame([(1, "X1")], "staging_id int, xml_id string")
    per = spark.createDataFrame([(2, "X1"), (3, "X2")], "staging_id int, xml_id string")
    got = sorted((r.staging_id, r.stage_name) for r in L.choose_stage(common, per).collect())
    assert got == [(1, "common"), (3, "document")]


def test_reconcile_with_planted_differences(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, v string")
    tgt = spark.createDataFrame([(1, "a"), (2, "B"), (4, None), (5, "e")], "k int, v string")
    r = QL.reconcile(src, tgt, ["k"], ["v"]).first()
    assert (r.source_count, r.target_count, r.match_count, r.mismatch_count, r.missing_in_target,
            r.extra_in_target, r.status) == (4, 4, 2, 1, 1, 1, "DIFFERENCES")


def test_dictionary_summary(spark):
    cat = spark.createDataFrame([("T", "a", "int"), ("T", "b", "int"), ("T", "c", "date")],
                                "table_name string, column_name string, data_type string")
    d = QL.dictionary_summary(cat).first()
    assert d.column_count == 3 and d.type_histogram == "date=1,int=2"


def test_cost_and_running_sum(spark):
    calls = spark.createDataFrame([(i, i % 7, 271 + i) for i in range(200)], "id long, ts long, nodes int")
    est = C.estimate_cost(calls, F.col("nodes"), F.lit(137), F.lit(0))
    one = est.where("id = 0").first()
    assert one.input_tokens == 271 * 50 + 137 * 40 + 500 and one.output_tokens == 137 * 80
    assert one.input_cost == Decimal("0.04882500") and one.total_cost == Decimal("0.04882500") + Decimal("0.10960000")
    r = C.running_sum(est.select("id", "ts", "total_cost"), ["ts", "id"], "total_cost", partitions=5)
    pdf = est.select("id", "ts", "total_cost").toPandas().sort_values(["ts", "id"])
    pdf["cum"] = pdf["total_cost"].cumsum()
    got = {x.id: x.cumulative for x in r.collect()}
    assert all(got[i] == c for i, c in zip(pdf["id"], pdf["cum"]))
    s = C.usage_summary(est).first()
    assert s.calls == 200 and s.total_cost == pdf["total_cost"].sum()


def test_row_number_within_hot_group(spark):
    from pyspark.sql import Window
    # one group holds most rows; result must equal a plain window row_number
    rows = [("hot" if i % 10 else f"g{i % 7}", i, (i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    got = {r.id: r.rn for r in C.row_number_within(df, ["g"], ["v", "id"], "rn", partitions=6).collect()}
    w = Window.partitionBy("g").orderBy("v", "id")
    exp = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == exp


def test_partitions_for(spark):
    from docmap.session import partitions_for
    floor = 2 * spark.sparkContext.defaultParallelism
    small = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert partitions_for(small) == floor
    assert partitions_for(small, bytes_per_partition=1024, expansion=10) > floor


def test_reconcile_groups_exact_values_as_they_are(spark):
    s = spark.createDataFrame([(1, Decimal("1.00"), 2), (1, None, 2), (2, Decimal("3.50"), None)], "k int, v decimal(9,2), w int")
    t = spark.createDataFrame([(1, Decimal("1.00"), 2), (1, None, 2), (2, Decimal("3.60"), None)], "k int, v decimal(9,2), w int")
    plan = QL.key_differences(s, t, ["k"], ["v", "w"])._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan.lower() and "structstojson" not in plan.lower()
    r = QL.reconcile(s, t, ["k"], ["v", "w"]).first()
    assert (r.match_count, r.mismatch_count, r.status) == (2, 1, "DIFFERENCES")
    assert '{\\"v\\":3.50,\\"w\\":null}' in r.details.toJson()
    # types that differ, and numbers that are equal but not written alike, are compared as text
    d = s.select("k", F.col("v").cast("decimal(9,3)").alias("v"), "w")
    assert QL.reconcile(s.where("v = 1"), d.where("v = 1"), ["k"], ["v"]).first().match_count == 0
    zero = spark.sql("SELECT 1 AS k, 0.0D AS v")
    assert QL.reconcile(zero, zero.selectExpr("k", "-v AS v"), ["k"], ["v"]).first().match_count == 0
