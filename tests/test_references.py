"""Reference files: relevance, union/dedupe, fallback, classification (R1-R10), CSV sources."""

import os

from docmap.operators import references as R
from docmap.sources import reference_files as RF
from docmap.sources.catalog import catalog_from_schema, table_list


def test_file_relevance_rules(spark):
    files = spark.createDataFrame([("old_mappings_personal_auto.csv",), ("old_mappings.csv",),
                                   ("old_mappings_homeowners.csv",), ("commercial_property_pa001.csv",),
                                   ("notes.txt",)], "file_name string")
    s = {(r.file_name, r.product_code): r.score for r in R.file_relevance(files, fuzzy=False).collect()}
    assert s[("old_mappings_personal_auto.csv", "PA001")] == 5.5   # auto 2 + personal 1.5 + auto 1.5 + .5
    assert s[("old_mappings.csv", "PA001")] == 0.5
    assert s[("old_mappings_homeowners.csv", "HO003")] == 6.0     # home, homeowner, homeowners, old mapping
    assert s[("commercial_property_pa001.csv", "PA001")] == 10.0
    rel = R.relevant_files(R.file_relevance(files, fuzzy=False), None, "PA001").orderBy("file_rank").collect()
    assert [r.file_name for r in rel] == ["commercial_property_pa001.csv", "old_mappings_personal_auto.csv"]


def test_fuzzy_file_words(spark):
    files = spark.createDataFrame([("automobile-insurence-list.csv",)], "file_name string")
    exact = {r.product_code: r.score for r in R.file_relevance(files, fuzzy=False).collect()}
    fz = {r.product_code: r.score for r in R.file_relevance(files, fuzzy=True).collect()}
    # 'insurance' is not contained, but 'insurence' is a close word (ratio .89)
    assert fz["PA001"] == exact["PA001"] + 1.0


def test_union_dedupe_first_file_wins(spark):
    a = spark.createDataFrame([("/a", "c1", "x", 0), ("/b", "c2", "y", 1)], "source_node string, target_column string, v string, ord int")
    b = spark.createDataFrame([("/a", "c1", "z", 0), ("/c", "c3", "w", 1)], "source_node string, target_column string, v string, ord int")
    u = R.union_ranked([("b.csv", 2, b), ("a.csv", 1, a)])
    got = {(r.source_node, r.v, r.source_file) for r in R.dedupe_mappings(u, ["ord"]).collect()}
    assert got == {("/a", "x", "a.csv"), ("/b", "y", "a.csv"), ("/c", "w", "b.csv")}


def test_fallback(spark):
    rows = spark.createDataFrame([(1, "PA001"), (2, "HO003"), (3, None)], "id int, product_code string")
    got = sorted((r.requested_product, r.id, r.is_fallback) for r in R.with_fallback(rows, ["PA001", "WC001"]).collect())
    assert got == [("PA001", 1, False), ("WC001", 1, True), ("WC001", 2, True), ("WC001", 3, True)]


def test_classify_and_top_per_category(spark):
    names = [f"old_mappings_personal_auto_{i}.csv" for i in range(5)] + ["data_dictionary_home.csv", "readme.md"]
    files = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file_name string, row_count int")
    c = {r.file_name: (r.category, r.relevance) for r in R.classify_files(files).collect()}
    assert c["readme.md"][0] == "not_relevant" and c["data_dictionary_home.csv"][0] == "data_dictionary"
    top = R.top_per_category(R.classify_files(files), 3).collect()
    assert sorted(r.file_name for r in top if r.category == "historical_mapping") == names[:3]
    summ = {r.category: (r.files, r.rows) for r in R.category_summary(R.top_per_category(R.classify_files(files), 3)).collect()}
    assert summ["historical_mapping"] == (3, 0 + 1 + 2)


def test_csv_quarantine_and_profile(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "old_mappings.csv")
    with open(p, "w") as f:
        f.write("source_system,source_node,source_attribute,target_table,target_column,transformation,notes,product_code\n")
        f.write("S,/Session/A,,POLICY,a,,n,PA001\n")
        f.write("S,/Session/B,,POLICY,b,CAST(value AS DECIMAL(15,2)),Decimal conversion,PA001\n")
        f.write("S,/Session/C,,RISK,c,TO_DATE(value),n,HO003\n")
    good, bad = RF.read_delimited(spark, p)
    assert good.count() == 2 and bad.count() == 1
    assert sorted(r.product_code for r in good.collect()) == ["HO003", "PA001"]
    prof = RF.load_profile(good).first()
    assert prof.row_count == 2 and prof.column_count == 8
    out = os.path.join(tmpdir_path, "clean")
    RF.write_clean_copy(good, out)
    assert spark.read.option("header", True).csv(out).count() == 2


def test_sniff_and_listing(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "a.csv"), "w") as f:
        f.write("x;y;z\n1;2;3\n4;5;6\n")
    with open(os.path.join(tmpdir_path, "b.txt"), "w") as f:
        f.write("1|2\n3|4\n")
    with open(os.path.join(tmpdir_path, "c.bin"), "w") as f:
        f.write("zz")
    s = {os.path.basename(r.file): (r.delimiter, r.has_header) for r in RF.sniff_delimiter(
        spark, [os.path.join(tmpdir_path, "a.csv"), os.path.join(tmpdir_path, "b.txt")]).collect()}
    assert s["a.csv"] == (";", True) and s["b.txt"] == ("|", False)
    lst = RF.list_reference_files(spark, tmpdir_path)
    assert sorted(r.extension for r in lst.collect()) == ["csv", "txt"]


def test_catalog(spark):
    c = catalog_from_schema(spark, {"POLICY": [("policy_number", "VARCHAR(50)"), ("premium", "DECIMAL(15,2)")],
                                    "RISK": [("n", "NUMBER(38,0)")]}, only=["silver.policy"])
    rows = c.collect()
    assert [r.formatted_data_type for r in rows] == ["VARCHAR(50)", "DECIMAL(15,2)"]
    assert [r.table for r in table_list(c).collect()] == ["POLICY"]


def test_relevant_files_top_n(spark):
    files = spark.createDataFrame([(f"old_mappings_personal_auto_{i}.csv",) for i in range(7)], "file_name string")
    top = R.relevant_files(R.file_relevance(files, fuzzy=False), max_files=3, product_code="PA001").collect()
    assert sorted(r.file_rank for r in top) == [1, 2, 3]
    assert R.relevant_files(R.file_relevance(files, fuzzy=False), max_files=None, product_code="PA001").count() == 7
