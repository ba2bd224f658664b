"""Sinks (K1, K2, K4-K6, K8), catalog and file sources (S9, S10, S13, S17), Q6, Q7, X15 quarantine."""

import json
import os

from pyspark.sql import functions as F

from docmap.operators.extract import quarantine_transforms
from docmap.operators.quality import extraction_coverage, metadata_check
from docmap.sources import reference_files as RF
from docmap.sources import sinks as K
from docmap.sources.bronze import file_registry, land_documents, read_xml_files
from docmap.sources.catalog import catalog_from_spark, create_tables

MAPS = [("/a", "POLICY", "a", None, 0.9, "r1"), ("/b", "POLICY", "b", "TO_DATE(value)", 0.4, "r2")]
MSCHEMA = ("source_node string, target_table string, target_column string, transformation_logic string, "
           "confidence_score double, reasoning string")


def test_mapping_files(spark, tmpdir_path):
    m = spark.createDataFrame(MAPS, MSCHEMA)
    K.write_mappings_csv(m, os.path.join(tmpdir_path, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv")).orderBy("source_node").collect()
    assert [r.transformation_logic for r in back] == [None, "TO_DATE(value)"] or \
        [r.transformation_logic for r in back] == ["", "TO_DATE(value)"]
    K.write_mappings_json(m, os.path.join(tmpdir_path, "json"))
    assert spark.read.json(os.path.join(tmpdir_path, "json")).count() == 2


def test_silver_tables_append_and_views(spark, tmpdir_path):
    create_tables(spark, tmpdir_path, {"TESTPOL": [("policy_number", "STRING"), ("premium", "DECIMAL(15,2)")]})
    rows = spark.createDataFrame([("P1",)], "policy_number string")
    K.append_silver(rows, "silver_testpol")
    got = spark.table("silver_testpol").collect()
    assert len(got) == 1 and got[0].premium is None
    cat = catalog_from_spark(spark)
    assert "premium" in [r.column_name for r in cat.where(F.col("table_name").endswith("SILVER_TESTPOL")).collect()]
    name = K.register_view(rows, "testpol")
    assert spark.table(name).count() == 1
    ids = spark.createDataFrame([("XML-a-1",)], "xml_id string")
    v = K.view_definitions(ids, "POLICY", "select 1").first()
    assert v.view_name == "POLICY_VW_XML_a_1" and v.is_active


def test_registry_and_directory_scan(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "docs")
    os.makedirs(d)
    for i in range(3):
        with open(os.path.join(d, f"f{i}.xml"), "w") as f:
            f.write(f"<?xml version=\"1.0\"?>\n<Session>\n<A>{i}</A>\n</Session>\n")
    files = read_xml_files(spark, d)
    assert files.count() == 3 and all(r.raw_xml.count("\n") == 4 for r in files.collect())
    b = land_documents(files, uploaded_by="u", product_code="PA001")
    reg = file_registry(b).collect()
    assert len({r.xml_id for r in reg}) == 3 and all(r.product_code == "PA001" for r in reg)
    # same path and content -> same id (deterministic landing)
    assert sorted(r.xml_id for r in land_documents(read_xml_files(spark, d)).collect()) == sorted(r.xml_id for r in reg)


def test_encodings_and_json_reference(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "u.txt"), "wb") as f:
        f.write("café".encode("utf-8"))
    with open(os.path.join(tmpdir_path, "l.txt"), "wb") as f:
        f.write("café".encode("latin-1"))
    got = {os.path.basename(r.path): (r.text, r.encoding) for r in RF.decode_files(spark, tmpdir_path + "/*.txt").collect()}
    assert got["u.txt"] == ("café", "UTF-8") and got["l.txt"] == ("café", "ISO-8859-1")
    p = os.path.join(tmpdir_path, "ref.json")
    with open(p, "w") as f:
        json.dump([{"source_node": "/a", "confidence": True}, {"source_node": "/b", "confidence": False}], f, indent=2)
    assert RF.read_json_reference(spark, p).count() == 2


def test_metadata_check(spark):
    nodes = spark.createDataFrame([("/a", "a", "string")], "node_path string, node_name string, data_type string")
    assert metadata_check(nodes).first().valid
    assert not metadata_check(nodes.limit(0)).first().valid
    assert metadata_check(nodes.drop("data_type")).first().missing == "data_type"


def test_transformation_quarantine(spark):
    m = spark.createDataFrame([("TO_DATE(value)",), ("value; drop table x",), (None,)], "transformation_logic string")
    r = [x.transform_error for x in quarantine_transforms(m).collect()]
    assert r[0] is None and r[1] is not None and r[2] is None
