"""Reference files read from bytes (S7-S9), incremental landing (S2), ledger snapshots (L3), load status."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmap.operators import lifecycle as L
from docmap.operators import snapshots as S
from docmap.sources import reference_files as RF
from docmap.streaming.inbox import file_versions, run_inbox

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType()), T.StructField("c", T.StringType())])


def write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def test_files_of_every_kind_in_one_plan(spark, tmpdir_path):
    kinds = {
        "comma.csv": b"a,b,c\nx,1,\"p,q\"\ny,2,z\n", "semi.csv": "é;2;u\r\nw;3;v\r\n".encode("latin-1"), "tab.txt": b"a\tb\tc\n\n1x\t2\t\n",
        "pipe.csv": "﻿name|size|kind\nm|4|ü\nm|x|ü\n".encode(), "bad.csv": b"a,b,c\n1,2,3\n" + b"4,5,6\n" * 20 + b"7,8,9,10\n7,8\n", "empty.csv": b""}
    for n, data in kinds.items():
        write(f"{tmpdir_path}/{n}", data)
    lines = RF.file_lines(RF.reference_bytes(spark, tmpdir_path))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    found = {r[0]: tuple(r)[1:] for r in lines.select(name, "encoding", "delimiter", "has_header").collect()}
    assert found == {"comma.csv": ("UTF-8", ",", True), "semi.csv": ("ISO-8859-1", ";", False), "tab.txt": ("UTF-8", "\t", True),
                     "pipe.csv": ("UTF-8", "|", True), "bad.csv": ("UTF-8", ",", True)}  # an empty file has no lines
    rows = RF.parsed_lines(lines, SCHEMA).withColumn("n", name)
    good = sorted((r.n, *r.record) for r in rows.where("malformed IS NULL AND n <> 'bad.csv'").collect())
    assert good == [("comma.csv", "x", 1, "p,q"), ("comma.csv", "y", 2, "z"), ("pipe.csv", "m", 4, "ü"), ("semi.csv", "w", 3, "v"),
                    ("semi.csv", "é", 2, "u"), ("tab.txt", "1x", 2, None)]
    assert sorted(r.malformed for r in rows.where("malformed IS NOT NULL").collect()) == ["7,8", "7,8,9,10", "m|x|ü"]
    assert "InMemoryRelation" not in rows._jdf.queryExecution().optimizedPlan().toString()  # nothing is cached
    assert rows.where("n = 'bad.csv' AND malformed IS NULL").count() == 21


def test_given_separator_and_header_are_not_guessed(spark, tmpdir_path):
    write(f"{tmpdir_path}/x.csv", b"1;2;3\n4;5;6\n")
    good, bad = RF.read_delimited(spark, f"{tmpdir_path}/x.csv", SCHEMA, sep=";", header=False)
    assert sorted(tuple(r) for r in good.collect()) == [("1", 2, "3", "x.csv"), ("4", 5, "6", "x.csv")] and bad.count() == 0
    good, bad = RF.read_delimited(spark, f"{tmpdir_path}/x.csv", SCHEMA)
    assert good.count() == 0 and [tuple(r) for r in bad.collect()] == [("x.csv", "4;5;6")]


def test_a_batch_that_runs_again_adds_nothing(spark, tmpdir_path):
    inbox, bronze, ckpt = (os.path.join(tmpdir_path, x) for x in ("in", "bronze", "ckpt"))
    os.makedirs(inbox)
    write(f"{inbox}/a.xml", b"<S>1</S>")
    write(f"{inbox}/b.xml", b"<S>2</S>")
    run_inbox(spark, inbox, bronze, ckpt)
    before = sorted(tuple(r) for r in spark.read.parquet(bronze).select("xml_id", "file_name", "raw_xml").collect())
    for f in os.listdir(f"{ckpt}/commits"):  # landed, but the crash came before the commit
        os.remove(f"{ckpt}/commits/{f}")
    run_inbox(spark, inbox, bronze, ckpt)
    assert sorted(tuple(r) for r in spark.read.parquet(bronze).select("xml_id", "file_name", "raw_xml").collect()) == before and len(before) == 2
    os.makedirs(f"{inbox}/later")
    write(f"{inbox}/later/a.xml", b"<S>changed</S>")
    run_inbox(spark, inbox, bronze, ckpt, recursive=True)
    rows = sorted((r.file_name, r.version, r.is_current, r.raw_xml) for r in file_versions(spark.read.parquet(bronze)).collect())
    assert rows == [("a.xml", 1, False, "<S>1</S>"), ("a.xml", 2, True, "<S>changed</S>"), ("b.xml", 1, True, "<S>2</S>")]


def test_many_small_files_are_one_batch(spark, tmpdir_path):
    inbox, bronze, ckpt = (os.path.join(tmpdir_path, x) for x in ("in", "bronze", "ckpt"))
    os.makedirs(inbox)
    for i in range(1100):
        write(f"{inbox}/{i}.xml", b"<S>%d</S>" % i)
    run_inbox(spark, inbox, bronze, ckpt)
    assert [d for d in os.listdir(bronze) if "=" in d] == ["batch_id=0"] and spark.read.parquet(bronze).count() == 1100
    run_inbox(spark, inbox, f"{bronze}-by-number", f"{ckpt}-by-number", max_files_per_trigger=600)
    assert sorted(d for d in os.listdir(f"{bronze}-by-number") if "=" in d) == ["batch_id=0", "batch_id=1"]


def test_files_are_dropped_by_many_tasks(spark, tmpdir_path):
    from docmap.plans.source_queries import _drop_into
    files = spark.range(60).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.lit("<S/>").alias("value"))
    _drop_into(files, tmpdir_path, 1)
    made = [f for _, _, names in os.walk(f"{tmpdir_path}/drop=1") for f in names if f.startswith("part-")]
    assert len(made) == 60 and len({f.split("-")[1] for f in made}) > 1


def test_dropped_files_share_folders_and_hold_their_text(spark, tmpdir_path):
    from docmap.plans.source_queries import DROP_FOLDERS, _drop_into
    files = spark.range(600).select(F.format_string("f%d.xml", "id").alias("file"), F.when(F.col("id") > 0, F.format_string("<S>é%d</S>", "id")).alias("value"))
    _drop_into(files, tmpdir_path, 2)
    _drop_into(files, tmpdir_path, 2)  # tasks that run again put the same files in place
    found = [(at, f) for at, _, names in os.walk(f"{tmpdir_path}/drop=2") for f in names]
    assert len({at for at, _ in found}) <= DROP_FOLDERS < len(found) == 600  # no folder, checksum or hidden rest per file
    text = {f.split("-", 2)[2]: open(f"{at}/{f}", encoding="utf-8").read() for at, f in found}
    assert text == {"f0.xml": "\n"} | {f"f{i}.xml": f"<S>é{i}</S>\n" for i in range(1, 600)}


def test_small_files_are_landed_by_few_tasks(spark, tmpdir_path):
    inbox, bronze, ckpt = (os.path.join(tmpdir_path, x) for x in ("in", "bronze", "ckpt"))
    os.makedirs(inbox)
    for i in range(1100):
        write(f"{inbox}/{i}.xml", b"<S>%d</S>" % i)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    run_inbox(spark, inbox, bronze, ckpt)
    parts = [f for f in os.listdir(f"{bronze}/batch_id=0") if f.endswith(".parquet")]
    assert len(parts) <= 2 * spark.sparkContext.defaultParallelism and spark.read.parquet(bronze).count() == 1100
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost  # the session's own setting is back


def ledger(spark, n=200):
    return spark.range(n).select(F.col("id").alias("k"), F.lit("Pending").alias("status"), F.lit(None).cast("string").alias("note"))


def test_update_writes_only_the_buckets_it_touches(spark, tmpdir_path):
    path, bucket = f"{tmpdir_path}/led", S.hash_bucket(["k"], 16)
    S.create_snapshot(ledger(spark), path, bucket)
    up = spark.createDataFrame([(3, "Approved", None), (3, "Approved", "again"), (77, None, "x"), (9999, "Approved", "no such row")], "k long, status string, note string")
    held = {r.bucket: (r.version, r.written) for r in S.update_snapshot(spark, path, up, ["k"], ["status", "note"], bucket).collect()}
    assert len(held) == 16 and 1 <= sum(w for _, w in held.values()) <= 3 and all((v == 1) == w for v, w in held.values())
    folders = {int(d.split("=")[1]) for d in os.listdir(f"{path}/data-1") if "=" in d}
    assert folders == {b for b, (_, w) in held.items() if w}  # the others are linked
    cols = ["k", "status", "note"]
    want = sorted(map(str, L.apply_updates(ledger(spark), up, ["k"], ["status", "note"]).select(cols).collect()))
    assert sorted(map(str, S.read_snapshot(spark, path).select(cols).collect())) == want
    assert S.read_snapshot(spark, path, 0).where("status = 'Approved'").count() == 0  # the old version is as it was
    assert S.versions(spark, path) == [0, 1]


def test_an_update_that_died_leaves_the_last_version(spark, tmpdir_path):
    path, bucket = f"{tmpdir_path}/led", F.pmod(F.col("k"), F.lit(4)).cast("int")
    S.create_snapshot(ledger(spark, 20), path, bucket)
    os.makedirs(f"{path}/data-1/{S.BUCKET}=1")
    write(f"{path}/data-1/{S.BUCKET}=1/part-0.parquet", b"half a file")  # no manifest was written
    assert S.versions(spark, path) == [0] and S.read_snapshot(spark, path).count() == 20
    up = spark.createDataFrame([(1, "Rejected")], "k long, status string")
    S.update_snapshot(spark, path, up, ["k"], ["status"], bucket)
    assert S.read_snapshot(spark, path).where("status = 'Rejected'").count() == 1 and S.read_snapshot(spark, path).count() == 20
    none = S.update_snapshot(spark, path, up.limit(0), ["k"], ["status"], bucket)
    assert none.where("written").count() == 0 and S.read_snapshot(spark, path).count() == 20
