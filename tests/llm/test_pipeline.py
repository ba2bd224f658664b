import corpus_pipeline as C
from docmap.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "sentence_dedup", "packing"]
    for name, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    pieces = C.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(ids)


def test_run_equals_the_stages(spark):
    total = C.run(spark, SF).agg({"length": "sum"}).first()[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.agg({"length": "sum"}).first()[0] == total > 0
