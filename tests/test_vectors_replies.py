"""Vector top-k (M7), reply parsing (M6, M10), routing and prediction."""

import numpy as np
from pyspark.sql import functions as F

from docmap.operators import predict as P
from docmap.operators.vectors import cosine_topk


def test_cosine_topk_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    src = rng.normal(size=(40, 8)).astype("float32")
    tgt = rng.normal(size=(90, 8)).astype("float32")
    tgt[5] = tgt[6]  # a tie: broken by target id
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(src)], "vec_id long, embedding array<float>")
    t = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(tgt)], "vec_id long, embedding array<float>")
    got = {}
    for r in cosine_topk(s, t, k=4, block_rows=16).collect():
        got.setdefault(r.src_id, []).append((r.rank, r.tgt_id))
    scores = src.astype(np.float64) @ tgt.astype(np.float64).T
    for i in range(len(src)):
        order = sorted(range(len(tgt)), key=lambda j: (-scores[i, j], j))[:4]
        assert [t_ for _, t_ in sorted(got[i])] == [1000 + j for j in order]


def test_parse_replies(spark):
    good = '[{"source_node": "/a", "target_column": "c", "confidence_score": 0.8}]'
    replies = spark.createDataFrame([
        ("r1", "```json\n" + good + "\n```", "POLICY"),
        ("r2", '{"mappings": ' + good + "}", "RISK"),
        ("r3", '{"mapping": [{"source_node": "/a", "target_column": "c"}, {"source_node": "/b"}]}', "POLICY"),
        ("r4", "not json", "POLICY"),
        ("r5", '[{"source_node": "/a", "target_column": "c", "confidence_score": 1.5}]', "POLICY"),
        ("r6", '[{"source_node": "/a", "target_column": "c", "target_table": "OTHER"}]', "QUOTE")],
        "rid string, reply string, routed_table string")
    rows = {r.rid: r for r in P.parse_replies(replies, ["rid"]).collect()}
    assert set(rows) == {"r1", "r2", "r6"}
    assert rows["r1"].confidence_score == 0.8 and rows["r6"].confidence_score == 0.5
    assert rows["r2"].target_table == "RISK" and rows["r6"].target_table == "QUOTE" and rows["r6"].reasoning == ""


def test_sections_routing_prediction(spark):
    nodes = spark.createDataFrame([(1, "/Session/Data/PolicyInfo/Number", None), (2, None, "/Session/Account/Name"),
                                   (3, "/Session/Misc/X", None), (4, None, None)],
                                  "node_ord int, node_path string, xpath string")
    n = P.normalize_nodes(nodes)
    r = {x.node_ord: x for x in n.withColumn("section", P.section_of(F.col("xpath")))
         .withColumn("t", P.route_table(F.col("section"), ["POLICY", "CUSTOMER"])).collect()}
    assert r[1].section == "PolicyInfo" and r[1].t == "POLICY"
    assert r[2].section == "Account" and r[2].t == "POLICY"   # ACCOUNT not available: first table
    assert r[3].section == "General" and r[4].xpath == "" and r[4].data_type == "string"
    hist = spark.createDataFrame([("/Session/Data/PolicyInfo/Number", "POLICY", "policy_number"),
                                  ("/Other/Name", "CUSTOMER", "name")], "source_node string, target_table string, target_column string")
    paths = spark.createDataFrame([("/Session/Data/PolicyInfo/Number",), ("/Session/Account/Name",), ("/Z/Q",)], "xpath string")
    pr = {x.source_node: (x.target_column, x.confidence_score) for x in P.predict(paths, hist).collect()}
    assert pr == {"/Session/Data/PolicyInfo/Number": ("policy_number", 0.95), "/Session/Account/Name": ("name", 0.90)}


def test_ranks_are_fused_by_weight(spark):
    rows = [(1, 10, "vector", 1), (1, 11, "vector", 2), (1, 11, "name", 1), (1, 10, "name", 2), (1, 12, "other", 1), (2, 10, "name", 3)]
    ranked = spark.createDataFrame(rows, "src_id int, tgt_id int, `by` string, rank int")

    def order(**weights):
        return [r.tgt_id for r in P.fuse_ranks(ranked, weights).where("src_id = 1").orderBy("fused_rank").collect()]
    assert order(vector=1.0, name=1.0) == [10, 11, 12]  # a tie goes to the smaller target
    assert order(vector=1.0, name=2.0) == [11, 10, 12] and order(other=1.0) == [12, 10, 11]
    assert P.fuse_ranks(ranked.limit(0), {"vector": 1.0}).count() == 0


def test_neighbours_reranked_by_name_feed_the_prediction(spark):
    near = spark.createDataFrame([(1, 20, 1), (1, 21, 2), (2, 21, 1)], "src_id int, tgt_id int, rank int")
    src = spark.createDataFrame([(1, "/S/Policy/PolicyNumber"), (2, "/S/x/Other"), (3, "/S/none")], "src_id int, xpath string")
    tgt = spark.createDataFrame([(20, "POLICY", "total_premium"), (21, "POLICY", "policy_number")], "tgt_id int, target_table string, column_name string")
    r = P.rerank_neighbours(near, src, tgt, name_weight=2.0)
    best = {x.src_id: (x.target_column, x.vector_rank, x.name_rank) for x in r.where("fused_rank = 1").collect()}
    assert best == {1: ("policy_number", 2, 1), 2: ("policy_number", 1, 1)}
    top = {x.src_id: x.confidence_score for x in r.where("fused_rank = 1").collect()}
    assert abs(top[2] - 0.9) < 1e-9 and 0.85 < top[1] < 0.9
    hist = spark.createDataFrame([("/S/x/Other", "RISK", "known")], "source_node string, target_table string, target_column string")
    got = {x.source_node: (x.target_column, x.reasoning) for x in P.predict(src.select("xpath"), hist, fused=r).collect()}
    assert got == {"/S/Policy/PolicyNumber": ("policy_number", "vector and name ranks"), "/S/x/Other": ("known", "history: same path")}
