"""Registered queries over the mapping ledger (one mapping row per line item)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmap.functions.types import name_rule_col
from docmap.operators import lifecycle as L
from docmap.operators import quality as QL
from docmap.operators.extract import bronze_missing, first_wins
from docmap.operators.predict import normalize_nodes, route_table, section_of
from docmap.operators.references import dedupe_mappings, with_fallback
from docmap.plans import sqlparts as Q
from docmap.plans.queries import query
from docmap.schemas import SILVER
from docmap.sources.testbed import LEDGER_ORDER, bronze_documents, mapping_ledger, read_table

_LEDGER = Q.with_ctes(Q.LEDGER_CTE)
_ORD = ", ".join(LEDGER_ORDER)


def _ledger(spark, sf):
    return mapping_ledger(spark, sf)


@query("mapping_first_wins", _LEDGER + f"""
SELECT xml_id, target_table, target_column, mapping_id, source_node FROM (
  SELECT *, row_number() OVER (PARTITION BY xml_id, target_table, target_column ORDER BY {_ORD}) AS rn
  FROM ledger WHERE NOT (strpos(upper(target_column), '_ID') > 0 OR upper(target_column) = 'ID'))
WHERE rn = 1""")
def mapping_first_wins(spark, sf):
    """Surrogate keys skipped, first mapping per (document, table, column)."""
    led = _ledger(spark, sf).select("xml_id", "target_table", "target_column", "mapping_id", "source_node", *LEDGER_ORDER)
    m = first_wins(led, LEDGER_ORDER, partition=["xml_id", "target_table", "target_column"])
    return m.select("xml_id", "target_table", "target_column", "mapping_id", "source_node")


@query("bronze_missing", _LEDGER + """
SELECT DISTINCT doc_key, target_table, 'NO_BRONZE' AS status FROM ledger
WHERE doc_key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def bronze_missing_q(spark, sf):
    """X11: (document, table) pairs whose document was never landed (pending orders are not landed)."""
    landed = bronze_documents(spark, sf).join(
        read_table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey"), "o_orderkey", "left_semi")
    return bronze_missing(_ledger(spark, sf), landed.withColumnRenamed("o_orderkey", "doc_key"), key="doc_key")


@query("mapping_ids", _LEDGER + f"""
SELECT xml_id, line_no, part_key, supp_key,
       printf('MAP-%s-%04d', xml_id, row_number() OVER (PARTITION BY xml_id ORDER BY {_ORD}) - 1) AS mapping_id
FROM ledger""")
def mapping_ids(spark, sf):
    """K3: MAP-{xml_id}-{nnnn} running numbers in input order."""
    m = L.assign_mapping_ids(_ledger(spark, sf).drop("mapping_id"), LEDGER_ORDER)
    return m.select("xml_id", "line_no", "part_key", "supp_key", "mapping_id")


@query("pending_list", _LEDGER + """
SELECT mapping_id, xml_id, confidence_score FROM ledger WHERE approval_status = 'Pending'""")
def pending_list(spark, sf):
    """L1."""
    return L.pending(_ledger(spark, sf)).select("mapping_id", "xml_id", "confidence_score")


@query("executable_list", _LEDGER + """
SELECT mapping_id, xml_id, target_table, execution_status FROM ledger
WHERE approval_status = 'Approved' AND execution_status IN ('Not Started', 'Failed')""")
def executable_list(spark, sf):
    """L2."""
    return L.executable(_ledger(spark, sf)).select("mapping_id", "xml_id", "target_table", "execution_status")


@query("approve_merge", _LEDGER + """
SELECT l.mapping_id,
       CASE WHEN a.mapping_id IS NOT NULL THEN 'Approved' ELSE l.approval_status END AS approval_status,
       a.approved_by, coalesce(a.transformation_logic, l.transformation_logic) AS transformation_logic,
       a.user_notes, a.mapping_id IS NOT NULL AS updated
FROM ledger l LEFT JOIN (
  SELECT mapping_id, 'reviewer' AS approved_by,
         CASE WHEN quantity = 50 THEN 'UPPER(value)' END AS transformation_logic,
         'qty ' || quantity AS user_notes
  FROM ledger WHERE quantity >= 45) a ON a.mapping_id = l.mapping_id""")
def approve_merge(spark, sf):
    """L3: approvals merged by mapping_id (NULL fields keep the old value)."""
    led = _ledger(spark, sf)
    approvals = led.where("quantity >= 45").select(
        "mapping_id", F.lit("reviewer").alias("approved_by"),
        F.when(F.col("quantity") == 50, "UPPER(value)").alias("transformation_logic"),
        F.concat(F.lit("qty "), F.col("quantity").cast("string")).alias("user_notes"))
    led = led.withColumn("approved_by", F.lit(None).cast("string")).withColumn("user_notes", F.lit(None).cast("string"))
    return L.approve(led, approvals).select("mapping_id", "approval_status", "approved_by",
                                            "transformation_logic", "user_notes", "updated")


@query("reject_doc", _LEDGER + """
SELECT mapping_id,
       CASE WHEN o.o_orderkey IS NOT NULL THEN 'Rejected' ELSE approval_status END AS approval_status,
       o.o_orderkey IS NOT NULL AS rejected
FROM ledger l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o
  ON o.o_orderkey = l.doc_key""")
def reject_doc(spark, sf):
    """L4: every mapping of urgent-order documents is rejected, whatever its state."""
    docs = read_table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("doc_key"))
    return L.reject_documents(_ledger(spark, sf), docs, doc_col="doc_key").select(
        "mapping_id", "approval_status", "rejected")


@query("status_update", _LEDGER + """
SELECT l.mapping_id, coalesce(r.execution_status, l.execution_status) AS execution_status,
       r.last_execution_id, r.execution_error, r.xml_id IS NOT NULL AS updated
FROM ledger l LEFT JOIN (
  SELECT DISTINCT xml_id, target_table,
         CASE WHEN target_table = 'PAYMENT' THEN 'Failed' ELSE 'Completed' END AS execution_status,
         'EXEC-' || xml_id AS last_execution_id,
         CASE WHEN target_table = 'PAYMENT' THEN 'no mapped columns' END AS execution_error
  FROM ledger WHERE approval_status = 'Approved') r
  ON r.xml_id = l.xml_id AND r.target_table = l.target_table""")
def status_update(spark, sf):
    """Execution results applied by (document, target table)."""
    led = _ledger(spark, sf)
    res = (led.where("approval_status = 'Approved'").select("xml_id", "target_table").distinct()
           .select("xml_id", "target_table",
                   F.when(F.col("target_table") == "PAYMENT", "Failed").otherwise("Completed").alias("execution_status"),
                   F.concat(F.lit("EXEC-"), F.col("xml_id")).alias("last_execution_id"),
                   F.when(F.col("target_table") == "PAYMENT", "no mapped columns").alias("execution_error")))
    led = (led.withColumn("last_execution_id", F.lit(None).cast("string"))
           .withColumn("execution_error", F.lit(None).cast("string")))
    return L.update_execution(led, res).select("mapping_id", "execution_status", "last_execution_id",
                                               "execution_error", "updated")


def _runs(led):
    return led.groupBy("xml_id", "doc_key").agg(F.max("created_date").alias("executed_at"),
                                                 F.count(F.lit(1)).alias("rows_loaded"))


@query("latest_runs", _LEDGER + """
SELECT xml_id, executed_at, rows_loaded FROM (
  SELECT xml_id, doc_key, max(created_date) AS executed_at, count(*) AS rows_loaded FROM ledger GROUP BY 1, 2)
ORDER BY executed_at DESC, doc_key DESC LIMIT 10""")
def latest_runs(spark, sf):
    """The 10 newest executions (top-k report; ties broken by document key)."""
    return L.latest(_runs(_ledger(spark, sf)), "executed_at", ["doc_key"], 10).select(
        "xml_id", "executed_at", "rows_loaded")


@query("saved_views", _LEDGER + """
SELECT upper(target_table) || '_VW_' || replace(xml_id, '-', '_') AS view_name, xml_id, target_table,
       max(created_date) AS created_at
FROM ledger GROUP BY xml_id, target_table HAVING max(quantity) > 10""")
def saved_views(spark, sf):
    """Active view definitions (newest first)."""
    v = (_ledger(spark, sf).groupBy("xml_id", "target_table")
         .agg(F.max("created_date").alias("created_at"), (F.max("quantity") > 10).alias("is_active")))
    v = v.where("is_active").orderBy(F.desc("created_at"), "xml_id", "target_table")
    return v.select(F.concat(F.upper("target_table"), F.lit("_VW_"), F.regexp_replace("xml_id", "-", "_")).alias("view_name"),
                    "xml_id", "target_table", "created_at")


@query("run_status", _LEDGER + """
SELECT xml_id,
  coalesce(string_agg(DISTINCT target_table, ',' ORDER BY target_table) FILTER (WHERE execution_status = 'Completed'), '')
    AS tables_succeeded,
  coalesce(string_agg(DISTINCT target_table, ',' ORDER BY target_table) FILTER (WHERE execution_status = 'Failed'), '')
    AS tables_failed,
  CASE WHEN count(DISTINCT target_table) FILTER (WHERE execution_status = 'Failed') = 0
            AND count(DISTINCT target_table) FILTER (WHERE execution_status = 'Completed') > 0 THEN 'Success'
       WHEN count(DISTINCT target_table) FILTER (WHERE execution_status = 'Failed') > 0
            AND count(DISTINCT target_table) FILTER (WHERE execution_status = 'Completed') > 0 THEN 'Partial'
       ELSE 'Failed' END AS status
FROM ledger GROUP BY xml_id""")
def run_status_q(spark, sf):
    """Per document succeeded/failed table lists and run status."""
    led = _ledger(spark, sf)
    res = led.select("xml_id", "target_table",
                     F.when(F.col("execution_status") == "Completed", True)
                     .when(F.col("execution_status") == "Failed", False).alias("ok"))
    return L.execution_record(res).select("xml_id", "tables_succeeded", "tables_failed", "status")


def _stage(spark, sf):
    ev = read_table(spark, sf, "events")
    processed = (F.when(F.col("event_type") == "purchase", F.lit(True))
                 .when(F.col("event_type") == "error", F.lit(None).cast("boolean"))
                 .otherwise(F.col("event_id") % 2 == 0))
    return ev.select(F.col("event_id").alias("staging_id"),
                     F.concat(F.lit("XML-"), F.col("user_id").cast("string")).alias("xml_id"),
                     processed.alias("processed"), "event_type", "props")


_STAGE_SQL = """stage AS (SELECT event_id AS staging_id, 'XML-' || user_id AS xml_id,
  CASE WHEN event_type = 'purchase' THEN true WHEN event_type = 'error' THEN NULL ELSE event_id % 2 = 0 END AS processed,
  event_type, props FROM events)"""


@query("staging_status", Q.with_ctes(_STAGE_SQL) + """
SELECT xml_id, count(*) AS total, count(*) FILTER (WHERE processed) AS processed,
       count(*) FILTER (WHERE NOT processed) AS pending FROM stage GROUP BY xml_id""")
def staging_status(spark, sf):
    """Total / processed / pending per document (NULL counts as neither)."""
    return L.staging_status(_stage(spark, sf))


@query("staging_choice", Q.with_ctes(_STAGE_SQL) + """,
u AS (SELECT staging_id, xml_id, 0 AS stage_rank, 'common' AS stage_name FROM stage WHERE event_type = 'purchase'
      UNION ALL SELECT staging_id, xml_id, 1, 'document' FROM stage WHERE event_type = 'view')
SELECT staging_id, xml_id, stage_name FROM u
WHERE stage_rank = (SELECT min(stage_rank) FROM u u2 WHERE u2.xml_id = u.xml_id)""")
def staging_choice(spark, sf):
    """Common stage when it has the document, else the per-document stage."""
    s = _stage(spark, sf)
    common = s.where("event_type = 'purchase'").select("staging_id", "xml_id")
    per_doc = s.where("event_type = 'view'").select("staging_id", "xml_id")
    return L.choose_stage(common, per_doc).select("staging_id", "xml_id", "stage_name")


@query("stage_variant_view", Q.with_ctes(_STAGE_SQL) + """
SELECT CAST(staging_id AS VARCHAR) AS staging_id, xml_id, json_extract_string(props, '$.k') AS k_text,
       TRY_CAST(TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(38,0)) AS INTEGER) AS k_int
FROM stage WHERE event_type IN ('purchase', 'click') AND processed = false""")
def stage_variant_view(spark, sf):
    """JSON stage as VARIANT, view over unprocessed rows of one table."""
    from docmap.operators.xmljson import stage_rows, stage_view
    s = _stage(spark, sf)
    st = stage_rows(s, F.col("props"),
                    F.when(F.col("event_type").isin("purchase", "click"), "PAYMENT").otherwise("POLICY"),
                    F.col("staging_id"), F.col("xml_id"), F.col("processed"))
    return stage_view(st, "PAYMENT", [("/Data/k", "k_text", None), ("/Data/k", "k_int", "CAST(value AS INTEGER)")])


@query("doc_summary", _LEDGER + """
SELECT xml_id, count(*) AS mapping_count, count(DISTINCT target_table) AS table_count FROM ledger GROUP BY xml_id""")
def doc_summary(spark, sf):
    """L13."""
    return L.document_summary(_ledger(spark, sf))


@query("table_counts", _LEDGER + "SELECT target_table, count(*) AS mapping_count FROM ledger GROUP BY target_table")
def table_counts(spark, sf):
    """L14/Q5."""
    return L.table_counts(_ledger(spark, sf))


@query("distinct_counts", _LEDGER + """
SELECT count(DISTINCT target_table) AS tables, count(DISTINCT xml_id) AS documents FROM ledger""")
def distinct_counts(spark, sf):
    """Distinct target tables and documents."""
    return _ledger(spark, sf).agg(F.count_distinct("target_table").alias("tables"),
                                  F.count_distinct("xml_id").alias("documents"))


@query("confidence_stats", _LEDGER + """
SELECT target_table, count(*) AS total, CAST(avg(confidence_score) AS DECIMAL(10,4)) AS avg_confidence,
       count(*) FILTER (WHERE confidence_score >= 0.8) AS high_confidence,
       count(*) FILTER (WHERE confidence_score < 0.5) AS low_confidence
FROM ledger GROUP BY target_table""")
def confidence_stats(spark, sf):
    """Q1/Q2 per target table."""
    s = QL.confidence_stats(_ledger(spark, sf), ["target_table"])
    return s.withColumn("avg_confidence", F.col("avg_confidence").cast("decimal(10,4)"))


@query("confidence_filter", _LEDGER + """
SELECT mapping_id, target_table, confidence_score FROM ledger
WHERE target_table IN ('POLICY', 'COVERAGE') AND confidence_score >= 0.7""")
def confidence_filter(spark, sf):
    """Q3."""
    return QL.filter_mappings(_ledger(spark, sf), ["POLICY", "COVERAGE"], 0.7).select(
        "mapping_id", "target_table", "confidence_score")


@query("confidence_distribution", _LEDGER + "SELECT confidence_score, count(*) AS n FROM ledger GROUP BY 1")
def confidence_distribution(spark, sf):
    """Q4."""
    return QL.value_counts(_ledger(spark, sf), "confidence_score")


def _types_sql() -> str:
    return f"""CASE WHEN suffix(source_node, 'Date') THEN 'date' WHEN suffix(source_node, 'Number') THEN 'integer'
        WHEN source_node IS NULL THEN NULL ELSE 'string' END AS source_data_type,
  CASE ({Q_rule()}) WHEN 'boolean' THEN 'boolean' WHEN 'date' THEN 'date' WHEN 'number' THEN 'decimal'
       ELSE 'string' END AS target_data_type"""


def Q_rule():
    from docmap.plans.queries import _rule_sql
    return _rule_sql("target_column")


@query("mapping_issues", _LEDGER + f""", typed AS (SELECT *, {_types_sql()} FROM ledger)
SELECT mapping_id, 'low_confidence' AS issue_type,
       printf('Low confidence (%.2f) for %s → %s', CAST(confidence_score AS DOUBLE), coalesce(source_node, 'None'),
              coalesce(target_column, 'None')) AS message,
       'warning' AS severity FROM typed WHERE confidence_score < 0.5
UNION ALL
SELECT mapping_id, 'type_mismatch', printf('Type mismatch without transformation: %s → %s',
       lower(coalesce(source_data_type, '')), lower(coalesce(target_data_type, ''))), 'error'
FROM typed WHERE lower(coalesce(source_data_type, '')) <> lower(coalesce(target_data_type, ''))
  AND (transformation_logic IS NULL OR transformation_logic = '')""")
def mapping_issues(spark, sf):
    """Q8/Q9: low-confidence warnings and type mismatches without transformation."""
    led = _ledger(spark, sf)
    sn = F.col("source_node")
    led = led.withColumn("source_data_type", F.when(sn.endswith("Date"), "date").when(sn.endswith("Number"), "integer")
                         .when(sn.isNull(), F.lit(None)).otherwise("string"))
    r = name_rule_col(F.col("target_column"))
    led = led.withColumn("target_data_type", F.when(r == "boolean", "boolean").when(r == "date", "date")
                         .when(r == "number", "decimal").otherwise("string"))
    return QL.mapping_issues(led).select("mapping_id", "issue_type", "message", "severity")


@query("normalize_nodes", _LEDGER + """
SELECT mapping_id, coalesce(source_node, '') AS xpath, 'string' AS data_type, '' AS sample_value FROM ledger""")
def normalize_nodes_q(spark, sf):
    """Node input normalized (path '' when missing, type 'string', sample '')."""
    n = _ledger(spark, sf).select("mapping_id", F.col("source_node").alias("node_path"))
    return normalize_nodes(n)


AVAILABLE = list(SILVER)  # POLICY, CUSTOMER, COVERAGE, RISK


def _route_sql(sec: str) -> str:
    from docmap.operators.predict import ROUTING
    out = f"'{AVAILABLE[0]}'"
    for kw, table in reversed(ROUTING):
        if table in AVAILABLE:
            out = f"CASE WHEN strpos(lower({sec}), '{kw}') > 0 THEN '{table}' ELSE {out} END"
    return out


_SECTION_SQL = ("coalesce(list_filter(string_split(source_node, '/'), "
                "lambda s: regexp_matches(lower(s), '(policy|account|risk|coverage|payment|customer|quote)'))[1], 'General')")


@query("section_route", _LEDGER + f"""
SELECT mapping_id, source_node, section, {_route_sql('section')} AS routed_table
FROM (SELECT *, {_SECTION_SQL} AS section FROM ledger WHERE source_node IS NOT NULL AND source_node <> '')""")
def section_route(spark, sf):
    """M1/M2: section of each path and the table it routes to."""
    led = _ledger(spark, sf).where(F.col("source_node").isNotNull() & (F.col("source_node") != ""))
    led = led.withColumn("section", section_of(F.col("source_node")))
    return led.select("mapping_id", "source_node", "section",
                      route_table(F.col("section"), AVAILABLE).alias("routed_table"))


def _catalog_sql() -> str:
    rows = ", ".join(f"('SILVER.{t}', '{c}', {i + 1})" for t, cols in SILVER.items() for i, (c, _) in enumerate(cols))
    return f"catalog AS (SELECT * FROM (VALUES {rows}) v(table_name, column_name, ordinal_position))"


@query("candidate_pairs", Q.with_ctes(Q.LEDGER_CTE, _catalog_sql()) + f""",
n AS (SELECT DISTINCT source_node AS xpath FROM ledger WHERE source_node IS NOT NULL AND source_node <> ''),
s AS (SELECT xpath, section, {_route_sql('section')} AS target_table
      FROM (SELECT *, {_SECTION_SQL.replace('source_node', 'xpath')} AS section FROM n)),
c AS (SELECT upper(split_part(table_name, '.', -1)) AS target_table, column_name FROM catalog)
SELECT s.section, s.xpath, s.target_table, c.column_name FROM s JOIN c USING (target_table)""")
def candidate_pairs_q(spark, sf):
    """M3/M5: every (section node, routed-table column) candidate."""
    from docmap.operators.predict import candidates
    from docmap.sources.catalog import catalog_from_schema
    nodes = _ledger(spark, sf).where(F.col("source_node").isNotNull()).select(F.col("source_node").alias("xpath")).distinct()
    return candidates(nodes, catalog_from_schema(spark), AVAILABLE).select("section", "xpath", "target_table", "column_name")


_FILE_RANK = "CASE approval_status WHEN 'Approved' THEN 1 WHEN 'Pending' THEN 2 ELSE 3 END"


@query("union_dedupe_ranked", _LEDGER + f"""
SELECT source_node, target_column, source_file, mapping_id FROM (
  SELECT *, lower(approval_status) || '_mappings.csv' AS source_file,
         row_number() OVER (PARTITION BY source_node, target_column ORDER BY {_FILE_RANK}, {_ORD}) AS rn
  FROM ledger) WHERE rn = 1""")
def union_dedupe_ranked(spark, sf):
    """Files unioned in relevance order, first row per (source_node, target_column)."""
    from docmap.operators.references import union_ranked
    led = _ledger(spark, sf)
    frames = [(f"{s.lower()}_mappings.csv", r, led.where(F.col("approval_status") == s))
              for s, r in (("Approved", 1), ("Pending", 2), ("Rejected", 3))]
    u = union_ranked(frames).select("source_node", "target_column", "source_file", "file_rank", "mapping_id",
                                    *LEDGER_ORDER)
    return dedupe_mappings(u, LEDGER_ORDER).select("source_node", "target_column", "source_file", "mapping_id")


_PRODUCT_OF_TABLE = "CASE target_table WHEN 'POLICY' THEN 'PA001' WHEN 'COVERAGE' THEN 'HO003' WHEN 'RISK' THEN 'CP001' END"
REQUESTED = ["PA001", "HO003", "CP001", "UMB001", "WC001"]


@query("fallback_filter", _LEDGER + f""", p AS (SELECT *, {_PRODUCT_OF_TABLE} AS product_code FROM ledger),
req AS (SELECT * FROM (VALUES {', '.join(f"('{r}')" for r in REQUESTED)}) v(requested_product)),
present AS (SELECT DISTINCT product_code FROM p WHERE product_code IN (SELECT requested_product FROM req)),
missing AS (SELECT requested_product FROM req WHERE requested_product NOT IN (SELECT product_code FROM present))
SELECT product_code AS requested_product, mapping_id, false AS is_fallback FROM p
WHERE product_code IN (SELECT product_code FROM present)
UNION ALL SELECT m.requested_product, p.mapping_id, true FROM p, missing m""")
def fallback_filter(spark, sf):
    """Product rows, or all rows for a product that has none."""
    led = _ledger(spark, sf)
    t = F.col("target_table")
    led = led.withColumn("product_code", F.when(t == "POLICY", "PA001").when(t == "COVERAGE", "HO003")
                         .when(t == "RISK", "CP001"))
    return with_fallback(led, REQUESTED).select("requested_product", "mapping_id", "is_fallback")
