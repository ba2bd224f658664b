"""Registered queries: each is a Spark plan over the driver's tables plus,
where SQL can express it, an equivalent DuckDB query (the oracle).

Every query reads whole tables (or data Spark derives from them); no row
caps, id subsets or samples.  Column names are aliased identically on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmap.functions.types import (coerce_declared, format_type, infer_type, name_rule_col, to_boolean,
                                    to_date, to_number, to_text, types_compatible)
from docmap.operators import extract as X
from docmap.operators.nodes import UNPARSED, NodeCounter, error_kind, node_profile, one_pass, xml_nodes
from docmap.plans import sqlparts as Q
from docmap.plans.doc_mappings import COVERAGE_RECORD, approved_mappings
from docmap.sources.testbed import LEDGER_COLUMNS, bronze_documents, read_table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

DOC_KEYS = ["o_orderkey", "part"]


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _docs(spark, sf):
    return bronze_documents(spark, sf)


def _silver(spark, sf, table, record_path=None, mode="declared"):
    return X.load_silver(_docs(spark, sf), approved_mappings(spark), table, DOC_KEYS,
                         record_path=record_path, mode=mode)


# ============================================================ documents (X, N)
@query("xml_extract_policy", Q.with_ctes(Q.DOCS_CTE) + f"""
SELECT 'TX-' || o_orderkey || '-' || part AS transaction_ref, CAST(o_orderkey AS VARCHAR) AS policy_number,
       CAST(o_orderdate AS DATE) AS effective_date, CAST(o_totalprice AS DECIMAL(15,2)) AS total_premium,
       o_orderstatus AS policy_status, {Q.PRIORITY} AS priority,
       regexp_matches(o_orderpriority, '^[12]-') AS is_priority,
       CAST(o_orderdate AS TIMESTAMP) AS created_timestamp, part AS document_part
FROM docs""")
def xml_extract_policy(spark, sf):
    """Flagship: Bronze documents -> typed POLICY rows."""
    return _silver(spark, sf, "POLICY").drop(*DOC_KEYS)


@query("xml_explode_records", Q.with_ctes(Q.DOCS_CTE) + """
SELECT CAST(d.o_orderkey AS VARCHAR) AS policy_number, r.record_index,
       r.l_orderkey || '-' || r.l_linenumber || '-' || r.l_partkey AS coverage_ref,
       r.l_partkey AS coverage_code, r.l_suppkey AS supplier_code, r.l_linenumber AS line_number,
       CAST(r.l_quantity AS DECIMAL(15,2)) AS quantity, CAST(r.l_extendedprice AS DECIMAL(15,2)) AS limit_amount,
       CAST(r.l_discount AS DECIMAL(15,2)) AS discount_rate, CAST(r.l_tax AS DECIMAL(15,2)) AS tax_rate,
       r.l_returnflag AS return_flag, r.l_linestatus AS line_status, CAST(r.l_shipdate AS DATE) AS ship_date
FROM docs d LEFT JOIN recs r ON r.l_orderkey = d.o_orderkey AND r.part = d.part""")
def xml_explode_records(spark, sf):
    """One COVERAGE row per repeated Coverage record (records kept whole)."""
    return _silver(spark, sf, "COVERAGE", record_path=COVERAGE_RECORD).drop(*DOC_KEYS)


@query("xml_first_record", Q.with_ctes(Q.DOCS_CTE) + """
SELECT CAST(d.o_orderkey AS VARCHAR) AS policy_number,
       r.l_orderkey || '-' || r.l_linenumber || '-' || r.l_partkey AS coverage_ref,
       r.l_partkey AS coverage_code, r.l_suppkey AS supplier_code, r.l_linenumber AS line_number,
       CAST(r.l_quantity AS DECIMAL(15,2)) AS quantity, CAST(r.l_extendedprice AS DECIMAL(15,2)) AS limit_amount,
       CAST(r.l_discount AS DECIMAL(15,2)) AS discount_rate, CAST(r.l_tax AS DECIMAL(15,2)) AS tax_rate,
       r.l_returnflag AS return_flag, r.l_linestatus AS line_status, CAST(r.l_shipdate AS DATE) AS ship_date
FROM docs d LEFT JOIN recs r ON r.l_orderkey = d.o_orderkey AND r.part = d.part AND r.record_index = 0""")
def xml_first_record(spark, sf):
    """Path navigation takes the first matching child at every step."""
    return _silver(spark, sf, "COVERAGE").drop(*DOC_KEYS)


@query("xml_view_strings", Q.with_ctes(Q.DOCS_CTE) + f"""
SELECT 'DOC-' || o_orderkey || '-' || part AS SOURCE_XML_ID, CAST(o_orderkey AS VARCHAR) AS policy_number,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'VIN' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') ELSE '' END AS vehicle_vin,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN {Q.BUILDING_YEAR} ELSE '' END AS building_year,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Frame' ELSE '' END AS construction_type,
  CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE '' END AS business_name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(c_custkey % 500 AS VARCHAR) ELSE '' END AS employee_count,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) ELSE '' END
    AS payroll_amount
FROM docs""")
def xml_view_strings(spark, sf):
    """All-string view of RISK, missing values as '', with the document's
    id first (here its order and part; the digest of text that only Spark
    builds is in ``inbox_landing``)."""
    m = X.first_wins(approved_mappings(spark).where("target_table = 'RISK'"), ["ord"])
    docs = _docs(spark, sf).withColumn("xml_id", F.concat(F.lit("DOC-"), F.concat_ws("-", *DOC_KEYS)))
    return X.string_view(docs, X.collect_mappings(m, ["ord"]), empty_as_blank=True)


def _profile(spark, sf, by):
    return node_profile(xml_nodes(_docs(spark, sf), by=by))


_NODES = Q.with_ctes(Q.DOCS_CTE, Q.nodes_cte())


@query("xml_node_counts", _NODES + """
SELECT node_path, count(*) AS occurrences, count(DISTINCT doc || '-' || part) AS documents
FROM nodes GROUP BY node_path
UNION ALL SELECT '!unparsed', count(*), count(*) FROM all_docs WHERE parse_error IS NOT NULL""")
def xml_node_counts(spark, sf):
    """Element occurrences and documents per absolute path
    (pre-aggregated per document batch in the worker, then summed)."""
    from docmap.operators.nodes import path_summary
    return path_summary(_docs(spark, sf))


@query("xml_parent_rollup", _NODES + """
SELECT CASE WHEN length(node_path) - length(replace(node_path, '/', '')) > 1
            THEN regexp_replace(node_path, '/[^/]*$', '') END AS parent_path,
       count(*) AS child_nodes, count(DISTINCT node_name) AS child_tags
FROM nodes GROUP BY 1
UNION ALL SELECT '!unparsed', count(*), 0 FROM all_docs WHERE parse_error IS NOT NULL""")
def xml_parent_rollup(spark, sf):
    """Children per parent path (root has a NULL parent); documents that do
    not parse are counted under their own entry."""
    bad = F.col("parse_error").isNotNull()
    p = _profile(spark, sf, ["node_path", "node_name"]).withColumn("parent_path", F.when(bad, UNPARSED).otherwise(F.col("parent_path")))
    return p.groupBy("parent_path", "node_name").agg(F.sum("n").alias("n")).groupBy("parent_path").agg(
        F.sum("n").alias("child_nodes"), F.count("node_name").alias("child_tags"))


@query("xml_type_profile", _NODES + f"""
SELECT node_path, {Q.infer_type_sql('text')} AS data_type, count(*) AS n,
       count({Q.sample_sql('text')}) AS n_samples, CAST(max(length({Q.sample_sql('text')})) AS INTEGER) AS max_sample_len
FROM nodes GROUP BY 1, 2
UNION ALL SELECT '!unparsed', parse_error, count(*), 0, NULL FROM all_docs WHERE parse_error IS NOT NULL GROUP BY 2""")
def xml_type_profile(spark, sf):
    """Inferred type and sample values per path (documents that do not
    parse: by the kind of error)."""
    p = _profile(spark, sf, ["node_path", "text"])
    bad = F.col("parse_error").isNotNull()
    p = p.withColumns({"node_path": F.when(bad, UNPARSED).otherwise(F.col("node_path")),
                       "data_type": F.when(bad, error_kind("parse_error")).otherwise(F.col("data_type"))})
    return p.groupBy("node_path", "data_type").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("sample_value").isNotNull(), F.col("n")).otherwise(0)).alias("n_samples"),
        F.max(F.length("sample_value")).alias("max_sample_len"))


@query("attribute_names", _NODES + """
SELECT node_path, a AS attribute, count(*) AS n FROM (SELECT node_path, unnest(attrs) AS a FROM nodes) GROUP BY 1, 2
UNION ALL SELECT '!unparsed', parse_error, count(*) FROM all_docs WHERE parse_error IS NOT NULL GROUP BY 2""")
def attribute_names(spark, sf):
    """Attribute names per element path (documents that do not parse: by
    the kind of error)."""
    p = xml_nodes(_docs(spark, sf), by=["node_path", "attributes"])
    bad = F.col("parse_error").isNotNull()
    return (p.select(F.when(bad, UNPARSED).otherwise(F.col("node_path")).alias("node_path"), "n",
                     F.explode(F.when(bad, F.array(error_kind("parse_error"))).otherwise(F.col("attributes"))).alias("attribute"))
            .groupBy("node_path", "attribute").agg(F.sum("n").alias("n")))


# ------------------------------------------------------- account documents
ACCOUNT_KEYS = ["c_custkey", "account_part"]
LINE_RECORD = "/Session/Data/Orders/Order/Lines/Line"
_O = "/Session/Data/Orders/Order"
ACCOUNT_MAPPINGS = [
    ("account_name", "/Session/Data/Account/Name", "STRING"), ("lower_name", "/Session/Data/Account/name", "STRING"),
    ("memo", "/Session/Data/Account/Memo", "STRING"), ("remark", "/Session/Data/Account/Remark", "STRING"),
    ("no_such_case", "/Session/Data/account/Name", "STRING"), ("order_ref", _O + "/@id", "STRING"),
    ("order_total", _O + "/Total", "DECIMAL(15,2)"), ("line_ref", LINE_RECORD + "/@id", "STRING"),
    ("part", LINE_RECORD + "/Part", "INT"), ("quantity", LINE_RECORD + "/Quantity", "DECIMAL(15,2)")]

ACCOUNTS_CTE = f"""
aparts AS (SELECT DISTINCT l_orderkey AS k, part AS p FROM li_all),
acnt AS (SELECT o_custkey AS c, greatest(1, CAST(ceil(count(*) / 8.0) AS INTEGER)) AS n FROM aparts JOIN orders ON o_orderkey = k GROUP BY 1),
aord AS (SELECT a.k, a.p, o_custkey, o_totalprice, CAST((a.k * 7 + a.p) % acnt.n AS INTEGER) AS account_part
         FROM aparts a JOIN orders ON o_orderkey = a.k JOIN acnt ON acnt.c = o_custkey),
aall AS (SELECT DISTINCT c_custkey, account_part, c_name, {Q.parse_error('c_custkey')} AS parse_error FROM aord JOIN customer ON c_custkey = o_custkey),
arec AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, part ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS ln FROM li_all l)
"""


def _accounts(spark, sf, with_status=False):
    from docmap.sources.testbed import account_documents
    maps = [X.CompiledMapping(c, p, None, t) for c, p, t in ACCOUNT_MAPPINGS]
    return X.project(account_documents(spark, sf), maps, ACCOUNT_KEYS, record_path=LINE_RECORD, with_ordinals=True, with_status=with_status)


@query("xml_nested_records", Q.with_ctes(Q.DOCS_CTE, ACCOUNTS_CTE) + """
SELECT d.c_custkey, d.account_part,
  CASE WHEN r.ln IS NOT NULL THEN CAST(count(r.ln) OVER (PARTITION BY d.c_custkey, d.account_part ORDER BY o.ono, r.ln
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INTEGER) END AS record_index,
  CAST(o.ono AS INTEGER) AS order_no, CAST(r.ln AS INTEGER) AS line_no,
  d.c_name AS account_name, 'n' || d.c_custkey AS lower_name, 'v' || d.c_custkey || 'w' AS memo, 'xz' AS remark,
  CAST(NULL AS VARCHAR) AS no_such_case, o.k || '-' || o.p AS order_ref, CAST(o.o_totalprice AS DECIMAL(15,2)) AS order_total,
  r.l_orderkey || '-' || r.l_linenumber || '-' || r.l_partkey AS line_ref, CAST(r.l_partkey AS INTEGER) AS part,
  CAST(r.l_quantity AS DECIMAL(15,2)) AS quantity
FROM aall d
JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey, account_part ORDER BY k, p) - 1 AS ono FROM aord) o
  ON o.o_custkey = d.c_custkey AND o.account_part = d.account_part
LEFT JOIN arec r ON r.l_orderkey = o.k AND r.part = o.p AND o.k % 7 <> 0
WHERE d.parse_error IS NULL""")
def xml_nested_records(spark, sf):
    """X17 with two repeating levels: every line of every order, with its own
    order's attributes; X3 with names that differ in case only, and text around
    comments and children."""
    at = F.col("record_ordinals")
    r = _accounts(spark, sf)
    return r.withColumns({"order_no": at[2], "line_no": at[4]}).drop("record_ordinals")


@query("parse_ledger", Q.with_ctes(Q.DOCS_CTE, ACCOUNTS_CTE) + """
SELECT family, status, count(*) AS extracted, count(*) AS flattened
FROM (SELECT 'order' AS family, coalesce(parse_error, 'ok') AS status FROM all_docs
      UNION ALL SELECT 'account', coalesce(parse_error, 'ok') FROM aall) GROUP BY 1, 2""")
def parse_ledger(spark, sf):
    """Documents by parse status, as extraction and as flattening see
    them; none is lost on either way."""
    from docmap.sources.testbed import account_documents, split_orders
    status = F.coalesce(error_kind("parse_error"), F.lit("ok")).alias("status")
    split = split_orders(read_table(spark, sf, "lineitem"))
    seen = []
    for family, docs, keys in (("order", bronze_documents(spark, sf, split), DOC_KEYS), ("account", account_documents(spark, sf, split), ACCOUNT_KEYS)):
        # both ways read the same parse of a document, which is built once
        ways = {"extracted": X.path_reader(docs, [], keys), "flattened": NodeCounter(["depth"])}
        rows = one_pass(docs, ways).where("reader = 'extracted' OR depth = 1 OR parse_error IS NOT NULL")
        n = {w: F.when(F.col("reader") == w, F.coalesce("n", F.lit(1))).otherwise(0) for w in ways}  # an extracted row is one document
        seen.append(rows.groupBy(F.lit(family).alias("family"), status).agg(*[F.sum(c).cast("bigint").alias(w) for w, c in n.items()]))
    return reduce(DataFrame.unionByName, seen).groupBy("family", "status").agg(
        F.sum("extracted").alias("extracted"), F.sum("flattened").alias("flattened"))


@query("coverage_by_column", Q.with_ctes(Q.DOCS_CTE) + f"""
SELECT 'RISK' AS target_table, column_name, count(*) FILTER (WHERE v = 'x') AS extracted, count(*) FILTER (WHERE v IS NULL) AS absent,
       count(*) FILTER (WHERE v = 'blank') AS blank, count(*) FILTER (WHERE v = 'bad') AS failed,
       (SELECT count(*) FROM all_docs WHERE parse_error IS NOT NULL) AS unparsed_documents
FROM (SELECT unnest(['policy_number', 'vehicle_vin', 'building_year', 'construction_type', 'business_name',
                     'employee_count', 'payroll_amount']) AS column_name,
             unnest(['x',
                     CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'x' END,
                     CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN CASE WHEN trim({Q.BUILDING_YEAR}) = '' THEN 'blank'
                          WHEN TRY_CAST({Q.BUILDING_YEAR} AS INTEGER) IS NULL THEN 'bad' ELSE 'x' END END,
                     CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'x' END,
                     CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' END,
                     CASE WHEN c_mktsegment = 'MACHINERY' THEN 'x' END,
                     CASE WHEN c_mktsegment = 'MACHINERY' THEN 'x' END]) AS v
      FROM docs) GROUP BY column_name""")
def coverage_by_column(spark, sf):
    """Q6: rows extracted, absent, blank and failed per RISK column over all
    documents, and documents that do not parse."""
    from docmap.operators.quality import extraction_coverage
    m = X.first_wins(approved_mappings(spark).where("target_table = 'RISK'"), ["ord"])
    return extraction_coverage(_docs(spark, sf), X.collect_mappings(m, ["ord"]), "RISK", DOC_KEYS)


# ============================================================ typed strings
# Fixed edge cases of the type rules, added to the text values of the tables.
EDGE_CASES = [" 42 ", "1_000", "1__0", "+7", "-0", "1e5", "1E-3", ".5", "5.", "nan", "-Inf", "infinity",
              "312-555-01", "2025-10-05", "2025-10-05T10:30:00", "10:30 T", "yes", "N", "off", "on", "",
              "   ", "12a", "0x1F", "1,000", "TRUE", "2025", "1250.75", "007"]


def _typed_strings(spark, sf):
    part = read_table(spark, sf, "part")
    orders = read_table(spark, sf, "orders")
    cust = read_table(spark, sf, "customer")
    u = (part.select(F.lit("p_name").alias("src"), F.col("p_partkey").alias("k"), F.col("p_name").alias("val"))
         .unionByName(part.select(F.lit("p_type").alias("src"), F.col("p_partkey").alias("k"), F.col("p_type").alias("val")))
         .unionByName(part.select(F.lit("p_size").alias("src"), F.col("p_partkey").alias("k"),
                                  F.col("p_size").cast("string").alias("val")))
         .unionByName(part.select(F.lit("p_retailprice").alias("src"), F.col("p_partkey").alias("k"),
                                  F.col("p_retailprice").cast("decimal(15,2)").cast("string").alias("val")))
         .unionByName(orders.select(F.lit("o_orderdate").alias("src"), F.col("o_orderkey").alias("k"),
                                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("val")))
         .unionByName(orders.select(F.lit("o_orderpriority").alias("src"), F.col("o_orderkey").alias("k"),
                                    F.col("o_orderpriority").alias("val")))
         .unionByName(orders.select(F.lit("o_orderstatus").alias("src"), F.col("o_orderkey").alias("k"),
                                    F.col("o_orderstatus").alias("val")))
         .unionByName(cust.select(F.lit("c_acctbal").alias("src"), F.col("c_custkey").alias("k"),
                                  F.col("c_acctbal").cast("decimal(15,2)").cast("string").alias("val")))
         .unionByName(cust.select(F.lit("c_mktsegment").alias("src"), F.col("c_custkey").alias("k"),
                                  F.col("c_mktsegment").alias("val"))))
    edge = spark.createDataFrame([("edge", i, v) for i, v in enumerate(EDGE_CASES)], "src string, k long, val string")
    return u.unionByName(edge)


def _typed_strings_sql() -> str:
    edge = ", ".join(f"('edge', {i}::BIGINT, '{v}')" for i, v in enumerate(EDGE_CASES))
    return f"""typed AS (
  SELECT 'p_name' AS src, p_partkey AS k, p_name AS val FROM part
  UNION ALL SELECT 'p_type', p_partkey, p_type FROM part
  UNION ALL SELECT 'p_size', p_partkey, CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'p_retailprice', p_partkey, CAST(CAST(p_retailprice AS DECIMAL(15,2)) AS VARCHAR) FROM part
  UNION ALL SELECT 'o_orderdate', o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderkey, o_orderpriority FROM orders
  UNION ALL SELECT 'o_orderstatus', o_orderkey, o_orderstatus FROM orders
  UNION ALL SELECT 'c_acctbal', c_custkey, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) FROM customer
  UNION ALL SELECT 'c_mktsegment', c_custkey, c_mktsegment FROM customer
  UNION ALL SELECT * FROM (VALUES {edge}) t(src, k, val))"""


_TYPED = "WITH " + _typed_strings_sql() + "\n"


@query("infer_type", _TYPED + f"SELECT src, k, val, {Q.infer_type_sql('val')} AS data_type FROM typed")
def infer_type_q(spark, sf):
    """N6 over table text values and edge cases."""
    return _typed_strings(spark, sf).select("src", "k", "val", infer_type("val").alias("data_type"))


def _rule_sql(col: str) -> str:
    from docmap.functions.types import NUMBER_MARKERS
    u = f"upper({col})"
    num = " OR ".join(f"strpos({u}, '{m}') > 0" for m in NUMBER_MARKERS)
    return (f"CASE WHEN strpos({u}, 'IS_') > 0 OR strpos({u}, 'HAS_') > 0 OR suffix({u}, '_FLAG') THEN 'boolean' "
            f"WHEN strpos({u}, 'DATE') > 0 OR strpos({u}, 'TIME') > 0 THEN 'date' "
            f"WHEN ({num}) AND strpos({u}, '_NUMBER') = 0 THEN 'number' "
            f"WHEN {u} = 'RISK_NUMBER' THEN 'number' ELSE 'text' END")


def _bool_sql(v: str) -> str:
    t = f"lower({Q.strip(v)})"
    return (f"CASE WHEN {t} IN ('true','t','yes','y','on','1') THEN true "
            f"WHEN {t} IN ('false','f','no','n','off','0') THEN false END")


def _date_sql(v: str) -> str:
    t = Q.strip(v)
    return f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(substr({t}, 1, 10) AS DATE) END"


def _num_sql(v: str, p: int = 38, s: int = 0) -> str:
    return Q.num_cast(Q.strip(v), f"DECIMAL({p},{s})")


def _text_sql(v: str) -> str:
    return f"nullif({Q.strip(v)}, '')"


_COLNAME = f"{Q.sql_list(LEDGER_COLUMNS)}[k % {len(LEDGER_COLUMNS)} + 1]"


@query("coerce_name_rules", _TYPED + f"""
SELECT src, k, val, target_column, rule,
  CASE rule WHEN 'boolean' THEN CAST({_bool_sql('val')} AS VARCHAR)
            WHEN 'date' THEN CAST({_date_sql('val')} AS VARCHAR)
            WHEN 'number' THEN CAST({_num_sql('val')} AS VARCHAR)
            ELSE {_text_sql('val')} END AS coerced
FROM (SELECT *, {_rule_sql('target_column')} AS rule FROM (SELECT *, {_COLNAME} AS target_column FROM typed))""")
def coerce_name_rules(spark, sf):
    """Coercion chosen from the target column name."""
    t = _typed_strings(spark, sf)
    names = F.array(*[F.lit(c) for c in LEDGER_COLUMNS])
    t = t.withColumn("target_column", F.element_at(names, (F.col("k") % len(LEDGER_COLUMNS) + 1).cast("int")))
    t = t.withColumn("rule", name_rule_col(F.col("target_column")))
    v = F.col("val")
    coerced = (F.when(F.col("rule") == "boolean", to_boolean(v).cast("string"))
               .when(F.col("rule") == "date", to_date(v).cast("string"))
               .when(F.col("rule") == "number", to_number(v).cast("string"))
               .otherwise(to_text(v)))
    return t.select("src", "k", "val", "target_column", "rule", coerced.alias("coerced"))


@query("coerce_declared", _TYPED + f"""
SELECT src, k, val,
  {_bool_sql(_text_sql('val'))} AS as_boolean,
  {_date_sql(_text_sql('val'))} AS as_date,
  {Q.num_cast(_text_sql('val'), 'DECIMAL(15,2)')} AS as_decimal,
  TRY_CAST({Q.num_cast(_text_sql('val'), 'DECIMAL(38,0)')} AS INTEGER) AS as_int,
  {_text_sql('val')} AS as_text
FROM typed""")
def coerce_declared_q(spark, sf):
    """X10 default mode: coercion by declared target type."""
    v = F.col("val")
    return _typed_strings(spark, sf).select(
        "src", "k", "val", coerce_declared(v, "BOOLEAN").alias("as_boolean"),
        coerce_declared(v, "DATE").alias("as_date"), coerce_declared(v, "DECIMAL(15,2)").alias("as_decimal"),
        coerce_declared(v, "INT").alias("as_int"), coerce_declared(v, "VARCHAR(50)").alias("as_text"))


TRANSFORMS = [("t_date", "TO_DATE(value)"), ("t_dec", "CAST(value AS DECIMAL(15,2))"),
              ("t_num", "CAST(value AS NUMBER(10,1))"), ("t_upper", "UPPER(value)"),
              ("t_left", "LEFT(TRIM(value), 3)"), ("t_flag", "CASE WHEN LOWER(value) = 'true' THEN TRUE ELSE FALSE END"),
              ("t_ts", "TO_TIMESTAMP_NTZ(value)")]


@query("transform_expr", _TYPED + f"""
SELECT src, k, val,
  {_date_sql('val')} AS t_date,
  {Q.num_cast(Q.strip('val'), 'DECIMAL(15,2)')} AS t_dec,
  {Q.num_cast(Q.strip('val'), 'DECIMAL(10,1)')} AS t_num,
  upper(val) AS t_upper,
  left(trim(val), 3) AS t_left,
  CASE WHEN lower(val) = 'true' THEN true ELSE false END AS t_flag,
  CASE WHEN regexp_matches({Q.strip('val')}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
       THEN TRY_CAST({Q.strip('val')} AS TIMESTAMP) END AS t_ts
FROM typed""")
def transform_expr(spark, sf):
    """Whitelisted transformation text applied to values."""
    from docmap.functions.transform import apply_transform
    return _typed_strings(spark, sf).select("src", "k", "val", *[apply_transform(x, F.col("val")).alias(n) for n, x in TRANSFORMS])


@query("type_compat", _TYPED + f"""
SELECT src, k, inferred, declared,
  (inferred IN ('varchar','text','string','char') AND declared IN ('varchar','text','string','char'))
  OR (inferred IN ('int','integer','bigint','smallint','number') AND declared IN ('int','integer','bigint','smallint','number'))
  OR (inferred IN ('float','double','decimal','numeric','number') AND declared IN ('float','double','decimal','numeric','number'))
  OR (inferred IN ('date','timestamp','datetime') AND declared IN ('date','timestamp','datetime')) AS compatible
FROM (SELECT src, k, {Q.infer_type_sql('val')} AS inferred,
             CASE src WHEN 'p_size' THEN 'integer' WHEN 'p_retailprice' THEN 'decimal' WHEN 'c_acctbal' THEN 'number'
                      WHEN 'o_orderdate' THEN 'timestamp' WHEN 'edge' THEN 'boolean' ELSE 'varchar' END AS declared
      FROM typed)""")
def type_compat(spark, sf):
    """Q10: inferred type of each value vs the declared type of its column."""
    t = _typed_strings(spark, sf)
    declared = (F.when(F.col("src") == "p_size", "integer").when(F.col("src") == "p_retailprice", "decimal")
                .when(F.col("src") == "c_acctbal", "number").when(F.col("src") == "o_orderdate", "timestamp")
                .when(F.col("src") == "edge", "boolean").otherwise("varchar"))
    t = t.select("src", "k", infer_type("val").alias("inferred"), declared.alias("declared"))
    return t.withColumn("compatible", types_compatible(F.col("inferred"), F.col("declared")))


@query("format_type", """
SELECT p_partkey, p_type, ftype FROM (SELECT p_partkey, p_type,
  CASE WHEN ty = 'VARCHAR' THEN printf('%s(%d)', ty, p_size)
       WHEN ty = 'DECIMAL' AND p_size % 5 > 0 THEN printf('%s(%d,%d)', ty, p_size, p_size % 5)
       WHEN ty = 'DECIMAL' THEN printf('%s(%d)', ty, p_size)
       ELSE ty END AS ftype
  FROM (SELECT *, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'VARCHAR'
                       WHEN p_type IN ('PROMO', 'MEDIUM') THEN 'DECIMAL' ELSE 'DATE' END AS ty FROM part))""")
def format_type_q(spark, sf):
    """Q11: type text with length / precision, scale only when > 0."""
    p = read_table(spark, sf, "part")
    ty = (F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "VARCHAR")
          .when(F.col("p_type").isin("PROMO", "MEDIUM"), "DECIMAL").otherwise("DATE"))
    p = p.withColumn("ty", ty)
    return p.select("p_partkey", "p_type", format_type(
        F.col("ty"), F.when(F.col("ty") == "VARCHAR", F.col("p_size")),
        F.when(F.col("ty") == "DECIMAL", F.col("p_size")),
        F.when(F.col("ty") == "DECIMAL", F.col("p_size") % 5)).alias("ftype"))
