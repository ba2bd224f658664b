"""DuckDB SQL building blocks for the oracle queries.

The oracles never see XML: they rebuild what each document contains from
the base tables (orders, customer, lineitem), so every document query is
checked end to end against an independent engine.
"""

from __future__ import annotations

from docmap.sources.testbed import LEDGER_COLUMNS, LEDGER_PATHS, LEDGER_TABLES, RECORDS_PER_PART

WS = "(chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def num_cast(x: str, sql_type: str) -> str:
    """Numeric text cast as the warehouse does it: digit separators ('_') are not numbers."""
    return f"CASE WHEN strpos({x}, '_') > 0 THEN NULL ELSE TRY_CAST({x} AS {sql_type}) END"


def dec_text(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(15,2)) AS VARCHAR)"


# text of the Priority element (some documents have markup or a product code in it)
PRIORITY = ("CASE o_orderkey % 16 WHEN 9 THEN '<b>' || o_orderpriority || '</b>' WHEN 11 THEN '<i>' || o_orderpriority || '</i>' "
            "WHEN 13 THEN 'Plan PA001 ' || o_orderpriority ELSE o_orderpriority END")

# text of the BuildingYear element: some are words, some blank
BUILDING_YEAR = ("CASE WHEN c_custkey % 11 = 3 THEN 'about ' || (1950 + c_custkey % 70) WHEN c_custkey % 11 = 7 THEN ' ' "
                 "ELSE CAST(1950 + c_custkey % 70 AS VARCHAR) END")


def parse_error(key: str) -> str:
    """Kind of error of the documents that do not parse, by their key."""
    return (f"CASE WHEN {key} % 256 = 10 THEN 'null document' WHEN {key} % 64 = 2 THEN 'no element found' "
            f"WHEN {key} % 64 = 4 THEN 'junk after document element' WHEN {key} % 64 = 6 THEN 'undefined entity' END")


# documents: one row per (order, part) with order and customer columns; ``docs``,
# ``li`` and ``recs`` are what the documents that parse hold
DOCS_CTE = f"""
cnt AS (SELECT l_orderkey, greatest(1, CAST(ceil(count(*) / {float(RECORDS_PER_PART)}) AS INTEGER)) AS n_parts
        FROM lineitem GROUP BY l_orderkey),
li_all AS (SELECT l.*, CAST((l.l_partkey * 7 + l.l_suppkey * 13 + l.l_linenumber * 31 + l.copy) % c.n_parts AS INTEGER) AS part
       FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                                          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1
                       AS copy FROM lineitem) l JOIN cnt c ON c.l_orderkey = l.l_orderkey),
li AS (SELECT * FROM li_all WHERE {parse_error('l_orderkey')} IS NULL),
all_docs AS (SELECT o.*, cu.*, coalesce(p.part, 0) AS part, {parse_error('o_orderkey')} AS parse_error
         FROM orders o
         LEFT JOIN customer cu ON cu.c_custkey = o.o_custkey
         LEFT JOIN (SELECT DISTINCT l_orderkey, part FROM li_all) p ON p.l_orderkey = o.o_orderkey),
docs AS (SELECT * FROM all_docs WHERE parse_error IS NULL),
recs AS (SELECT li.*, CAST(row_number() OVER (PARTITION BY l_orderkey, part
                                             ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                                      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1
                           AS INTEGER) AS record_index
         FROM li)
"""

_T, _P, _A, _C = "/Session/TransactionInfo", "/Session/Data/Policy", "/Session/Data/Account", \
    "/Session/Data/Coverages/Coverage"

# (path, text SQL or None for a container element, attribute list SQL, scope, condition)
NODE_SPEC = [
    ("/Session", None, "[]", "doc", None),
    (_T, None, "[]", "doc", None),
    (_T + "/TransactionID", "'TX-' || o_orderkey || '-' || part", "[]", "doc", None),
    (_T + "/TransactionDate", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", "[]", "doc", None),
    (_T + "/SourceSystem", "'ORDERS'", "[]", "doc", None),
    (_T + "/DocumentPart", "CAST(part AS VARCHAR)", "[]", "doc", None),
    ("/Session/Data", None, "[]", "doc", None),
    (_P, None, "[]", "doc", None),
    (_P + "/PolicyNumber", "CAST(o_orderkey AS VARCHAR)", "[]", "doc", None),
    (_P + "/EffectiveDate", "strftime(o_orderdate, '%Y-%m-%d')", "[]", "doc", None),
    (_P + "/TotalPremium", dec_text("o_totalprice"), "[]", "doc", None),
    (_P + "/PolicyStatus", "o_orderstatus", "[]", "doc", None),
    (_P + "/Priority", PRIORITY, "[]", "doc", None),
    (_P + "/IsPriority", "CASE WHEN regexp_matches(o_orderpriority, '^[12]-') THEN 'true' ELSE 'false' END",
     "[]", "doc", None),
    (_A, None, "['id']", "doc", None),
    (_A + "/AccountNumber", "CAST(o_custkey AS VARCHAR)", "[]", "doc", None),
    (_A + "/AccountName", "c_name", "[]", "doc", None),
    (_A + "/Segment", "c_mktsegment", "[]", "doc", None),
    (_A + "/Balance", dec_text("c_acctbal"), "[]", "doc", None),
    (_A + "/NationCode", "CAST(c_nationkey AS VARCHAR)", "[]", "doc", None),
    ("/Session/Data/Vehicle", None, "['vehiclevin']", "doc", "c_mktsegment = 'AUTOMOBILE'"),
    ("/Session/Data/Vehicle/VIN", "'VIN' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')", "[]", "doc",
     "c_mktsegment = 'AUTOMOBILE'"),
    ("/Session/Data/Vehicle/Make", "'MK' || (c_custkey % 20)", "[]", "doc", "c_mktsegment = 'AUTOMOBILE'"),
    ("/Session/Data/Vehicle/Model", "'MD' || (c_custkey % 7)", "[]", "doc", "c_mktsegment = 'AUTOMOBILE'"),
    ("/Session/Data/Dwelling", None, "['propertyvalues']", "doc", "c_mktsegment = 'HOUSEHOLD'"),
    ("/Session/Data/Dwelling/ConstructionType", "'Frame'", "[]", "doc", "c_mktsegment = 'HOUSEHOLD'"),
    ("/Session/Data/Dwelling/Occupancy", "'Owner'", "[]", "doc", "c_mktsegment = 'HOUSEHOLD'"),
    ("/Session/Data/Dwelling/BuildingYear", BUILDING_YEAR, "[]", "doc",
     "c_mktsegment = 'HOUSEHOLD'"),
    ("/Session/Data/CommercialBuilding", None, "[]", "doc", "c_mktsegment = 'BUILDING'"),
    ("/Session/Data/CommercialBuilding/BusinessName", "c_name", "[]", "doc", "c_mktsegment = 'BUILDING'"),
    ("/Session/Data/CommercialBuilding/OccupancyType", "'Office'", "[]", "doc", "c_mktsegment = 'BUILDING'"),
    ("/Session/Data/Payroll", None, "[]", "doc", "c_mktsegment = 'MACHINERY'"),
    ("/Session/Data/Payroll/EmployeeCount", "CAST(c_custkey % 500 AS VARCHAR)", "[]", "doc",
     "c_mktsegment = 'MACHINERY'"),
    ("/Session/Data/Payroll/PayrollAmount", dec_text("c_acctbal"), "[]", "doc", "c_mktsegment = 'MACHINERY'"),
    ("/Session/Data/Coverages", None, "[]", "doc", None),
    (_C, None, "['id']", "rec", None),
    (_C + "/CoverageCode", "CAST(l_partkey AS VARCHAR)", "[]", "rec", None),
    (_C + "/SupplierCode", "CAST(l_suppkey AS VARCHAR)", "[]", "rec", None),
    (_C + "/LineNumber", "CAST(l_linenumber AS VARCHAR)", "[]", "rec", None),
    (_C + "/Quantity", dec_text("l_quantity"), "[]", "rec", None),
    (_C + "/LimitAmount", dec_text("l_extendedprice"), "[]", "rec", None),
    (_C + "/DiscountRate", dec_text("l_discount"), "[]", "rec", None),
    (_C + "/TaxRate", dec_text("l_tax"), "[]", "rec", None),
    (_C + "/ReturnFlag", "l_returnflag", "[]", "rec", None),
    (_C + "/LineStatus", "l_linestatus", "[]", "rec", None),
    (_C + "/ShipDate", "strftime(l_shipdate, '%Y-%m-%d')", "[]", "rec", None),
]


def nodes_cte() -> str:
    """``nodes(doc, part, node_path, node_name, text, attrs)`` rebuilt from the base tables."""
    parts = []
    for path, text, attrs, scope, cond in NODE_SPEC:
        name = path.rsplit("/", 1)[1]
        src = "docs" if scope == "doc" else "li"
        key = "o_orderkey" if scope == "doc" else "l_orderkey"
        t = text if text is not None else "CAST(NULL AS VARCHAR)"
        where = f" WHERE {cond}" if cond else ""
        parts.append(f"SELECT {key} AS doc, part, '{path}' AS node_path, '{name}' AS node_name, "
                     f"{t} AS text, CAST({attrs} AS VARCHAR[]) AS attrs FROM {src}{where}")
    return "nodes AS (\n" + "\nUNION ALL\n".join(parts) + "\n)"


def infer_type_sql(text: str) -> str:
    t = strip(text)
    return (f"CASE WHEN {t} IS NULL OR {t} = '' THEN 'string' "
            rf"WHEN regexp_matches({t}, '^[+-]?\d+(_\d+)*$') THEN 'integer' "
            rf"WHEN regexp_matches({t}, '^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$') "
            rf"OR regexp_matches({t}, '(?i)^[+-]?(nan|inf|infinity)$') THEN 'decimal' "
            f"WHEN length({t}) = 10 AND length({t}) - length(replace({t}, '-', '')) = 2 THEN 'date' "
            f"WHEN strpos({t}, 'T') > 0 AND strpos({t}, ':') > 0 THEN 'timestamp' "
            f"WHEN lower({t}) IN ('true', 'false', 'yes', 'no', 'y', 'n') THEN 'boolean' "
            "ELSE 'string' END")


def sample_sql(text: str) -> str:
    return f"CASE WHEN {strip(text)} <> '' THEN substr({text}, 1, 100) END"


def pick(values: list[str], idx: str) -> str:
    return f"{sql_list(values)}[({idx}) % {len(values)} + 1]"


LEDGER_CTE = f"""
ledger AS (SELECT
  printf('MAP-%d-%d-%d-%d-%d', l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(round(l_extendedprice * 100) AS BIGINT)) AS mapping_id,
  'XML-' || l_orderkey AS xml_id, l_orderkey AS doc_key, l_linenumber AS line_no,
  l_partkey AS part_key, l_suppkey AS supp_key,
  l_quantity AS ord_qty, l_extendedprice AS ord_price, l_discount AS ord_disc, l_tax AS ord_tax,
  l_returnflag AS ord_flag, l_linestatus AS ord_status, l_shipdate AS ord_ship,
  CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE {pick(LEDGER_PATHS, 'l_suppkey')} END AS source_node,
  {pick(LEDGER_TABLES, 'l_linenumber')} AS target_table,
  {pick(LEDGER_COLUMNS, 'l_partkey')} AS target_column,
  CASE WHEN l_tax > 0.06 THEN 'TO_DATE(value)' WHEN l_tax > 0.05 THEN 'CAST(value AS INTEGER)'
       WHEN l_tax > 0.04 THEN 'None' WHEN l_tax > 0.03 THEN '' ELSE NULL END AS transformation_logic,
  CAST(l_discount * 10 AS DECIMAL(3,2)) AS confidence_score,
  'from line ' || l_linenumber AS reasoning,
  CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'R' THEN 'Rejected' ELSE 'Pending' END AS approval_status,
  CASE WHEN l_linestatus = 'F' THEN 'Failed' WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'Completed'
       ELSE 'Not Started' END AS execution_status,
  CAST(l_shipdate AS DATE) AS created_date, CAST(l_quantity AS INTEGER) AS quantity
FROM lineitem)
"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
