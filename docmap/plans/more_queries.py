"""Registered queries: detection, similarity, reference files, JSON, prediction,
replies, vectors, cost, reconciliation and rule conformance."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docmap.operators import cost as C
from docmap.operators import detect as D
from docmap.operators import quality as QL
from docmap.operators import references as R
from docmap.operators.nodes import UNPARSED, error_kind, node_counts, node_profile, path_summary, xml_nodes
from docmap.operators.predict import ROUTING, SECTION_KEYWORDS, parse_replies, predict
from docmap.plans import sqlparts as Q
from docmap.plans.doc_mappings import COVERAGE_RECORD, DOC_MAPPINGS
from docmap.plans.queries import DOC_KEYS, _docs, _silver, query
from docmap.schemas import SILVER
from docmap.session import ensure_checkpoint_dir, written
from docmap.sources.testbed import mapping_ledger, read_table

_NODES = Q.with_ctes(Q.DOCS_CTE, Q.nodes_cte())


# ================================================================= detection
def _kw_sum_sql(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN strpos({text}, '{w.lower()}') > 0 THEN 1 ELSE 0 END" for w in words) + ")"


def _keyword_detect_sql() -> str:
    cols = [(code, _kw_sum_sql("lower(text)", kws)) for code, kws in D.SIMPLE_KEYWORDS]
    best = "greatest(" + ", ".join(f"kw_{c.lower()}" for c, _ in cols) + ")"
    pick = "CASE " + " ".join(f"WHEN kw_{c.lower()} = {best} THEN '{c}'" for c, _ in cols) + " END"
    inner = ", ".join(f"{e} AS kw_{c.lower()}" for c, e in cols)
    return (f"SELECT doc_id, {', '.join(f'kw_{c.lower()}' for c, _ in cols)}, {pick} AS detected_product, "
            f"{best} AS confidence FROM (SELECT doc_id, {inner} FROM documents)")


@query("keyword_detect", _keyword_detect_sql())
def keyword_detect(spark, sf):
    """Keyword counts per product over document text; best product."""
    return D.keyword_detect(read_table(spark, sf, "documents"), "text", ["doc_id"])


def _fuzzy_table() -> str:
    """Brute-force similarity of the testbed's fixed tag vocabulary and the
    product patterns (difflib), as a VALUES table for the oracle."""
    vocab = sorted({p.rsplit("/", 1)[1].lower() for p, *_ in Q.NODE_SPEC})
    attrs = ["id", "propertyvalues", "vehiclevin"]
    rows = []
    for d, p in enumerate(D.PRODUCTS):
        for kind, pats, terms in (("node", p[3], vocab), ("attr", p[4], attrs)):
            for j, pat in enumerate(pats):
                for term in terms:
                    r = SequenceMatcher(None, pat.lower(), term).ratio()
                    if r > D.TAG_THRESHOLD:
                        rows.append(f"('{term}', '{p[0]}', '{kind}', {j}, {r!r})")
    rows.append("('', '', '', -1, 0.0)")
    return f"fz AS (SELECT * FROM (VALUES {', '.join(rows)}) v(term, product, kind, pattern_idx, sim))"


def _patterns_table() -> str:
    rows = []
    for d, p in enumerate(D.PRODUCTS):
        for kind, pats in (("node", p[3]), ("attr", p[4])):
            for j, pat in enumerate(pats):
                rows.append(f"('{p[0]}', '{kind}', '{pat.lower()}', {j})")
    return f"pat AS (SELECT * FROM (VALUES {', '.join(rows)}) v(product, kind, pattern, pattern_idx))"


def _product_detect_sql() -> str:
    nodes = Q.nodes_cte().replace("SELECT o_orderkey AS doc", "SELECT {IDX} AS spec_idx, o_orderkey AS doc") \
        .replace("SELECT l_orderkey AS doc", "SELECT {IDX} AS spec_idx, l_orderkey AS doc")
    for i in range(len(Q.NODE_SPEC)):
        nodes = nodes.replace("{IDX}", str(i), 1)
    prods = ", ".join(f"('{p[0]}', {d}, {D.max_score(p)!r}, '{p[1]}')" for d, p in enumerate(D.PRODUCTS))
    kw_cases = " ".join(f"WHEN '{p[0]}' THEN {_kw_sum_sql('t.t', p[2])}" for p in D.PRODUCTS)
    return Q.with_ctes(Q.DOCS_CTE, nodes, _fuzzy_table(), _patterns_table(),
                       f"prod AS (SELECT * FROM (VALUES {prods}) v(product, def_order, max_score, product_name))") + f""",
terms AS (SELECT doc, part, lower(node_name) AS term, 'node' AS kind, min(spec_idx) AS first_ord FROM nodes GROUP BY ALL
          UNION ALL
          SELECT doc, part, lower(a) AS term, 'attr' AS kind, min(spec_idx) FROM
            (SELECT doc, part, spec_idx, unnest(attrs) AS a FROM nodes) GROUP BY ALL),
txt AS (SELECT doc, part, lower(string_agg(node_name || ' ' || coalesce(text, '') || ' ' || array_to_string(attrs, ' '), ' '))
          AS t FROM nodes GROUP BY doc, part),
hits AS (SELECT tm.doc, tm.part, p.product, p.kind, p.pattern_idx, 0 AS fuzzy, -1 AS first_ord, 0.0 AS sim
         FROM terms tm JOIN pat p ON p.pattern = tm.term AND p.kind = tm.kind
         UNION ALL
         SELECT tm.doc, tm.part, f.product, f.kind, f.pattern_idx, 1, tm.first_ord, f.sim
         FROM terms tm JOIN fz f ON f.term = tm.term AND f.kind = tm.kind),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, part, product, kind, pattern_idx
                                                    ORDER BY fuzzy, first_ord) AS rn FROM hits) WHERE rn = 1),
ev AS (SELECT doc, part, product,
              sum(CASE WHEN kind = 'node' AND fuzzy = 0 THEN 2.0 WHEN kind = 'node' THEN 1.5
                       WHEN fuzzy = 0 THEN 1.5 ELSE 1.0 END) AS pts,
              count(*) FILTER (WHERE kind = 'node') AS nm, count(*) FILTER (WHERE kind = 'attr') AS am,
              coalesce(sum(sim) FILTER (WHERE kind = 'node'), 0) AS fs
       FROM best GROUP BY ALL),
sc AS (SELECT t.doc, t.part, pr.product, pr.def_order,
              (CASE pr.product {kw_cases} END) + coalesce(ev.pts, 0)
              + CASE WHEN strpos(t.t, lower(pr.product)) > 0 THEN 3.0 ELSE 0.0 END AS raw,
              pr.max_score, pr.product_name, CASE pr.product {kw_cases} END AS km,
              coalesce(ev.nm, 0) AS nm, coalesce(ev.am, 0) AS am, coalesce(ev.fs, 0) AS fs
       FROM txt t CROSS JOIN prod pr LEFT JOIN ev ON ev.doc = t.doc AND ev.part = t.part AND ev.product = pr.product),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, part ORDER BY raw / max_score DESC, def_order) AS rn
                       FROM sc) WHERE rn = 1)
SELECT doc AS o_orderkey, part, CASE WHEN raw / max_score >= 0.2 THEN product END AS product_code,
       CAST(round(CASE WHEN raw / max_score >= 0.2 THEN raw / max_score ELSE 0.0 END, 4) AS DECIMAL(10,4)) AS confidence,
       CAST(raw AS DECIMAL(10,2)) AS raw_score, product_name, CAST(km AS BIGINT) AS keyword_matches,
       CAST(nm AS BIGINT) AS node_matches, CAST(am AS BIGINT) AS attribute_matches,
       CAST(round(fs, 4) AS DECIMAL(10,4)) AS fuzzy_score
FROM top
UNION ALL SELECT o_orderkey, part, NULL, CAST(0 AS DECIMAL(10,4)), NULL, NULL, NULL, NULL, NULL, NULL FROM all_docs WHERE parse_error IS NOT NULL"""


@query("product_detect", _product_detect_sql())
def product_detect(spark, sf):
    """Weighted-evidence product per order document, with its detail
    (each document is parsed once; nothing is shuffled)."""
    best = D.detect_products(_docs(spark, sf), DOC_KEYS)
    return best.select(*DOC_KEYS, "product_code",
                       F.round("confidence", 4).cast("decimal(10,4)").alias("confidence"),
                       F.col("raw_score").cast("decimal(10,2)").alias("raw_score"),
                       "product_name", F.col("keyword_matches").cast("bigint").alias("keyword_matches"),
                       "node_matches", "attribute_matches", F.round("fuzzy_score", 4).cast("decimal(10,4)").alias("fuzzy_score"))


# ================================================================= reference files
# Fixed file-name stems of the synthetic reference-file listing.
STEMS = ["old_mappings", "old_mappings_personal_auto", "old_mappings_homeowners", "old_mappings_commercial",
         "data_dictionary", "pa001_history", "umbrella_reference", "workers_comp_mapping", "silver_schema",
         "lookup_codes", "data_dictionary_pa001", "silver_schema_ho003_home", "reference_codes_wc001"]


def _files(spark, sf):
    p = read_table(spark, sf, "part")
    brand = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    stem = F.element_at(F.array(*[F.lit(s) for s in STEMS]), (brand % len(STEMS) + 1).cast("int"))
    name = F.concat(stem, F.lit("_"), F.regexp_replace("p_name", " ", "_"), F.lit("_"),
                    F.col("p_partkey").cast("string"), F.lit(".csv"))
    return p.select(name.alias("file_name"), "p_partkey", F.col("p_size").alias("row_count"))


_FILES_SQL = f"""files AS (SELECT {Q.sql_list(STEMS)}[CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) % {len(STEMS)} + 1]
   || '_' || replace(p_name, ' ', '_') || '_' || p_partkey || '.csv' AS file_name, p_partkey, p_size AS row_count FROM part)"""


def _relevance_sql(fl: str, p) -> str:
    s = [f"CASE WHEN strpos({fl}, '{p[0].lower()}') > 0 THEN 10.0 ELSE 0.0 END"]
    s += [f"CASE WHEN strpos({fl}, '{kw}') > 0 THEN 2.0 ELSE 0.0 END" for kw in p[2]]
    s += [f"CASE WHEN strpos({fl}, '{part}') > 0 THEN 1.5 ELSE 0.0 END" for part in R._name_parts(p[1])]
    s += [f"CASE WHEN strpos({fl}, 'mapping') > 0 AND strpos({fl}, 'old') > 0 THEN 0.5 ELSE 0.0 END"]
    return "CAST(" + " + ".join(s) + " AS DOUBLE)"


def _file_relevance_sql() -> str:
    parts = [f"SELECT file_name, '{p[0]}' AS product_code, {_relevance_sql('lower(file_name)', p)} AS score FROM files"
             for p in D.PRODUCTS]
    return (Q.with_ctes(_FILES_SQL) + "SELECT * FROM (" + " UNION ALL ".join(parts)
            + ") WHERE score > 0 AND score >= 1.0")


@query("file_relevance", _file_relevance_sql())
def file_relevance(spark, sf):
    """Relevance of every file for every product (exact tiers), kept
    when > 0 and >= 1.0, sorted by product, score desc, name."""
    s = R.file_relevance(_files(spark, sf), fuzzy=False)
    s = s.where((F.col("score") > 0) & (F.col("score") >= 1.0))
    return s.orderBy("product_code", F.desc("score"), "file_name").select("file_name", "product_code", "score")


@query("file_relevance_fuzzy")
def file_relevance_fuzzy(spark, sf):
    """R1 including the fuzzy name-word tier (similarity > 0.85)."""
    s = R.file_relevance(_files(spark, sf), fuzzy=True)
    return s.where((F.col("score") > 0) & (F.col("score") >= 1.0)).select("file_name", "product_code", "score")


def _classify_sql() -> str:
    cat = "'not_relevant'"
    for c, pat in reversed(R.CLASS_RULES):
        cat = f"CASE WHEN regexp_matches(lower(file_name), '{pat}') THEN '{c}' ELSE {cat} END"
    best = "greatest(" + ", ".join(_relevance_sql("lower(file_name)", p) for p in D.PRODUCTS) + ")"
    return f"classified AS (SELECT *, {cat} AS category, least(CAST(100 AS DOUBLE), {best} * 5) AS relevance FROM files)"


@query("classify_files", Q.with_ctes(_FILES_SQL, _classify_sql()) + "SELECT file_name, category, relevance FROM classified")
def classify_files(spark, sf):
    """R7 (rule-based): category and 0-100 relevance per file."""
    return R.classify_files(_files(spark, sf)).select("file_name", "category", "relevance")


_TOPN_SQL = """top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category
                                     ORDER BY relevance DESC, file_name) AS INTEGER) AS rank
        FROM classified WHERE category <> 'not_relevant' AND relevance > 20) WHERE rank <= 3)"""


@query("topn_per_category", Q.with_ctes(_FILES_SQL, _classify_sql(), _TOPN_SQL) +
       "SELECT category, file_name, relevance, rank FROM top")
def topn_per_category(spark, sf):
    """Top 3 relevant files per category."""
    t = R.top_per_category(R.classify_files(_files(spark, sf)), 3)
    return t.select("category", "file_name", "relevance", "rank")


@query("category_summary", Q.with_ctes(_FILES_SQL, _classify_sql(), _TOPN_SQL) +
       "SELECT category, count(*) AS files, CAST(sum(row_count) AS BIGINT) AS rows FROM top GROUP BY category")
def category_summary(spark, sf):
    """Files and rows loaded per category."""
    t = R.top_per_category(R.classify_files(_files(spark, sf)), 3)
    return R.category_summary(t).withColumn("rows", F.col("rows").cast("bigint"))


# ================================================================= text sources
_DECLARATION = '<?xml version="1.0"?>'


@query("prolog_repair", f"""
SELECT src, id, CASE WHEN strpos(t, '<?xml') = 1 THEN 'ok' WHEN strpos(t, '<?xml') > 1 THEN 'fixed'
                     ELSE 'no_declaration' END AS repair_status,
       CAST(length(CASE WHEN strpos(t, '<?xml') > 1 THEN substr(t, strpos(t, '<?xml')) ELSE t END) AS INTEGER)
         AS repaired_length
FROM (SELECT src, id, CASE id % 3 WHEN 0 THEN '{_DECLARATION}' || t WHEN 1 THEN 'mail header' || chr(10) || '{_DECLARATION}' || t
                                  ELSE t END AS t
      FROM (SELECT 'page' AS src, page_id AS id, html AS t FROM pages
            UNION ALL SELECT 'document', doc_id, text FROM documents))""")
def prolog_repair(spark, sf):
    """S6 over page HTML and document text, a third each with a declaration,
    with junk before it, and without one."""
    from docmap.sources.bronze import repair_prolog
    pages = read_table(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                                 F.col("html").alias("t"))
    docs = read_table(spark, sf, "documents").select(F.lit("document").alias("src"), F.col("doc_id").alias("id"),
                                                    F.col("text").alias("t"))
    raw = (F.when(F.col("id") % 3 == 0, F.concat(F.lit(_DECLARATION), "t"))
           .when(F.col("id") % 3 == 1, F.concat(F.lit("mail header\n" + _DECLARATION), "t")).otherwise(F.col("t")))
    r = repair_prolog(pages.unionByName(docs).select("src", "id", raw.alias("raw_xml")))
    return r.select("src", "id", "repair_status", F.length("raw_xml").alias("repaired_length"))


@query("preview_length", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS doc_length, substr(text, 1, 2000) AS preview,
       length(text) > 2000 AS truncated
FROM documents""")
def preview_length(spark, sf):
    """Document length, 2,000-character preview and truncated flag."""
    from docmap.sources.bronze import document_preview
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return document_preview(d, "text").select("doc_id", "doc_length", "preview", "truncated")


# ================================================================= XML -> JSON
def _json_sql(account_id: str) -> str:
    return Q.with_ctes(Q.DOCS_CTE) + f"""
SELECT d.o_orderkey, d.part, CAST(d.o_orderkey AS VARCHAR) AS policy_number, {account_id} AS account_id,
       CASE WHEN d.c_mktsegment = 'AUTOMOBILE' THEN 'VIN' || lpad(CAST(d.c_custkey AS VARCHAR), 10, '0') END AS vehicle_vin,
       count(r.l_orderkey) AS n_coverages,
       CAST(max(CASE WHEN r.record_index = 0 THEN r.l_partkey END) AS VARCHAR) AS first_coverage_code
FROM docs d LEFT JOIN recs r ON r.l_orderkey = d.o_orderkey AND r.part = d.part
GROUP BY d.o_orderkey, d.part, d.c_mktsegment, d.c_custkey
UNION ALL SELECT o_orderkey, part, NULL, NULL, NULL, 0, NULL FROM all_docs WHERE parse_error IS NOT NULL"""


def _json_q(spark, sf, convention: str, account_path: str):
    from docmap.operators.xmljson import to_variant
    v = to_variant(_docs(spark, sf), convention=convention).select(*DOC_KEYS, "xml_data")
    j = F.col("xml_data")
    cov = "$.Data.Coverages.Coverage"
    n = F.coalesce(F.array_size(F.try_variant_get(j, cov, "array<variant>")),
                   F.when(F.try_variant_get(j, cov, "variant").isNotNull(), F.lit(1)), F.lit(0)).cast("bigint")
    first = F.coalesce(F.try_variant_get(j, cov + "[0].CoverageCode", "string"),
                       F.try_variant_get(j, cov + ".CoverageCode", "string"))
    return v.select(*DOC_KEYS,
                    F.try_variant_get(j, "$.Data.Policy.PolicyNumber", "string").alias("policy_number"),
                    F.try_variant_get(j, account_path, "string").alias("account_id"),
                    F.try_variant_get(j, "$.Data.Vehicle.VIN", "string").alias("vehicle_vin"),
                    n.alias("n_coverages"), first.alias("first_coverage_code"))


@query("xml_to_json_a", _json_sql("'C' || d.c_custkey"))
def xml_to_json_a(spark, sf):
    """S3: documents as VARIANT (``@attributes``, repeated tags as arrays)."""
    return _json_q(spark, sf, "a", "$.Data.Account['@attributes'].id")


@query("xml_to_json_b", _json_sql("'C' || d.c_custkey"))
def xml_to_json_b(spark, sf):
    """Documents as VARIANT (attributes merged into the object)."""
    return _json_q(spark, sf, "b", "$.Data.Account.id")


# ================================================================= prediction, replies
_HIST_SQL = """h AS (SELECT source_node AS h_path, target_table, target_column FROM ledger
                     WHERE approval_status = 'Approved' AND source_node IS NOT NULL)"""


def _document_paths(spark, sf):
    """The path vocabulary, written once: every tier reads it."""
    paths = path_summary(_docs(spark, sf)).where(F.col("node_path") != UNPARSED)
    return written(paths.select(F.col("node_path").alias("xpath")), "paths")


@query("predict_mappings", Q.with_ctes(Q.DOCS_CTE, Q.nodes_cte(), Q.LEDGER_CTE, _HIST_SQL) + """,
paths AS (SELECT DISTINCT node_path AS xpath FROM nodes),
u AS (SELECT p.xpath, h.target_table, h.target_column, 0.95 AS conf, 'history: same path' AS reasoning
      FROM paths p JOIN h ON h.h_path = p.xpath
      UNION ALL
      SELECT p.xpath, hb.target_table, hb.target_column, 0.90, 'history: same element name'
      FROM paths p JOIN (SELECT DISTINCT split_part(h_path, '/', -1) AS step, target_table, target_column FROM h) hb
        ON hb.step = split_part(p.xpath, '/', -1)),
r AS (SELECT *, row_number() OVER (PARTITION BY xpath ORDER BY conf DESC, target_table, target_column, reasoning) AS rn
      FROM u)
SELECT xpath AS source_node, target_table, target_column, CAST(NULL AS VARCHAR) AS transformation_logic,
       CAST(conf AS DOUBLE) AS confidence_score, reasoning FROM r WHERE rn = 1""")
def predict_mappings(spark, sf):
    """M8/M9: best mapping per document path from approved history (same path,
    then same element name)."""
    paths = _document_paths(spark, sf)
    hist = mapping_ledger(spark, sf).where("approval_status = 'Approved' AND source_node IS NOT NULL")
    return predict(paths, hist)


def _name_similarity_sql() -> str:
    """Tier (c) over the testbed's fixed paths and columns, by the plain rules."""
    rows = []
    for path in sorted({p for p, *_ in Q.NODE_SPEC}):
        section = next((x for x in path.split("/") if any(k in x.lower() for k in SECTION_KEYWORDS)), "General").lower()
        table = next((t for k, t in ROUTING if k in section and t in SILVER), list(SILVER)[0])
        step = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", path.rsplit("/", 1)[1])).lower()
        rows += [f"('{path}', '{table}', '{c}', {0.5 + 0.4 * SequenceMatcher(None, step, c.lower()).ratio()!r})"
                 for c, _ in SILVER[table]]
    return f"sim AS (SELECT * FROM (VALUES {', '.join(rows)}) v(xpath, target_table, target_column, conf))"


@query("predict_mappings_similarity", Q.with_ctes(Q.DOCS_CTE, Q.nodes_cte(), Q.LEDGER_CTE, _HIST_SQL, _name_similarity_sql()) + """,
paths AS (SELECT DISTINCT node_path AS xpath FROM nodes),
u AS (SELECT p.xpath, h.target_table, h.target_column, 0.95::DOUBLE AS conf, 'history: same path' AS reasoning
      FROM paths p JOIN h ON h.h_path = p.xpath
      UNION ALL
      SELECT p.xpath, hb.target_table, hb.target_column, 0.90::DOUBLE, 'history: same element name'
      FROM paths p JOIN (SELECT DISTINCT split_part(h_path, '/', -1) AS step, target_table, target_column FROM h) hb
        ON hb.step = split_part(p.xpath, '/', -1)
      UNION ALL SELECT xpath, target_table, target_column, conf::DOUBLE, 'name similarity' FROM sim JOIN paths USING (xpath)),
r AS (SELECT *, row_number() OVER (PARTITION BY xpath ORDER BY conf DESC, target_table, target_column, reasoning) AS rn FROM u)
SELECT xpath AS source_node, target_table, target_column, CAST(NULL AS VARCHAR) AS transformation_logic,
       round(conf, 6) AS confidence_score, reasoning FROM r WHERE rn = 1""")
def predict_mappings_similarity(spark, sf):
    """M8 tier (c): name similarity of each path's last step to the routed
    table's columns (Arrow UDF on distinct candidate pairs)."""
    from docmap.operators.predict import candidates
    from docmap.sources.catalog import catalog_from_schema
    paths = _document_paths(spark, sf)
    pairs = candidates(paths, catalog_from_schema(spark), list(SILVER))
    hist = mapping_ledger(spark, sf).where("approval_status = 'Approved' AND source_node IS NOT NULL")
    return predict(paths, hist, pairs=pairs).withColumn("confidence_score", F.round("confidence_score", 6))


@query("result_summary", Q.with_ctes(Q.LEDGER_CTE) + """
SELECT target_table, count(*) AS total_mappings FROM ledger WHERE source_node IS NOT NULL GROUP BY 1""")
def result_summary_q(spark, sf):
    """M9: mappings per result set (an empty set has no row)."""
    from docmap.operators.predict import result_summary
    return result_summary(mapping_ledger(spark, sf).where("source_node IS NOT NULL"), ["target_table"])


@query("mapping_contract", Q.with_ctes(Q.LEDGER_CTE) + """
SELECT mapping_id, CASE WHEN line_no = 2 THEN 'missing: reasoning' WHEN line_no = 3 THEN 'extra: notes'
                        WHEN source_node IS NULL THEN 'null field'
                        WHEN line_no = 4 THEN 'confidence outside 0 to 1' END AS reason
FROM ledger""")
def mapping_contract_q(spark, sf):
    """Mapping objects with missing fields, extra fields, nulls and wrong confidence."""
    from docmap.operators.predict import contract_violation
    c = F.when(F.col("line_no") == 4, F.lit(1.5)).otherwise(F.col("confidence_score").cast("double")).alias("confidence_score")
    base = ["source_node", "target_table", "target_column", "transformation_logic"]
    as_json = lambda *extra: F.to_json(F.struct(*base, c, *extra), {"ignoreNullFields": "false"})
    text = (F.when(F.col("line_no") == 2, as_json()).when(F.col("line_no") == 3, as_json("reasoning", F.lit("x").alias("notes")))
            .otherwise(as_json("reasoning")))
    return mapping_ledger(spark, sf).select("mapping_id", contract_violation(text).alias("reason"))


@query("generic_file_fallback", Q.with_ctes(_FILES_SQL) + f""",
scored AS (SELECT * FROM ({_file_relevance_sql().split("SELECT * FROM (", 1)[1].rsplit(") WHERE", 1)[0]})
           WHERE score >= 10 AND product_code <> 'CP001'),
p AS (SELECT * FROM (VALUES {', '.join(f"('{p[0]}')" for p in D.PRODUCTS)}) v(product_code))
SELECT file_name, product_code, score, false AS is_generic FROM scored
UNION ALL SELECT 'old_mappings.csv', product_code, 0.0::DOUBLE, true FROM p
WHERE product_code NOT IN (SELECT product_code FROM scored)""")
def generic_file_fallback(spark, sf):
    """Products without a relevant file get the generic one."""
    s = R.file_relevance(_files(spark, sf), fuzzy=False).where("product_code <> 'CP001'")
    return R.with_generic_file(s, [p[0] for p in D.PRODUCTS], "old_mappings.csv", threshold=10.0).select(
        "file_name", "product_code", "score", "is_generic")


@query("document_metadata", _NODES + f"""
SELECT doc AS o_orderkey, part, count(*) AS node_count, count(DISTINCT node_path) AS distinct_paths,
       {', '.join(f"count(*) FILTER (WHERE ty = '{t}') AS n_{t}" for t in ('integer', 'decimal', 'date', 'timestamp', 'boolean', 'string'))}, 'ok' AS parse_status
FROM (SELECT *, {Q.infer_type_sql('text')} AS ty FROM nodes) GROUP BY doc, part
UNION ALL SELECT o_orderkey, part, 0, 0, 0, 0, 0, 0, 0, 0, parse_error FROM all_docs WHERE parse_error IS NOT NULL""")
def document_metadata_q(spark, sf):
    """Nodes, distinct paths, nodes per type and parse status of every document."""
    from docmap.operators.nodes import document_metadata, document_profile
    return document_metadata(document_profile(_docs(spark, sf), DOC_KEYS), DOC_KEYS)


def _replies(spark, sf):
    led = mapping_ledger(spark, sf)
    item = F.to_json(F.array(F.struct("source_node", "target_column", F.col("confidence_score"), "reasoning")))
    ln = F.col("line_no")
    reply = (F.when(ln == 1, F.concat(F.lit("```json\n"), item, F.lit("\n```")))
             .when(ln == 2, F.concat(F.lit('{"mappings": '), item, F.lit("}")))
             .when(ln == 3, F.to_json(F.struct(F.array(F.struct("source_node")).alias("mapping"))))
             .when(ln == 4, F.lit("Sorry, I cannot map these nodes."))
             .otherwise(item))
    return led.select("mapping_id", reply.alias("reply"), F.col("target_table").alias("routed_table"))


@query("parse_replies", Q.with_ctes(Q.LEDGER_CTE) + """
SELECT mapping_id, CAST(0 AS INTEGER) AS item_index, source_node, target_table, target_column,
       CAST(NULL AS VARCHAR) AS transformation_logic, CAST(confidence_score AS DOUBLE) AS confidence_score, reasoning
FROM ledger WHERE line_no IN (1, 2, 5, 6, 7) AND source_node IS NOT NULL""")
def parse_replies_q(spark, sf):
    """Proposal replies (fenced, wrapped, bare, broken) -> mapping rows."""
    return parse_replies(_replies(spark, sf), ["mapping_id"])


# ================================================================= vectors
@query("cosine_topk", """
WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label < 5),
t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label >= 5),
p AS (SELECT s.vec_id AS src_id, t.vec_id AS tgt_id, list_dot_product(s.e, t.e) AS score FROM s, t),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY src_id ORDER BY score DESC, tgt_id) AS INTEGER) AS rank FROM p)
SELECT src_id, tgt_id, CAST(round(score, 4) AS DECIMAL(10,4)) AS score, rank FROM r WHERE rank <= 5""")
def cosine_topk_q(spark, sf):
    """M7: top 5 targets (label >= 5) per source vector (label < 5)."""
    from docmap.operators.vectors import cosine_topk
    e = read_table(spark, sf, "embeddings")
    r = cosine_topk(e.where("label < 5"), e.where("label >= 5"), k=5)
    return r.select("src_id", "tgt_id", F.round("score", 4).cast("decimal(10,4)").alias("score"), "rank")


# ================================================================= cost
N_COLUMNS = sum(len(c) for c in SILVER.values())
N_HISTORY = len(DOC_MAPPINGS)


def _cost_sql_cols(n: str, c: str, h: str) -> str:
    tin = f"CAST({n} * 50 + {c} * 40 + {h} * 60 + 500 AS BIGINT)"
    tout = f"CAST({c} * 80 AS BIGINT)"
    cin = f"CAST(CAST({tin} AS DECIMAL(20,8)) * CAST('0.0025' AS DECIMAL(20,8)) / 1000 AS DECIMAL(20,8))"
    cout = f"CAST(CAST({tout} AS DECIMAL(20,8)) * CAST('0.01' AS DECIMAL(20,8)) / 1000 AS DECIMAL(20,8))"
    return (f"{tin} AS input_tokens, {tout} AS output_tokens, {cin} AS input_cost, {cout} AS output_cost, "
            f"CAST({cin} + {cout} AS DECIMAL(20,8)) AS total_cost")


@query("cost_estimate", _NODES + f"""
SELECT doc AS o_orderkey, part, node_count, {_cost_sql_cols('node_count', str(N_COLUMNS), str(N_HISTORY))}
FROM (SELECT doc, part, count(*) AS node_count FROM nodes GROUP BY doc, part
      UNION ALL SELECT o_orderkey, part, 0 FROM all_docs WHERE parse_error IS NOT NULL)""")
def cost_estimate(spark, sf):
    """Token and cost estimate per document (nodes x catalog columns x
    history); a document that does not parse has no nodes."""
    n = node_counts(_docs(spark, sf), DOC_KEYS)
    e = C.estimate_cost(n, F.col("node_count"), F.lit(N_COLUMNS), F.lit(N_HISTORY))
    return e.drop("model")


_CALLS_SQL = f"""calls AS (SELECT xml_id, doc_key, max(created_date) AS ts,
   {_cost_sql_cols('count(*)', str(N_COLUMNS), '0')} FROM ledger GROUP BY xml_id, doc_key)"""


def _calls(spark, sf):
    led = mapping_ledger(spark, sf)
    g = led.groupBy("xml_id", "doc_key").agg(F.max("created_date").alias("ts"), F.count(F.lit(1)).alias("n"))
    return C.estimate_cost(g, F.col("n"), F.lit(N_COLUMNS), F.lit(0))


@query("cost_running", Q.with_ctes(Q.LEDGER_CTE, _CALLS_SQL) + """
SELECT xml_id, ts, total_cost,
       CAST(sum(total_cost) OVER (ORDER BY ts, doc_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,8))
         AS cumulative
FROM calls""")
def cost_running(spark, sf):
    """Running cumulative cost in call order (distributed prefix sum)."""
    ensure_checkpoint_dir(spark)
    r = C.running_sum(_calls(spark, sf).select("xml_id", "doc_key", "ts", "total_cost"), ["ts", "doc_key"],
                      "total_cost")
    return r.select("xml_id", "ts", "total_cost", F.col("cumulative").cast("decimal(38,8)").alias("cumulative"))


@query("cost_summary", Q.with_ctes(Q.LEDGER_CTE, _CALLS_SQL) + """
SELECT count(*) AS calls, CAST(coalesce(sum(total_cost), 0) AS DECIMAL(20,8)) AS total_cost,
       CAST(coalesce(avg(total_cost), 0) AS DECIMAL(20,8)) AS avg_cost FROM calls""")
def cost_summary(spark, sf):
    """Calls, total and average cost."""
    return C.usage_summary(_calls(spark, sf))


# ================================================================= dictionary, reconciliation, rules
@query("dictionary_summary", _NODES + f""",
typed AS (SELECT DISTINCT CASE WHEN length(node_path) - length(replace(node_path, '/', '')) > 1
                               THEN regexp_replace(node_path, '/[^/]*$', '') END AS parent_path,
                          node_path, {Q.infer_type_sql('text')} AS data_type FROM nodes),
per AS (SELECT parent_path, data_type, count(*) AS n FROM typed WHERE parent_path IS NOT NULL GROUP BY 1, 2)
SELECT parent_path, CAST(sum(n) AS BIGINT) AS column_count,
       string_agg(data_type || '=' || n, ',' ORDER BY data_type || '=' || n) AS type_histogram
FROM per GROUP BY parent_path
UNION ALL SELECT '!unparsed', 0, string_agg(parse_error || '=' || n, ',' ORDER BY parse_error || '=' || n)
FROM (SELECT parse_error, count(*) AS n FROM all_docs WHERE parse_error IS NOT NULL GROUP BY 1) HAVING count(*) > 0""")
def dictionary_summary(spark, sf):
    """Q12: per document section (parent path): typed columns and type
    histogram; documents that do not parse are counted by kind of error."""
    p = node_profile(xml_nodes(_docs(spark, sf), by=["node_path", "text"]))
    bad = F.col("parse_error").isNotNull()
    cat = p.where(bad | F.col("parent_path").isNotNull()).groupBy(
        F.when(bad, UNPARSED).otherwise(F.col("parent_path")).alias("parent_path"), "node_path",
        F.when(bad, error_kind("parse_error")).otherwise(F.col("data_type")).alias("data_type")).agg(F.sum("n").alias("n"))
    summary = QL.dictionary_summary(cat, "parent_path", "data_type", F.when(F.col("parent_path") == UNPARSED, F.col("n")).otherwise(1))
    return summary.withColumn("column_count", F.when(F.col("parent_path") == UNPARSED, 0).otherwise(F.col("column_count")).cast("bigint"))


_PLANTED_SQL = """
s AS (SELECT CASE WHEN l_partkey % 101 <> 0 THEN l_orderkey END AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
             CAST(l_quantity AS DECIMAL(15,2)) AS q, CAST(l_extendedprice AS DECIMAL(15,2)) AS a,
             CAST(l_shipdate AS DATE) AS d FROM lineitem),
t0 AS (SELECT CASE WHEN l_partkey % 101 <> 0 THEN l_orderkey END AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
              CAST(CASE WHEN l_partkey % 89 = 0 THEN l_quantity + 1 ELSE l_quantity END AS DECIMAL(15,2)) AS q,
              CAST(l_extendedprice AS DECIMAL(15,2)) AS a, CAST(l_shipdate AS DATE) AS d
       FROM recs WHERE l_partkey % 97 <> 0),
t AS (SELECT * FROM t0 UNION ALL SELECT * FROM t0 WHERE k3 % 83 = 0)"""


@query("reconcile", Q.with_ctes(Q.DOCS_CTE, _PLANTED_SQL) + """,
sn AS (SELECT *, row_number() OVER (PARTITION BY k1, k2, k3, k4, q, a, d) AS rn FROM s),
tn AS (SELECT *, row_number() OVER (PARTITION BY k1, k2, k3, k4, q, a, d) AS rn FROM t),
j AS (SELECT coalesce(sn.k1, tn.k1) AS k1, coalesce(sn.k2, tn.k2) AS k2, coalesce(sn.k3, tn.k3) AS k3,
             coalesce(sn.k4, tn.k4) AS k4, sn.rn IS NOT NULL AS in_s, tn.rn IS NOT NULL AS in_t
      FROM sn FULL OUTER JOIN tn ON sn.k1 IS NOT DISTINCT FROM tn.k1 AND sn.k2 = tn.k2 AND sn.k3 = tn.k3 AND sn.k4 = tn.k4
        AND sn.q IS NOT DISTINCT FROM tn.q AND sn.a IS NOT DISTINCT FROM tn.a AND sn.d IS NOT DISTINCT FROM tn.d
        AND sn.rn = tn.rn),
k AS (SELECT k1, k2, k3, k4, count(*) FILTER (WHERE in_s) AS s, count(*) FILTER (WHERE in_t) AS t,
             count(*) FILTER (WHERE in_s AND in_t) AS m FROM j GROUP BY ALL),
x AS (SELECT *, least(s, t) - m AS mm, greatest(s - t, 0) AS mi, greatest(t - s, 0) AS ex FROM k),
top AS (SELECT *, row_number() OVER (ORDER BY k1 NULLS FIRST, k2, k3, k4) AS n FROM x WHERE mm + mi + ex > 0
        ORDER BY k1 NULLS FIRST, k2, k3, k4 LIMIT 5),
vals AS (SELECT k1, k2, k3, k4, '{"q":' || q || ',"a":' || a || ',"d":"' || d || '"}' AS v, sum(w) AS dd
         FROM (SELECT *, 1 AS w FROM s UNION ALL SELECT *, -1 FROM t) GROUP BY ALL HAVING sum(w) <> 0),
least AS (SELECT n, '{"extra_in_target":' || ex || ',"key":{' || CASE WHEN top.k1 IS NULL THEN '' ELSE '"k1":"' || top.k1 || '",' END
            || '"k2":"' || top.k2 || '","k3":"' || top.k3 || '","k4":"' || top.k4 || '"},"mismatch_count":' || mm || ',"missing_in_target":' || mi
            || ',"n":' || n || coalesce(',"source_value":"' || replace(min(v) FILTER (WHERE dd > 0), '"', '\\"') || '"', '')
            || coalesce(',"target_value":"' || replace(min(v) FILTER (WHERE dd < 0), '"', '\\"') || '"', '') || '}' AS item
          FROM top LEFT JOIN vals ON vals.k1 IS NOT DISTINCT FROM top.k1 AND vals.k2 = top.k2 AND vals.k3 = top.k3 AND vals.k4 = top.k4
          GROUP BY n, top.k1, top.k2, top.k3, top.k4, mm, mi, ex)
SELECT CAST(sum(s) AS BIGINT) AS source_count, CAST(sum(t) AS BIGINT) AS target_count, CAST(sum(m) AS BIGINT) AS match_count,
       CAST(sum(mm) AS BIGINT) AS mismatch_count, CAST(sum(mi) AS BIGINT) AS missing_in_target,
       CAST(sum(ex) AS BIGINT) AS extra_in_target,
       CASE WHEN sum(mm) = 0 AND sum(mi) = 0 AND sum(ex) = 0 THEN 'MATCHED' ELSE 'DIFFERENCES' END AS status,
       '{"keys_compared":' || count(*) || ',"keys_extra_in_target":' || count(*) FILTER (WHERE ex > 0)
         || ',"keys_mismatch_count":' || count(*) FILTER (WHERE mm > 0)
         || ',"keys_missing_in_target":' || count(*) FILTER (WHERE mi > 0)
         || (SELECT ',"sample":[' || coalesce(string_agg(item, ',' ORDER BY n), '') || ']}' FROM least) AS details
FROM x""")
def reconcile(spark, sf):
    """Q13: line items vs COVERAGE records extracted from the documents, with
    planted NULL keys, dropped rows, changed values, repeated rows and
    documents that do not parse; the five least differing keys in ``details``."""
    k3 = F.col("k3")
    k1 = F.when(k3 % 101 != 0, F.col("k1")).alias("k1")
    rest = ["k2", "k3", "k4"]
    li = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"),
        F.col("l_suppkey").alias("k4"), F.col("l_quantity").cast("decimal(15,2)").alias("q"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("a"), F.col("l_shipdate").cast("date").alias("d"))
    cov = _silver(spark, sf, "COVERAGE", record_path=COVERAGE_RECORD).where(F.col("coverage_ref").isNotNull())
    tgt = cov.select(F.col("policy_number").cast("bigint").alias("k1"), F.col("line_number").alias("k2"),
                     F.col("coverage_code").alias("k3"), F.col("supplier_code").alias("k4"),
                     F.col("quantity").alias("q"), F.col("limit_amount").alias("a"), F.col("ship_date").alias("d"))
    changed = F.when(k3 % 89 == 0, F.col("q") + 1).otherwise(F.col("q")).cast("decimal(15,2)").alias("q")
    times = F.when(k3 % 83 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    tgt = tgt.where(k3 % 97 != 0).select(k1, *rest, changed, "a", "d", F.explode(times).alias("_copy")).drop("_copy")
    r = QL.reconcile(li.select(k1, *rest, "q", "a", "d"), tgt, ["k1", *rest], ["q", "a", "d"])
    return r.withColumn("details", F.to_json("details"))


@query("dictionary_totals", _NODES + """
SELECT count(DISTINCT CASE WHEN length(node_path) - length(replace(node_path, '/', '')) > 1
                           THEN regexp_replace(node_path, '/[^/]*$', '') END) AS tables,
       count(DISTINCT CASE WHEN length(node_path) - length(replace(node_path, '/', '')) > 1 THEN node_path END) AS columns
FROM nodes""")
def dictionary_totals(spark, sf):
    """Q12: number of sections and of their fields in all."""
    from docmap.operators.nodes import parent_path
    paths = path_summary(_docs(spark, sf)).where(F.col("node_path") != UNPARSED)
    cat = paths.select(parent_path("node_path").alias("parent_path"), F.lit("any").alias("data_type")).where("parent_path IS NOT NULL")
    return QL.dictionary_totals(QL.dictionary_summary(cat, "parent_path", "data_type"))


# Dictionary rows of the source tables: table, column, type, rule sentences.
DICTIONARY = [
    ("orders", "o_orderkey", "BIGINT", "Must be unique and not null. Primary key."),
    ("orders", "o_custkey", "BIGINT", "Must be unique within customer. Foreign key to CUSTOMER table. Not null."),
    ("orders", "o_orderstatus", "VARCHAR(1)", "Values: F, O. Uppercase format preferred."),
    ("orders", "o_totalprice", "DECIMAL(15,2)", "Must be positive. Includes all fees and taxes."),
    ("orders", "o_orderdate", "DATE", "Must be a valid date. Must be <= current date. Not null."),
    ("orders", "o_orderpriority", "INTEGER", "Standardized values only"),
    ("orders", "o_expiry", "DATE", "Must be after o_orderdate."),
    ("SILVER.LINEITEM", "l_quantity", "INTEGER", "Positive number. Must be between 1 and 40."),
    ("SILVER.LINEITEM", "l_discount", "DECIMAL(5,2)", "Can be zero or positive."),
    ("SILVER.LINEITEM", "l_returnflag", "VARCHAR(1)", "1 chars. Lowercase preferred. Must be one of: A, N, or R."),
    ("SILVER.LINEITEM", "l_shipdate", "TIMESTAMP_NTZ", "Must be after o_orderdate. Must be before l_receiptdate."),
    ("customer", "c_acctbal", "DECIMAL(15,2)", "Must be positive. Can be null."),
    ("customer", "c_mktsegment", "VARCHAR(20)", "Unique"),
]


def _rules_sql() -> str:
    """The dictionary's rules one by one, written out by hand."""
    one = lambda table, col, rule, kind, cond, frm: (
        f"SELECT '{table}' AS table_name, '{col}' AS column_name, '{rule}' AS rule, '{kind}' AS kind, 'checked' AS status, "
        f"count({col}) AS checked, count(*) FILTER (WHERE {col} IS NOT NULL AND NOT ({cond})) AS violations FROM {frm}")
    none = lambda table, col, rule, kind, why: (
        f"SELECT '{table}', '{col}', '{rule}', '{kind}', 'not checked: {why}', NULL, NULL")
    unique = lambda table, col, rule, kind: (
        f"SELECT '{table}', '{col}', '{rule}', '{kind}', 'checked', count({col}), count({col}) - count(DISTINCT {col}) FROM {table}")
    o, li, c = "orders", "lineitem", "customer"
    lo = "(SELECT * FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
    return " UNION ALL ".join([
        one(o, "o_orderkey", "BIGINT", "type", "TRUE", o), unique(o, "o_orderkey", "Must be unique and not null", "unique and not null"),
        unique(o, "o_orderkey", "Primary key", "unique"),
        one(o, "o_custkey", "BIGINT", "type", "TRUE", o), unique(o, "o_custkey", "Must be unique within customer", "unique"),
        none(o, "o_custkey", "Foreign key to CUSTOMER table", "unknown", "no shape for this rule"),
        one(o, "o_custkey", "Not null", "not null", "TRUE", o).replace("count(o_custkey) AS checked", "count(*) AS checked"),
        one(o, "o_orderstatus", "VARCHAR(1)", "type", "TRUE", o), one(o, "o_orderstatus", "Values: F, O", "list", "o_orderstatus IN (''F'', ''O'')".replace("''", "'"), o),
        one(o, "o_orderstatus", "Uppercase format preferred", "upper case", "o_orderstatus = upper(o_orderstatus)", o),
        one(o, "o_totalprice", "DECIMAL(15,2)", "type", "TRUE", o), one(o, "o_totalprice", "Must be positive", "positive", "o_totalprice > 0", o),
        none(o, "o_totalprice", "Includes all fees and taxes", "unknown", "no shape for this rule"),
        one(o, "o_orderdate", "DATE", "type", "TRUE", o), one(o, "o_orderdate", "Must be a valid date", "date", "TRUE", o),
        one(o, "o_orderdate", "Must be <= current date", "date against today", "o_orderdate <= current_date", o),
        one(o, "o_orderdate", "Not null", "not null", "TRUE", o).replace("count(o_orderdate) AS checked", "count(*) AS checked"),
        one(o, "o_orderpriority", "INTEGER", "type", "TRY_CAST(o_orderpriority AS INTEGER) IS NOT NULL", o),
        none(o, "o_orderpriority", "Standardized values only", "unknown", "no shape for this rule"),
        none(o, "o_expiry", "DATE", "missing column", "no column o_expiry"),
        none(o, "o_expiry", "Must be after o_orderdate", "missing column", "no column o_expiry"),
        one(li, "l_quantity", "INTEGER", "type", "TRUE", lo), one(li, "l_quantity", "Positive number", "positive", "l_quantity > 0", lo),
        one(li, "l_quantity", "Must be between 1 and 40", "range", "l_quantity BETWEEN 1 AND 40", lo),
        one(li, "l_discount", "DECIMAL(5,2)", "type", "TRUE", lo), one(li, "l_discount", "Can be zero or positive", "not negative", "l_discount >= 0", lo),
        one(li, "l_returnflag", "VARCHAR(1)", "type", "TRUE", lo), one(li, "l_returnflag", "1 chars", "length", "length(l_returnflag) = 1", lo),
        one(li, "l_returnflag", "Lowercase preferred", "lower case", "l_returnflag = lower(l_returnflag)", lo),
        one(li, "l_returnflag", "Must be one of: A, N, or R", "list", "l_returnflag IN ('A', 'N', 'R')", lo),
        one(li, "l_shipdate", "TIMESTAMP_NTZ", "type", "TRUE", lo),
        one(li, "l_shipdate", "Must be after o_orderdate", "order of columns", "l_shipdate > o_orderdate", lo),
        none(li, "l_shipdate", "Must be before l_receiptdate", "order of columns", "no column l_receiptdate"),
        one(c, "c_acctbal", "DECIMAL(15,2)", "type", "TRUE", c), one(c, "c_acctbal", "Must be positive", "positive", "c_acctbal > 0", c),
        one(c, "c_acctbal", "Can be null", "nullable", "TRUE", c),
        one(c, "c_mktsegment", "VARCHAR(20)", "type", "TRUE", c), unique(c, "c_mktsegment", "Unique", "unique")])


@query("rule_conformance", _rules_sql())
def rule_conformance(spark, sf):
    """Q14: the rules of a dictionary table compiled to predicates, with rows
    checked and violations, and a row for each rule that cannot be checked."""
    from docmap.operators.rules import DICTIONARY_SCHEMA, conformance
    rules = spark.createDataFrame(DICTIONARY, DICTIONARY_SCHEMA)
    o, li = read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")
    lines = li.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return (conformance(o, "orders", rules).unionByName(conformance(lines, "lineitem", rules))
            .unionByName(conformance(read_table(spark, sf, "customer"), "customer", rules)))


# ================================================================= rank fusion
def _fusion_names() -> tuple[list[str], list[tuple[str, str]]]:
    return sorted({p for p, *_ in Q.NODE_SPEC}), [(t, c) for t, cols in SILVER.items() for c, _ in cols]


def _predict_fused_sql() -> str:
    paths, columns = _fusion_names()
    sim = []
    for i, path in enumerate(paths):
        step = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", path.rsplit("/", 1)[1])).lower()
        sim += [f"({i},{j},{SequenceMatcher(None, step, c.lower()).ratio()!r})" for j, (_, c) in enumerate(columns)]
    return f"""
WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label < 5),
t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label >= 5),
p AS (SELECT s.vec_id AS src_id, t.vec_id AS tgt_id, list_dot_product(s.e, t.e) AS score FROM s, t),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY score DESC, tgt_id) AS vector_rank FROM p) WHERE vector_rank <= 10),
sim AS (SELECT * FROM (VALUES {', '.join(sim)}) x(i, j, similarity)),
n AS (SELECT v.*, i, j, row_number() OVER (PARTITION BY src_id ORDER BY similarity DESC, tgt_id) AS name_rank
      FROM v JOIN sim ON i = src_id % {len(paths)} AND j = tgt_id % {len(columns)}),
f AS (SELECT *, CAST(1.0 AS DOUBLE) / (60 + vector_rank) + CAST(2.0 AS DOUBLE) / (60 + name_rank) AS fused FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY round(fused, 12) DESC, tgt_id) AS fused_rank FROM f)
SELECT src_id, tgt_id, {Q.sql_list(paths)}[i + 1] AS xpath, {Q.sql_list([t for t, _ in columns])}[j + 1] AS target_table,
       {Q.sql_list([c for _, c in columns])}[j + 1] AS target_column, CAST(vector_rank AS INTEGER) AS vector_rank,
       CAST(name_rank AS INTEGER) AS name_rank, CAST(fused_rank AS INTEGER) AS fused_rank, round(0.5 + 0.4 * fused / (3.0 / 61), 6) AS confidence_score
FROM r WHERE fused_rank <= 3"""


@query("predict_fused", _predict_fused_sql())
def predict_fused(spark, sf):
    """M8 tier (d): the ten nearest target columns of every source column (M7),
    reranked by fusing the vector rank with the rank by name (twice its
    weight); the best three.  Vectors stand for columns: their names go round
    the document paths and the target columns."""
    from docmap.operators.predict import rerank_neighbours
    from docmap.operators.vectors import cosine_topk
    paths, columns = _fusion_names()
    e = read_table(spark, sf, "embeddings")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("vec_id") % n + 1).cast("int"))
    src = e.where("label < 5")
    tgt = e.where("label >= 5")
    near = cosine_topk(src, tgt, k=10)
    r = rerank_neighbours(
        near, src.select(F.col("vec_id").alias("src_id"), pick(paths, len(paths)).alias("xpath")),
        tgt.select(F.col("vec_id").alias("tgt_id"), pick([t for t, _ in columns], len(columns)).alias("target_table"),
                   pick([c for _, c in columns], len(columns)).alias("column_name")), name_weight=2.0)
    return r.where("fused_rank <= 3").select(
        "src_id", "tgt_id", "xpath", "target_table", "target_column", "vector_rank", "name_rank", "fused_rank",
        F.round("confidence_score", 6).alias("confidence_score"))
