"""Mapping generation (M1-M10, M13): sections, routing, candidates, replies, prediction.

The model call of the original workflow is replaced by deterministic tiers
(history exact path, history last step, name similarity); replies from an
external proposer can still be parsed with ``parse_replies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmap.functions.similarity import similarity_ratio
from docmap.session import written

# Section keywords (M1) and routing priority (M2).
SECTION_KEYWORDS = ["policy", "account", "risk", "coverage", "payment", "customer", "quote"]
ROUTING = [("policy", "POLICY"), ("account", "ACCOUNT"), ("risk", "RISK"), ("coverage", "COVERAGE"),
           ("payment", "PAYMENT"), ("customer", "CUSTOMER"), ("quote", "QUOTE")]

# Confidence of the deterministic tiers.
CONF_EXACT_PATH = 0.95
CONF_LAST_STEP = 0.90


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """Path from node_path, else xpath, else ''; type default 'string'; sample default ''."""
    cols = nodes.columns
    path = F.coalesce(*[F.col(c) for c in ("node_path", "xpath") if c in cols], F.lit(""))
    dtype = F.coalesce(F.col("data_type"), F.lit("string")) if "data_type" in cols else F.lit("string")
    sample = F.coalesce(F.col("sample_value"), F.lit("")) if "sample_value" in cols else F.lit("")
    keep = [c for c in cols if c not in ("node_path", "xpath", "data_type", "sample_value")]
    return nodes.select(*keep, path.alias("xpath"), dtype.alias("data_type"), sample.alias("sample_value"))


def section_of(path: Column) -> Column:
    """M1: first path step whose lower-case form contains a section keyword; else 'General'."""
    rx = "(" + "|".join(SECTION_KEYWORDS) + ")"
    steps = F.filter(F.split(path, "/"), lambda s: F.lower(s).rlike(rx))
    return F.coalesce(F.get(steps, 0), F.lit("General"))


def route_table(section: Column, available: list[str]) -> Column:
    """M2: first keyword (priority order) contained in the section whose table
    is available; else the first available table."""
    sl = F.lower(section)
    out = F.lit(available[0] if available else "POLICY")
    for kw, table in reversed(ROUTING):
        if table in available:
            out = F.when(F.instr(sl, kw) > 0, F.lit(table)).otherwise(out)
    return out


def normalize_table_name(name: Column) -> Column:
    """M3: ``SILVER.policy`` / ``policy`` -> ``POLICY``."""
    return F.upper(F.element_at(F.split(name, r"\."), -1))


def candidates(nodes: DataFrame, catalog: DataFrame, available: list[str]) -> DataFrame:
    """M1-M5: route each node's section to a table and pair it with all columns
    of that table (none are cut).  ``catalog``: table_name, column_name,
    data_type; Spark broadcasts it when its measured size allows.
    """
    n = (nodes.where(F.col("xpath") != "")
         .withColumn("section", section_of(F.col("xpath")))
         .withColumn("target_table", route_table(F.col("section"), available)))
    cat = catalog.withColumn("target_table", normalize_table_name(F.col("table_name")))
    return n.join(cat.select("target_table", "column_name", "data_type"), "target_table")


def snake(name: Column) -> Column:
    """CamelCase -> snake_case, lower."""
    s = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(s)


def last_step(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def fuse_ranks(ranked: DataFrame, weights: dict[str, float], source: str = "src_id", target: str = "tgt_id",
               depth: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: ``ranked`` has a row (source, target, ``by``,
    ``rank``) for each ranking that lists a pair; the fused score is the sum of
    weight / (depth + rank) over the rankings (to 12 digits, so that the order
    of adding does not matter), ties by target.  Returns source,
    target, ``fused_score`` and ``fused_rank``.

    One aggregate by pair and one ranking per source, whose rows are as many
    as the lists given for it are long.
    """
    weight = F.coalesce(*[F.when(F.col("by") == k, F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    fused = ranked.groupBy(source, target).agg(F.round(F.sum(weight / (F.lit(float(depth)) + F.col("rank"))), 12).alias("fused_score"))
    w = Window.partitionBy(source).orderBy(F.desc("fused_score"), target)
    return fused.withColumn("fused_rank", F.row_number().over(w))


def rerank_neighbours(neighbours: DataFrame, sources: DataFrame, targets: DataFrame, vector_weight: float = 1.0,
                      name_weight: float = 1.0, depth: float = 60.0) -> DataFrame:
    """M8 tier (d): M7 neighbours (src_id, tgt_id, rank) fused with the ranking
    of the same pairs by name similarity (snake-cased last step of ``sources``'
    path against ``targets``' column name).

    ``sources``: src_id, xpath; ``targets``: tgt_id, target_table, column_name.
    Returns src_id, tgt_id, xpath, target_table, target_column, the two ranks,
    ``fused_score``, ``fused_rank`` and ``confidence_score`` (0.5 + 0.4 * share
    of the highest score possible).
    """
    from docmap.session import ensure_worker_code
    ensure_worker_code(neighbours.sparkSession)
    named = (neighbours.select("src_id", "tgt_id", F.col("rank").alias("vector_rank")).join(sources.select("src_id", "xpath"), "src_id")
             .join(targets.select("tgt_id", "target_table", F.col("column_name").alias("target_column")), "tgt_id"))
    left, right = snake(last_step(F.col("xpath"))), F.lower(F.col("target_column"))
    named = named.withColumns({"_x": left, "_y": right})
    # the few distinct names are compared, not every pair of rows
    alike = named.select("_x", "_y").distinct().withColumn("similarity", similarity_ratio(F.col("_x"), F.col("_y")))
    w = Window.partitionBy("src_id").orderBy(F.desc("similarity"), "tgt_id")
    pairs = named.join(alike, ["_x", "_y"]).withColumn("name_rank", F.row_number().over(w)).drop("_x", "_y")
    ranked = pairs.select("src_id", "tgt_id", F.inline(F.array(
        F.struct(F.lit("vector").alias("by"), F.col("vector_rank").alias("rank")),
        F.struct(F.lit("name").alias("by"), F.col("name_rank").alias("rank")))))
    fused = fuse_ranks(ranked, {"vector": vector_weight, "name": name_weight}, depth=depth)
    top = (vector_weight + name_weight) / (depth + 1)
    return (pairs.join(fused, ["src_id", "tgt_id"])
            .withColumn("confidence_score", F.lit(0.5) + F.lit(0.4) * F.col("fused_score") / F.lit(top)))


def predict(paths: DataFrame, history: DataFrame, pairs: DataFrame | None = None,
            fused: DataFrame | None = None) -> DataFrame:
    """M8: best mapping per source path.

    Tier (a) exact path in history (0.95), tier (b) history row with the same
    last path step (0.90), tier (c, when ``pairs`` are given: candidate
    (xpath, target_table, column_name) rows) 0.5 + 0.4 * similarity of the
    snake-cased last step to the column name, tier (d, when ``fused`` is given:
    rows of ``rerank_neighbours``) their confidence.  Best = highest
    confidence, then target_table, target_column.
    """
    # a few paths may hold most of the history: it is read once, and each tier
    # reads its different rows
    h = known = written(history.select(F.col("source_node").alias("h_path"), "target_table", "target_column").distinct(), "history")
    a = (paths.join(known, paths.xpath == known.h_path)
         .select("xpath", "target_table", "target_column", F.lit(CONF_EXACT_PATH).alias("confidence_score"),
                 F.lit("history: same path").alias("reasoning")))
    hb = h.select(last_step(F.col("h_path")).alias("step"), "target_table", "target_column").distinct()
    b = (paths.withColumn("step", last_step(F.col("xpath"))).join(hb, "step")
         .select("xpath", "target_table", "target_column", F.lit(CONF_LAST_STEP).alias("confidence_score"),
                 F.lit("history: same element name").alias("reasoning")))
    allc = a.unionByName(b)
    if pairs is not None:
        from docmap.session import ensure_worker_code
        ensure_worker_code(pairs.sparkSession)
        c = (pairs.select("xpath", "target_table", F.col("column_name").alias("target_column"))
             .withColumn("confidence_score",
                         F.lit(0.5) + F.lit(0.4) * similarity_ratio(snake(last_step(F.col("xpath"))),
                                                                     F.lower(F.col("target_column"))))
             .withColumn("reasoning", F.lit("name similarity")))
        allc = allc.unionByName(c)
    if fused is not None:
        allc = allc.unionByName(fused.select("xpath", "target_table", "target_column", "confidence_score",
                                             F.lit("vector and name ranks").alias("reasoning")))
    best = allc.groupBy("xpath").agg(F.min(F.struct(
        (-F.col("confidence_score")).alias("neg_conf"), "target_table", "target_column",
        "reasoning")).alias("b"))
    return best.select(F.col("xpath").alias("source_node"), "b.target_table", "b.target_column",
                       F.lit(None).cast("string").alias("transformation_logic"),
                       (-F.col("b.neg_conf")).alias("confidence_score"), "b.reasoning")


# ------------------------------------------------------------------ M6 / M10
REPLY_SCHEMA = ("array<struct<source_node:string,target_table:string,target_column:string,"
                "transformation_logic:string,confidence_score:double,reasoning:string>>")


def strip_fence(reply: Column) -> Column:
    """Remove a ```json ... ``` fence when the reply has both a backtick and 'json'."""
    inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when((F.instr(reply, "`") > 0) & (F.instr(reply, "json") > 0) & (inner != ""), inner) \
        .otherwise(F.trim(reply))


def parse_replies(replies: DataFrame, key_cols: list[str], reply_col: str = "reply",
                  routed_col: str = "routed_table") -> DataFrame:
    """Reply text -> mapping rows.

    Accepts a JSON array or an object with ``mappings``/``mapping``.  Defaults:
    logic NULL, confidence 0.5, reasoning ''.  A reply with bad JSON, a
    missing required field or confidence outside [0,1] yields no rows at all
    (section-level validity); target_table is forced to the routed table.
    """
    body = strip_fence(F.col(reply_col))
    v = F.try_parse_json(body)
    arr = F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        F.try_variant_get(v, "$.mappings", "array<variant>"),
        F.try_variant_get(v, "$.mapping", "array<variant>"))
    get = lambda item, f, t: F.try_variant_get(item, f"$.{f}", t)

    def valid(item: Column) -> Column:
        confidence = F.coalesce(get(item, "confidence_score", "double"), F.lit(0.5))
        broken = get(item, "confidence_score", "string").isNotNull() & get(item, "confidence_score", "double").isNull()
        return F.coalesce(get(item, "source_node", "string").isNotNull() & get(item, "target_column", "string").isNotNull()
                          & ~broken & confidence.between(0.0, 1.0), F.lit(False))

    # a reply is judged as a whole before it is split, so replies that share a
    # key do not affect each other and nothing is shuffled
    good = replies.select(*key_cols, routed_col, arr.alias("_items")).where(
        F.col("_items").isNotNull() & F.forall("_items", valid))
    item = F.col("item")
    return good.select(*key_cols, routed_col, F.posexplode("_items").alias("item_index", "item")).select(
        *key_cols, "item_index",
        get(item, "source_node", "string").alias("source_node"),
        F.col(routed_col).alias("target_table"),
        get(item, "target_column", "string").alias("target_column"),
        get(item, "transformation_logic", "string").alias("transformation_logic"),
        F.coalesce(get(item, "confidence_score", "double"), F.lit(0.5)).alias("confidence_score"),
        F.coalesce(get(item, "reasoning", "string"), F.lit("")).alias("reasoning"))


# The fields of the mapping contract.
CONTRACT_FIELDS = ["source_node", "target_table", "target_column", "transformation_logic", "confidence_score", "reasoning"]


def contract_violation(raw: Column) -> Column:
    """Why a mapping object (JSON text) breaks the contract, or NULL: all
    six fields are there, no others are, and 0 <= confidence <= 1."""
    keys = F.json_object_keys(raw)
    fields = F.array(*[F.lit(c) for c in CONTRACT_FIELDS])
    missing = F.array_join(F.array_except(fields, keys), ",")
    extra = F.array_join(F.array_sort(F.array_except(keys, fields)), ",")
    confidence = F.get_json_object(raw, "$.confidence_score").try_cast("double")
    nulls = [F.get_json_object(raw, f"$.{c}").isNull() for c in ("source_node", "target_table", "target_column")]
    return (F.when(raw.isNull() | keys.isNull(), "not an object")
            .when(missing != "", F.concat(F.lit("missing: "), missing))
            .when(extra != "", F.concat(F.lit("extra: "), extra))
            .when(nulls[0] | nulls[1] | nulls[2], "null field")
            .when(~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)), "confidence outside 0 to 1"))


def split_by_contract(df: DataFrame, json_col: str, key_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid mappings as columns, quarantined objects with the reason)."""
    checked = df.select(*key_cols, F.col(json_col).alias("mapping"), contract_violation(F.col(json_col)).alias("reason"))
    get = lambda c: F.get_json_object("mapping", f"$.{c}")
    good = checked.where(F.col("reason").isNull()).select(*key_cols, *[
        (get(c).cast("double") if c == "confidence_score" else get(c)).alias(c) for c in CONTRACT_FIELDS])
    return good, checked.where(F.col("reason").isNotNull())


def mapping_contract(m: DataFrame) -> DataFrame:
    """M10 on columns: validity flag per mapping (fields present, 0 <= confidence <= 1)."""
    ok = (F.col("source_node").isNotNull() & F.col("target_table").isNotNull()
          & F.col("target_column").isNotNull() & F.col("confidence_score").between(0.0, 1.0))
    return m.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def result_summary(mappings: DataFrame, key_cols: list[str]) -> DataFrame:
    """M9: total mappings per result set."""
    return mappings.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("total_mappings"))
