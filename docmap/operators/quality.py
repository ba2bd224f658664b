"""Quality, statistics and reconciliation (Q1-Q13; Q14 is in ``rules``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmap.functions.types import strip_ws, types_compatible

HIGH_CONFIDENCE = 0.8
LOW_CONFIDENCE = 0.5


def confidence_stats(m: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Q1/Q2: count, average, high (>= .8) and low (< .5) counts."""
    c = F.col("confidence_score")
    aggs = [F.count(F.lit(1)).alias("total"),
            F.avg(c).alias("avg_confidence"),
            F.count_if(c >= HIGH_CONFIDENCE).alias("high_confidence"),
            F.count_if(c < LOW_CONFIDENCE).alias("low_confidence")]
    return m.groupBy(*by).agg(*aggs) if by else m.agg(*aggs)


def filter_mappings(m: DataFrame, tables: list[str] | None, min_confidence: float,
                    round_percent: bool = False) -> DataFrame:
    """Q3: target table in the set and confidence >= minimum (optionally on a
    value rounded to 0.1 %)."""
    c = F.round(F.col("confidence_score") * 100, 1) / 100 if round_percent else F.col("confidence_score")
    f = c >= min_confidence
    if tables:
        f = f & F.col("target_table").isin(tables)
    return m.where(f)


def value_counts(m: DataFrame, col: str, by_count: bool = False) -> DataFrame:
    """Q4/Q5: value counts, sorted by value or by count desc."""
    g = m.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), col) if by_count else g.orderBy(col)


def extraction_coverage(docs: DataFrame, mappings: list, table: str, key_cols: list[str], root: str = "Session",
                        mode: str = "declared", record_path: str | None = None) -> DataFrame:
    """Q6: per mapped column how many rows were extracted, absent (no such
    element), blank, or failed their coercion, and how many documents did not
    parse; surrogate ``_ID`` columns skipped.

    The raw and the typed value of every column come from the same pass over
    the documents, and all counts from one aggregate with partial sums.
    """
    from docmap.operators.extract import read_paths, typed
    mappings = [m for m in mappings if "_ID" not in m.target_column.upper()]
    stage = read_paths(docs, [m.source_node for m in mappings], key_cols, root, record_path=record_path)
    parsed = F.col("parse_error").isNull()
    aggs = [F.count_if(~parsed).alias("_unparsed")]
    for i, m in enumerate(mappings):
        raw = F.col("values")[i]
        value = typed(m, raw, mode)
        blank = strip_ws(raw) == ""
        aggs += [F.count_if(parsed & raw.isNull()).alias(f"_a{i}"), F.count_if(parsed & blank).alias(f"_b{i}"),
                 F.count_if(parsed & ~blank & value.isNull()).alias(f"_f{i}"),
                 F.count_if(parsed & ~blank & value.isNotNull()).alias(f"_x{i}")]
    return stage.agg(*aggs).select(F.inline(F.array(*[F.struct(
        F.lit(table).alias("target_table"), F.lit(m.target_column).alias("column_name"), F.col(f"_x{i}").alias("extracted"),
        F.col(f"_a{i}").alias("absent"), F.col(f"_b{i}").alias("blank"), F.col(f"_f{i}").alias("failed"),
        F.col("_unparsed").alias("unparsed_documents")) for i, m in enumerate(mappings)])))


def metadata_check(nodes: DataFrame) -> DataFrame:
    """Q7: required columns present and the node table non-empty -> one report row."""
    required = ["node_path", "node_name", "data_type"]
    missing = [c for c in required if c not in nodes.columns]
    spark = nodes.sparkSession
    if missing:
        return spark.createDataFrame([(False, ",".join(missing), 0)], "valid boolean, missing string, nodes long")
    n = nodes.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != "") for c in required]))
    return n.agg(F.count(F.lit(1)).alias("nodes")).select(
        (F.col("nodes") > 0).alias("valid"), F.when(F.col("nodes") > 0, "").otherwise("empty").alias("missing"), "nodes")


def mapping_issues(m: DataFrame) -> DataFrame:
    """Q8/Q9: low-confidence warnings and type-mismatch errors.

    Low confidence: confidence < .5 (NULL counts as 0).  Type mismatch: the
    lower-cased source and target types differ ('' when missing) and there is
    no transformation.
    """
    conf = F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0))
    low = m.where(conf < LOW_CONFIDENCE).select(
        "*", F.lit("low_confidence").alias("issue_type"),
        F.format_string("Low confidence (%.2f) for %s → %s", conf, F.coalesce(F.col("source_node"), F.lit("None")),
                        F.coalesce(F.col("target_column"), F.lit("None"))).alias("message"),
        F.lit("warning").alias("severity"))
    st = F.lower(F.coalesce(F.col("source_data_type"), F.lit("")))
    tt = F.lower(F.coalesce(F.col("target_data_type"), F.lit("")))
    no_logic = F.col("transformation_logic").isNull() | (F.col("transformation_logic") == "")
    mism = m.where((st != tt) & no_logic).select(
        "*", F.lit("type_mismatch").alias("issue_type"),
        F.format_string("Type mismatch without transformation: %s → %s", st, tt).alias("message"),
        F.lit("error").alias("severity"))
    return low.unionByName(mism)


def type_compatibility(df: DataFrame, source_col: str, target_col: str) -> DataFrame:
    """Q10."""
    return df.withColumn("compatible", types_compatible(F.col(source_col), F.col(target_col)))


def dictionary_summary(catalog: DataFrame, table_col: str = "table_name",
                       type_col: str = "data_type", weight: Column | None = None) -> DataFrame:
    """Q12: per table column count and data-type histogram (sorted ``k=v`` text);
    two aggregates, both bounded by (tables x types).  A row counts once, or
    ``weight`` times."""
    per_type = catalog.groupBy(table_col, type_col).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    return per_type.groupBy(table_col).agg(
        F.sum("n").alias("column_count"),
        F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%d", F.col(type_col), F.col("n")))), ",")
        .alias("type_histogram"))


def dictionary_totals(summary: DataFrame) -> DataFrame:
    """Q12: number of tables and of columns in all, from ``dictionary_summary``."""
    return summary.agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("column_count"), F.lit(0)).cast("bigint").alias("columns"))


# Types whose values are equal exactly if their JSON texts are.
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DateType, T.BooleanType)


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _counted_values(source: DataFrame, target: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Per key and compared values ``_v``, which ``_value_text`` gives as JSON:
    ``_s`` source rows and ``_d`` how many more they are than target's.

    Where both sides have the same types and equal values have equal texts, the
    values are grouped as they are (and the few that are shown become JSON);
    else as one JSON text, so that the aggregates hash.
    """
    value = F.struct(*compare)
    if any(source.schema[c].dataType != target.schema[c].dataType or not isinstance(source.schema[c].dataType, _EXACT) for c in compare):
        value = _json(value)
    both = (source.select(*keys, value.alias("_v"), F.lit(1).alias("_d"), F.lit(1).alias("_s"))
            .unionByName(target.select(*keys, value.alias("_v"), F.lit(-1).alias("_d"), F.lit(0).alias("_s"))))
    return both.groupBy(*keys, "_v").agg(F.sum("_d").alias("_d"), F.sum("_s").alias("_s"))


def _value_text(values: DataFrame) -> Column:
    return F.col("_v") if isinstance(values.schema["_v"].dataType, T.StringType) else _json(F.col("_v"))


def _per_key(values: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("_d")
    per_key = values.groupBy(*keys).agg(
        F.sum("_s").alias("source_count"), F.sum(F.col("_s") - d).alias("target_count"),
        F.sum(F.col("_s") - F.greatest(d, F.lit(0))).alias("match_count"))
    s, t = F.col("source_count"), F.col("target_count")
    return per_key.withColumns({
        "mismatch_count": F.least(s, t) - F.col("match_count"),
        "missing_in_target": F.greatest(s - t, F.lit(0).cast("bigint")),
        "extra_in_target": F.greatest(t - s, F.lit(0).cast("bigint"))})


def key_differences(source: DataFrame, target: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Q13 per key: source and target rows, matches, mismatches, missing, extra.

    Rows are counted per key and compared values on each side first (NULL
    keys are keys, equal rows are a multiset); what both sides hold of the
    same values matches, of the rest as many as both sides have mismatch,
    and the surplus is missing or extra.  No join: both sides are added up,
    with partial counts before the shuffle, so a hot key is no hot task.
    """
    return _per_key(_counted_values(source, target, keys, compare), keys)


def reconcile(source: DataFrame, target: DataFrame, keys: list[str], compare: list[str], sample: int = 5) -> DataFrame:
    """Q13: one row of totals over ``key_differences`` with a status and
    ``details``, a VARIANT: keys compared, keys with each kind of difference,
    and of the differing keys the ``sample`` least (NULL first) with the least
    value that either side has more often.

    The sample is a top-k: each task keeps its ``sample`` least keys and these
    are merged, so it does not depend on how the rows are dealt.  Its values
    are looked up for those few keys alone; both read the totals' exchanges.
    """
    values = _counted_values(source, target, keys, compare)
    d = _per_key(values, keys)
    counts = ["source_count", "target_count", "match_count", "mismatch_count", "missing_in_target", "extra_in_target"]
    kinds = counts[3:]
    totals = d.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
                   F.count(F.lit(1)).alias("keys_compared"), *[F.count_if(F.col(c) > 0).alias(f"keys_{c}") for c in kinds])
    in_order = [F.asc_nulls_first(k) for k in keys]
    least = d.where((F.col("mismatch_count") > 0) | (F.col("missing_in_target") > 0) | (F.col("extra_in_target") > 0)).orderBy(*in_order).limit(sample)
    least = least.withColumn("n", F.row_number().over(Window.orderBy(*in_order)))  # over ``sample`` rows
    wanted = least.select("n", *kinds, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    text = _value_text(values)
    # (_s is never negative: it is named so that this plan's exchange has the
    # totals' columns and is read again, not computed again)
    rest = (values.where((F.col("_d") != 0) | (F.col("_s") < 0)).join(F.broadcast(wanted), same).groupBy("n", *kinds, *keys)
            .agg(F.min(F.when(F.col("_d") > 0, text)).alias("source_value"), F.min(F.when(F.col("_d") < 0, text)).alias("target_value")))
    item = F.struct("n", F.struct(*[F.col(k).cast("string").alias(k) for k in keys]).alias("key"), *kinds, "source_value", "target_value").alias("_item")
    both = totals.unionByName(rest.select(item), allowMissingColumns=True)
    r = both.agg(*[F.max(c).alias(c) for c in totals.columns], F.array_sort(F.collect_list("_item")).alias("sample"))
    status = F.when((F.col("mismatch_count") == 0) & (F.col("missing_in_target") == 0)
                    & (F.col("extra_in_target") == 0), "MATCHED").otherwise("DIFFERENCES")
    details = F.parse_json(F.to_json(F.struct(*totals.columns[len(counts):], "sample")))
    return r.select(*counts, status.alias("status"), details.alias("details"))
