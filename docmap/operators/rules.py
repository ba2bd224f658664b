"""Dictionary rules as data (Q14): rule texts -> predicates -> violation counts.

A data dictionary has one row per column: table, column, declared type and a
text of business rules in plain sentences.  Each sentence is held against a
table of rule shapes; what fits becomes a predicate over the column, and a
sentence that fits none (or names a column that is not there) gets a row that
says so, so that no rule is silently left unchecked.  All predicates of a table
are counted in one aggregate; uniqueness is one count per value and column.

A null value breaks "not null" rules only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmap.functions.types import coerce_declared

DICTIONARY_SCHEMA = "table_name string, column_name string, data_type string, business_rules string"
RESULT_SCHEMA = "table_name string, column_name string, rule string, kind string, status string, checked long, violations long"


@dataclass
class Rule:
    column: str
    text: str
    kind: str
    holds: Column | None = None   # null where the rule says nothing
    problem: str | None = None


def _number(text: str) -> str:
    return re.sub(r"[,_ ]", "", text)


def _values(c: Column, m: re.Match, columns: list[str]) -> Column:
    listed = [re.sub(r"^(?:or|and)\s+", "", v.strip()) for v in m["values"].split(",")]
    return c.cast("string").isin([v for v in listed if v and v.lower() not in ("etc", "etc.")])


def _range(c: Column, m: re.Match, columns: list[str]) -> Column:
    high = F.year(F.current_date()) if m["high"].lower() == "current" else F.lit(_number(m["high"])).cast("decimal(38,6)")
    return c.cast("decimal(38,6)").between(F.lit(_number(m["low"])).cast("decimal(38,6)"), high)


def _ordered(c: Column, m: re.Match, columns: list[str]) -> Column:
    other = next((x for x in columns if x.lower() == m["other"].lower()), None)
    if other is None:
        raise ValueError(f"no column {m['other']}")
    op = {"after": ">", "before": "<", "on or after": ">=", "on or before": "<="}.get(m["op"].lower(), m["op"])
    o = F.col(other)
    return {">": c > o, ">=": c >= o, "<": c < o, "<=": c <= o}[op]


def _today(c: Column, m: re.Match, columns: list[str]) -> Column:
    day = c.cast("date")
    return day <= F.current_date() if m["op"] in ("<=", "on or before") else day > F.current_date()


# The shapes of rule sentences (lower case), their kind, and the
# predicate over the column.  The first that fits a sentence counts.
SHAPES: list[tuple[str, str, Callable[[Column, re.Match, list[str]], Column] | None]] = [
    (r"(?:must be unique and not null|not null and unique)", "unique and not null", None),
    (r"(?:primary key|(?:must be )?unique)(?: (?:per|within) .*)?", "unique", None),
    (r"not null(?: .*)?|required", "not null", lambda c, m, cs: c.isNotNull()),
    (r"can be null|optional", "nullable", lambda c, m, cs: F.lit(True)),
    (r"(?:must be )?(?:a )?positive(?: number)?", "positive", lambda c, m, cs: c.cast("decimal(38,6)") > 0),
    (r"(?:can|must) be (?:zero or positive|positive or zero)|non-negative", "not negative", lambda c, m, cs: c.cast("decimal(38,6)") >= 0),
    (r"(?:must be a )?valid date", "date", lambda c, m, cs: coerce_declared(c.cast("string"), "DATE").isNotNull()),
    (r"(?:must be )?(?P<op><=|>|on or before|after) (?:the )?(?:current date|today)", "date against today", _today),
    (r"(?:must be )?(?P<op>after|before|on or after|on or before|>=|<=|>|<) (?P<other>[a-z_][a-z0-9_]*)", "order of columns", _ordered),
    (r"(?:must be )?between (?P<low>-?[\d.,]+) and (?P<high>-?[\d.,]+|current)", "range", _range),
    (r"(?P<low>\d+)\s*-\s*(?P<high>\d+|current)", "range", _range),
    (r"(?P<n>\d+) char(?:acter)?s", "length", lambda c, m, cs: F.length(c.cast("string")) == int(m["n"])),
    (r"uppercase format preferred|uppercase", "upper case", lambda c, m, cs: c.cast("string") == F.upper(c.cast("string"))),
    (r"lowercase preferred|lowercase", "lower case", lambda c, m, cs: c.cast("string") == F.lower(c.cast("string"))),
    (r"(?:values|must be from approved list|must be one of)\s*:\s*(?P<values>.+)", "list", _values),
]
_COMPILED = [(re.compile(p, re.IGNORECASE), kind, build) for p, kind, build in SHAPES]


def sentences(text: str | None) -> list[str]:
    """The sentences of a rule text (a full stop followed by a space or the end)."""
    return [s.strip() for s in re.split(r"\.(?:\s+|$)", text or "") if s.strip()]


def compile_rules(column: str, data_type: str | None, text: str | None, columns: list[str]) -> list[Rule]:
    """All rules of one dictionary row: its type, then its sentences."""
    c = F.col(f"`{column}`")
    if column not in columns:
        return [Rule(column, s, "missing column", problem=f"no column {column}") for s in [data_type or "", *sentences(text)] if s]
    rules = []
    if data_type:
        try:
            rules.append(Rule(column, data_type, "type", coerce_declared(c.cast("string"), data_type).isNotNull() | (F.trim(c.cast("string")) == "")))
        except Exception as e:  # noqa: BLE001  an unknown type name is a finding, not a failure
            rules.append(Rule(column, data_type, "type", problem=str(e).splitlines()[0]))
    for s in sentences(text):
        for pattern, kind, build in _COMPILED:
            m = pattern.fullmatch(s)
            if m is None or not m[0]:
                continue
            try:
                rules.append(Rule(column, s, kind, build(c, m, columns) if build else None))
            except ValueError as e:
                rules.append(Rule(column, s, kind, problem=str(e)))
            break
        else:
            rules.append(Rule(column, s, "unknown", problem="no shape for this rule"))
    return rules


def conformance(df: DataFrame, table: str, dictionary: DataFrame) -> DataFrame:
    """Q14: one row per rule of ``table`` in ``dictionary`` (DICTIONARY_SCHEMA):
    ``status`` checked or the reason why not, rows the rule speaks about and
    rows that break it.

    The dictionary is configuration (one row per column of the table) and is
    collected; the data is aggregated where it lies.
    """
    rows = (dictionary.where(F.lower(F.element_at(F.split("table_name", r"\."), -1)) == table.lower())
            .select("column_name", "data_type", "business_rules").collect())
    rules = [r for row in rows for r in compile_rules(row.column_name, row.data_type, row.business_rules, df.columns)]
    columns = "table_name, column_name, rule, kind, status, checked, violations".split(", ")
    spark = df.sparkSession
    out = [spark.createDataFrame([(table, r.column, r.text, r.kind, f"not checked: {r.problem}", None, None) for r in rules if r.problem], RESULT_SCHEMA)]
    plain = [r for r in rules if r.holds is not None]
    if plain:
        aggs = []
        for i, r in enumerate(plain):
            speaks = F.lit(True) if r.kind == "not null" else F.col(f"`{r.column}`").isNotNull()
            aggs += [F.count_if(speaks).alias(f"_n{i}"), F.count_if(speaks & ~F.coalesce(r.holds, F.lit(r.kind == "order of columns"))).alias(f"_v{i}")]
        out.append(df.agg(*aggs).select(F.inline(F.array(*[F.struct(
            F.lit(table).alias("table_name"), F.lit(r.column).alias("column_name"), F.lit(r.text).alias("rule"), F.lit(r.kind).alias("kind"),
            F.lit("checked").alias("status"), F.col(f"_n{i}").alias("checked"), F.col(f"_v{i}").alias("violations")) for i, r in enumerate(plain)]))))
    for r in rules:
        if r.kind.startswith("unique") and r.problem is None:
            v = F.col(f"`{r.column}`")
            per_value = df.groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
            null_ok = r.kind == "unique"
            again = F.when(F.col("_v").isNotNull(), F.col("_n") - 1).otherwise(F.lit(0) if null_ok else F.col("_n"))
            seen = F.when(F.col("_v").isNull() & F.lit(null_ok), F.lit(0)).otherwise(F.col("_n"))
            out.append(per_value.agg(F.coalesce(F.sum(seen), F.lit(0)).alias("checked"), F.coalesce(F.sum(again), F.lit(0)).alias("violations")).select(
                F.lit(table).alias("table_name"), F.lit(r.column).alias("column_name"), F.lit(r.text).alias("rule"), F.lit(r.kind).alias("kind"),
                F.lit("checked").alias("status"), "checked", "violations"))
    return reduce(DataFrame.unionByName, [o.select(*columns) for o in out])
