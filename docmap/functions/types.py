"""Column expressions for type inference, type coercion and type formatting.

All of these are built-in Spark expressions (JVM side, whole-stage codegen);
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the mapping workflow's rules).
# Integer / float literal forms accepted by Python's int() and float() on ASCII text.
INTEGER_RE = r"^[+-]?\d+(_\d+)*$"
DECIMAL_RE = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
SPECIAL_FLOAT_RE = r"(?i)^[+-]?(nan|inf|infinity)$"
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n"]


# Whitespace stripped by strip(): space, tab, newline, carriage return, VT, FF.
WS = " \t\n\r\x0b\x0c"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Trim all ASCII whitespace (Spark's ``trim`` removes spaces only)."""
    return F.btrim(_c(x), F.lit(WS))


def infer_type(text) -> Column:
    """First matching of integer, decimal, date, timestamp, boolean, string.

    Applied to trimmed text; blank or null -> string.  ``date`` is only a
    shape test (10 characters with exactly two ``-``), as in the source rules.
    """
    t = strip_ws(text)
    return (F.when(t.isNull() | (t == ""), "string")
            .when(t.rlike(INTEGER_RE), "integer")
            .when(t.rlike(DECIMAL_RE) | t.rlike(SPECIAL_FLOAT_RE), "decimal")
            .when((F.length(t) == 10) & ((F.length(t) - F.length(F.regexp_replace(t, "-", ""))) == 2), "date")
            .when((F.instr(t, "T") > 0) & (F.instr(t, ":") > 0), "timestamp")
            .when(F.lower(t).isin(BOOLEAN_WORDS), "boolean")
            .otherwise("string"))


def sample_value(text, n: int = 100) -> Column:
    """First ``n`` characters of the untrimmed text; null when blank."""
    t = _c(text)
    return F.when(strip_ws(t) != "", F.substring(t, 1, n))


# ---------------------------------------------------------------- coercion
# Name-rule markers of the column-name coercion mode.
NUMBER_MARKERS = ["AMOUNT", "PREMIUM", "LIMIT", "DEDUCTIBLE", "COUNT", "QUANTITY", "PERCENT",
                  "RATE", "INSTALLMENTS", "TERM", "BALANCE", "FEE", "TAX", "DISCOUNT"]
BOOL_TRUE = ["true", "t", "yes", "y", "on", "1"]
BOOL_FALSE = ["false", "f", "no", "n", "off", "0"]


def name_rule(column_name: str) -> str:
    """Rule chosen for a target column by its name (first match wins).

    boolean (contains IS_/HAS_ or ends _FLAG) > date (DATE/TIME/TIMESTAMP) >
    number (marker and not _NUMBER) > number (RISK_NUMBER) > text.
    """
    u = column_name.upper()
    if "IS_" in u or "HAS_" in u or u.endswith("_FLAG"):
        return "boolean"
    if "DATE" in u or "TIME" in u or "TIMESTAMP" in u:
        return "date"
    if any(m in u for m in NUMBER_MARKERS) and "_NUMBER" not in u:
        return "number"
    if u == "RISK_NUMBER":
        return "number"
    return "text"


def name_rule_col(name) -> Column:
    """X9 as a column expression over a column holding target column names."""
    u = F.upper(_c(name))
    num = None
    for m in NUMBER_MARKERS:
        cond = F.instr(u, m) > 0
        num = cond if num is None else (num | cond)
    return (F.when((F.instr(u, "IS_") > 0) | (F.instr(u, "HAS_") > 0) | u.endswith("_FLAG"), "boolean")
            .when((F.instr(u, "DATE") > 0) | (F.instr(u, "TIME") > 0), "date")
            .when(num & (F.instr(u, "_NUMBER") == 0), "number")
            .when(u == "RISK_NUMBER", "number")
            .otherwise("text"))


def to_boolean(x) -> Column:
    """Lenient boolean of trimmed text; '' and unknown words -> NULL."""
    t = F.lower(strip_ws(x))
    return F.when(t.isin(BOOL_TRUE), F.lit(True)).when(t.isin(BOOL_FALSE), F.lit(False))


def to_date(x) -> Column:
    """Date of text that starts with ``yyyy-mm-dd`` (time part dropped)."""
    t = strip_ws(x)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10).try_cast("date"))


def to_number(x, precision: int = 38, scale: int = 0) -> Column:
    """``try_cast`` to decimal (half-up rounding to ``scale``)."""
    return strip_ws(x).try_cast(f"decimal({precision},{scale})")


def to_text(x) -> Column:
    """Trimmed text, '' -> NULL."""
    return F.nullif(strip_ws(x), F.lit(""))


def coerce_by_rule(x, rule: str) -> Column:
    if rule == "boolean":
        return to_boolean(x)
    if rule == "date":
        return to_date(x)
    if rule == "number":
        return to_number(x)
    return to_text(x)


def coerce_declared(x, sql_type: str) -> Column:
    """Coercion by declared target type (default mode).

    Text is trimmed, '' -> NULL; then: BOOLEAN by X4 words, DATE by the X5
    guard, TIMESTAMP(_NTZ) guarded the same way, everything else ``try_cast``.
    """
    t = sql_type.strip().upper()
    v = to_text(x)
    if t == "BOOLEAN":
        return to_boolean(v)
    if t == "DATE":
        return to_date(v)
    if t.startswith("TIMESTAMP"):
        target = "timestamp_ntz" if t != "TIMESTAMP_LTZ" and t != "TIMESTAMP" else "timestamp"
        return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), v.try_cast(target))
    if t in ("STRING",) or t.startswith("VARCHAR") or t.startswith("CHAR"):
        return v
    if t.startswith("NUMBER"):
        t = "DECIMAL" + t[len("NUMBER"):] if "(" in t else "DECIMAL(38,0)"
    if t in ("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT"):
        # numeric text rounds half-up to a whole number, then must fit the type
        return v.try_cast("decimal(38,0)").try_cast(t.lower())
    return v.try_cast(t.lower())


# ---------------------------------------------------------------- type text
# Groups of mutually compatible type names.
TYPE_GROUPS = {
    "string": ["varchar", "text", "string", "char"],
    "integer": ["int", "integer", "bigint", "smallint", "number"],
    "decimal": ["float", "double", "decimal", "numeric", "number"],
    "date": ["date", "timestamp", "datetime"],
}


def types_compatible(source_type, target_type) -> Column:
    """Q10: both lower-cased type names fall in one compatibility group."""
    s, t = F.lower(_c(source_type)), F.lower(_c(target_type))
    cond = F.lit(False)
    for members in TYPE_GROUPS.values():
        cond = cond | (s.isin(members) & t.isin(members))
    return F.coalesce(cond, F.lit(False))


# Types that are written with a length, and with precision and scale.
LENGTH_TYPES = ["VARCHAR", "CHAR", "TEXT"]
PRECISION_TYPES = ["NUMBER", "DECIMAL", "NUMERIC"]


def format_type(data_type, max_length, precision, scale) -> Column:
    """Q11: ``VARCHAR(50)``, ``DECIMAL(15,2)``, ``NUMBER(38)``; scale only if > 0.
    Any other type is written plainly, even when it has a length or precision."""
    dt = _c(data_type)
    ml, p, s = _c(max_length), _c(precision), _c(scale)
    by_length = F.upper(dt).isin(LENGTH_TYPES) & ml.isNotNull()
    by_precision = F.upper(dt).isin(PRECISION_TYPES) & p.isNotNull()
    return (F.when(by_length, F.format_string("%s(%d)", dt, ml.cast("int")))
            .when(by_precision & (F.coalesce(s, F.lit(0)) > 0),
                  F.format_string("%s(%d,%d)", dt, p.cast("int"), s.cast("int")))
            .when(by_precision, F.format_string("%s(%d)", dt, p.cast("int")))
            .otherwise(dt))
