"""Whitelisted transformations (X15): a table of shapes.

Mapping rows carry transformation text such as ``TO_DATE(value)`` or
``UPPER(TRIM(value))``.  The text is untrusted and never becomes SQL: it is
held against a fixed table of shapes, each with a function that builds a Column
from the shape's inner transformation (``value``, or a shape again) and its
literals.  Lengths, precisions and formats are part of a shape; text that fits
none is rejected with a reason and its mapping quarantined.  Bad values give
NULL and never end a job.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmap.functions.types import coerce_declared, strip_ws, to_text

MAX_LENGTH = 10_000   # of LEFT, RIGHT, SUBSTR, LPAD, RPAD
MAX_TEXT = 500        # characters of a transformation
NUMBER = "decimal(38,6)"

# Date formats by their letters; places of year, month and day.
DATE_FORMATS = {
    "YYYY-MM-DD": (r"^\d{4}-\d{2}-\d{2}$", 1, 6, 9), "YYYY/MM/DD": (r"^\d{4}/\d{2}/\d{2}$", 1, 6, 9),
    "YYYYMMDD": (r"^\d{8}$", 1, 5, 7), "DD/MM/YYYY": (r"^\d{2}/\d{2}/\d{4}$", 7, 4, 1),
    "MM/DD/YYYY": (r"^\d{2}/\d{2}/\d{4}$", 7, 1, 4), "DD-MM-YYYY": (r"^\d{2}-\d{2}-\d{4}$", 7, 4, 1),
    "DD.MM.YYYY": (r"^\d{2}\.\d{2}\.\d{4}$", 7, 4, 1), "MM-DD-YYYY": (r"^\d{2}-\d{2}-\d{4}$", 7, 1, 4),
}


class TransformError(ValueError):
    pass


Step = tuple[str, Callable[[Column], Column]]  # kind of the result, what makes it


# Kinds: t text, n number, d date or time, b truth value.  Every builder gets
# the inner transformation's kind and the match, checks its literals, and
# returns the result's kind with the function that makes the Column.
def _text(c: Column, kind: str) -> Column:
    return c if kind == "t" else c.cast("string")


def _number(c: Column, kind: str) -> Column:
    return c if kind == "n" else strip_ws(c).try_cast(NUMBER)


def _must_be_number(kind: str) -> None:
    if kind not in ("t", "n"):
        raise TransformError("a number is expected")


def _must_be_text(kind: str) -> None:
    if kind != "t":
        raise TransformError("a text is expected")


def _literal(text: str) -> tuple[object, str]:
    """A quoted text, a number, TRUE, FALSE or NULL, and its kind."""
    if text.startswith("'"):
        return text[1:-1].replace("''", "'"), "t"
    if text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE", "b"
    if text.upper() == "NULL":
        return None, "0"
    return Decimal(text), "n"


def _length(text: str) -> int:
    n = int(text) if len(text) < 10 else MAX_LENGTH + 1
    if n > MAX_LENGTH:
        raise TransformError(f"length above {MAX_LENGTH}")
    return n


def _precision(p: str | None, s: str | None) -> str:
    precision, scale = int(p or 38), int(s or 0)
    if not 1 <= precision <= 38 or scale > precision:
        raise TransformError(f"no decimal({precision},{scale})")
    return f"decimal({precision},{scale})"


# ------------------------------------------------------------------ builders
def _text_call(kind: str, m) -> Step:
    _must_be_text(kind)
    name = m["name"].upper()
    if name == "LENGTH":
        return "n", lambda c: F.length(c).cast(NUMBER)
    call = {"UPPER": F.upper, "LOWER": F.lower, "TRIM": F.trim, "LTRIM": F.ltrim, "RTRIM": F.rtrim}[name]
    return "t", lambda c: call(c)


def _part(kind: str, m) -> Step:
    _must_be_text(kind)
    n, left = _length(m["n"]), m["name"].upper() == "LEFT"
    return "t", lambda c: F.left(c, F.lit(n)) if left else F.right(c, F.lit(n))


def _substring(kind: str, m) -> Step:
    _must_be_text(kind)
    first, n = _length(m["i"]), _length(m["n"]) if m["n"] else 2 ** 31 - 1
    return "t", lambda c: F.substring(c, first, n)


def _pad(kind: str, m) -> Step:
    _must_be_text(kind)
    n, left, with_ = _length(m["n"]), m["name"].upper() == "LPAD", _literal(m["s"])[0]
    return "t", lambda c: F.lpad(c, n, with_) if left else F.rpad(c, n, with_)


def _replace(kind: str, m) -> Step:
    _must_be_text(kind)
    old, new = _literal(m["s"])[0], _literal(m["r"])[0]
    return "t", lambda c: F.replace(c, F.lit(old), F.lit(new))


def _date(kind: str, m) -> Step:
    if kind not in ("t", "d"):
        raise TransformError("a text or a date is expected")
    wanted = _literal(m["s"])[0].strip().upper() if m["s"] else None
    if kind == "d":
        return "d", lambda c: c.cast("date")
    if wanted is None:
        return "d", lambda c: coerce_declared(c, "DATE")
    if wanted not in DATE_FORMATS:
        raise TransformError(f"date format {wanted}")
    pattern, y, month, d = DATE_FORMATS[wanted]

    def make(c: Column) -> Column:
        t = strip_ws(c)
        whole = F.concat_ws("-", F.substring(t, y, 4), F.substring(t, month, 2), F.substring(t, d, 2))
        return F.when(t.rlike(pattern), whole.try_cast("date"))
    return "d", make


def _timestamp(kind: str, m) -> Step:
    if kind not in ("t", "d"):
        raise TransformError("a text or a time is expected")
    return "d", lambda c: coerce_declared(_text(c, kind), "TIMESTAMP_NTZ")


def _cast(kind: str, m) -> Step:
    name = m["type"].upper()
    if name in ("DECIMAL", "NUMBER", "NUMERIC"):
        _must_be_number(kind)
        to = _precision(m["p"], m["q"])
        return "n", lambda c: c.try_cast(to) if kind == "n" else coerce_declared(c, to.upper())
    if m["p"] is not None and name != "VARCHAR":
        raise TransformError(f"{name} has no length")
    if name in ("VARCHAR", "STRING"):
        return "t", lambda c: _text(c, kind)
    if name == "DATE":
        return _date(kind, {"s": None})
    if name.startswith("TIMESTAMP"):
        return _timestamp(kind, m)
    if name == "BOOLEAN":
        _must_be_text(kind)
        return "b", lambda c: coerce_declared(c, name)
    _must_be_number(kind)
    if name in ("DOUBLE", "FLOAT"):
        return "n", lambda c: c.try_cast("double") if kind == "n" else coerce_declared(c, "DOUBLE")
    return "n", lambda c: c.try_cast("decimal(38,0)").try_cast(name.lower()) if kind == "n" else coerce_declared(c, name)


def _to_number(kind: str, m) -> Step:
    _must_be_number(kind)
    to = _precision(m["p"], m["q"])
    return "n", lambda c: c.try_cast(to) if kind == "n" else to_text(c).try_cast(to)


def _round(kind: str, m) -> Step:
    _must_be_number(kind)
    digits = int(m["n"] or 0)
    if digits > 6:
        raise TransformError("more than 6 digits")
    return "n", lambda c: F.round(_number(c, kind), digits).try_cast(NUMBER)


def _absolute(kind: str, m) -> Step:
    _must_be_number(kind)
    return "n", lambda c: F.abs(_number(c, kind))


def _arithmetic(kind: str, m) -> Step:
    _must_be_number(kind)
    if not ATOM.fullmatch(m["x"].strip()):
        raise TransformError("parentheses are needed")
    n, op = Decimal(m["n"]), m["op"]

    def make(c: Column) -> Column:
        call = {"*": F.try_multiply, "/": F.try_divide, "+": F.try_add, "-": F.try_subtract}[op]
        return call(_number(c, kind), F.lit(n)).try_cast(NUMBER)
    return "n", make


def _or_else(kind: str, m) -> Step:
    v, k = _literal(m["s"])
    if kind == "t":
        return "t", lambda c: F.coalesce(c, F.lit(str(v)))
    if kind == k == "n":
        return "n", lambda c: F.coalesce(c, F.lit(v).cast(NUMBER))
    raise TransformError("another kind of value")


def _null_if(kind: str, m) -> Step:
    _must_be_text(kind)
    v = _literal(m["s"])[0]
    return "t", lambda c: F.nullif(c, F.lit(v))


def _case(kind: str, m) -> Step:
    wanted, k = _literal(m["s"])
    op = m["op"] if "op" in m.re.groupindex else "="
    if k == "n":
        _must_be_number(kind)
    elif k == "t":
        _must_be_text(kind)
    else:
        raise TransformError("a number or a text to compare with is expected")
    (then, k1), (other, k2) = _literal(m["then"]), _literal(m["other"] or "NULL")
    result = k1 if k1 != "0" else k2
    if result == "0" or {k1, k2} - {result, "0"}:
        raise TransformError("results of one kind are expected")
    as_type = {"t": "string", "b": "boolean", "n": NUMBER}[result]

    def make(c: Column) -> Column:
        left, right = (_number(c, kind), F.lit(wanted).cast(NUMBER)) if k == "n" else (c, F.lit(wanted))
        test = {"=": left == right, "<>": left != right, "!=": left != right, ">": left > right, ">=": left >= right,
                "<": left < right, "<=": left <= right}[op]
        return F.when(test, F.lit(then).cast(as_type)).otherwise(F.lit(other).cast(as_type))
    return result, make


# ------------------------------------------------------------------ the table
_S = r"'(?:[^']|'')*+'"
_N = r"-?\d{1,18}(?:\.\d{1,10})?"
_ANY = rf"(?:{_S}|{_N}|TRUE|FALSE|NULL)"
ATOM = re.compile(r"value|\(.+\)|[A-Z_]+\s*\(.+\)", re.IGNORECASE | re.DOTALL)

# The shapes, each as its pattern (``x`` is the inner
# transformation) and the function that builds it.
SHAPES: list[tuple[str, Callable[[str, re.Match], Step]]] = [
    (r"(?P<name>UPPER|LOWER|TRIM|LTRIM|RTRIM|LENGTH)\s*\((?P<x>.+)\)", _text_call),
    (r"(?P<name>LEFT|RIGHT)\s*\((?P<x>.+),\s*(?P<n>\d+)\s*\)", _part),
    (r"(?:SUBSTR|SUBSTRING)\s*\((?P<x>.+?),\s*(?P<i>\d+)\s*(?:,\s*(?P<n>\d+)\s*)?\)", _substring),
    (rf"(?P<name>LPAD|RPAD)\s*\((?P<x>.+),\s*(?P<n>\d+)\s*,\s*(?P<s>{_S})\s*\)", _pad),
    (rf"REPLACE\s*\((?P<x>.+),\s*(?P<s>{_S})\s*,\s*(?P<r>{_S})\s*\)", _replace),
    (rf"TO_DATE\s*\((?P<x>.+?)(?:,\s*(?P<s>{_S})\s*)?\)", _date),
    (r"TO_TIMESTAMP(?:_NTZ)?\s*\((?P<x>[^,]+)\)", _timestamp),
    (r"(?:TRY_)?CAST\s*\((?P<x>.+)\s+AS\s+(?P<type>INTEGER|INT|BIGINT|SMALLINT|DECIMAL|NUMBER|NUMERIC|DOUBLE|FLOAT|VARCHAR|STRING|DATE"
     r"|TIMESTAMP|TIMESTAMP_NTZ|BOOLEAN)\s*(?:\(\s*(?P<p>\d{1,8})\s*(?:,\s*(?P<q>\d{1,2})\s*)?\))?\s*\)", _cast),
    (r"(?:TO_NUMBER|TO_DECIMAL)\s*\((?P<x>.+?)(?:,\s*(?P<p>\d{1,2})\s*,\s*(?P<q>\d{1,2})\s*)?\)", _to_number),
    (r"ROUND\s*\((?P<x>.+?)(?:,\s*(?P<n>\d)\s*)?\)", _round),
    (r"ABS\s*\((?P<x>.+)\)", _absolute),
    (rf"COALESCE\s*\((?P<x>.+),\s*(?P<s>{_S}|{_N})\s*\)", _or_else),
    (rf"NULLIF\s*\((?P<x>.+),\s*(?P<s>{_S})\s*\)", _null_if),
    (rf"CASE\s+WHEN\s+(?P<x>.+?)\s*(?P<op><=|>=|<>|!=|=|<|>)\s*(?P<s>{_ANY})\s+THEN\s+(?P<then>{_ANY})(?:\s+ELSE\s+(?P<other>{_ANY}))?\s+END", _case),
    (rf"CASE\s+(?P<x>.+?)\s+WHEN\s+(?P<s>{_ANY})\s+THEN\s+(?P<then>{_ANY})(?:\s+ELSE\s+(?P<other>{_ANY}))?\s+END", _case),
    (r"\((?P<x>.+)\)", lambda kind, m: (kind, lambda c: c)),
    (rf"(?P<x>.+?)\s*(?P<op>[*/+\-])\s*(?P<n>{_N})", _arithmetic),
]
_COMPILED = [(re.compile(p, re.IGNORECASE | re.DOTALL), build) for p, build in SHAPES]


def _steps(text: str, reason: list[str]) -> tuple[str, list[Callable]] | None:
    """Kind of the result and the functions to apply, innermost first."""
    text = text.strip()
    if text.lower() == "value":
        return "t", []
    for pattern, build in _COMPILED:
        m = pattern.fullmatch(text)
        if m is None or (inner := _steps(m["x"], reason)) is None:
            continue
        try:
            kind, make = build(inner[0], m)
            return kind, [*inner[1], make]
        except TransformError as e:
            reason.append(str(e))
    return None


def is_identity(text: str | None) -> bool:
    """Empty, NULL and the text ``None`` mean "no transformation"."""
    return text is None or text.strip() == "" or text.strip() == "None"


def compiled(text: str) -> list[Callable[[Column], Column]]:
    """The functions that a transformation is made of; TransformError when the
    text fits no shape."""
    if len(text) > MAX_TEXT:
        raise TransformError(f"more than {MAX_TEXT} characters")
    reason: list[str] = []
    found = _steps(text, reason)
    if found is None:
        raise TransformError(reason[0] if reason else f"none of the allowed shapes: {text.strip()[:80]}")
    return found[1]


def apply_transform(text: str | None, value: Column) -> Column:
    """Column for ``text`` applied to ``value`` (a text column)."""
    if is_identity(text):
        return value
    for make in compiled(text):
        value = make(value)
    return value


def validate(text: str | None) -> str | None:
    """None when the transformation is allowed, else the reason."""
    try:
        if not is_identity(text):
            compiled(text)
        return None
    except TransformError as e:
        return str(e)
