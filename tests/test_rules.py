"""Dictionary rules as data (Q14)."""

import datetime as dt

import pytest

from docmap.operators.rules import DICTIONARY_SCHEMA, compile_rules, conformance, sentences

ROWS = [(1, "A1", 5.0, "2024-01-02", dt.date(2024, 1, 2), dt.date(2024, 1, 1)), (2, "b2", -1.0, "31-02", dt.date(2024, 1, 1), dt.date(2024, 1, 1)),
        (2, None, None, None, None, None), (None, "ABC", 0.0, " ", dt.date(2999, 1, 1), None)]
SCHEMA = "k int, code string, amt double, day string, at date, start date"


def run(spark, rules, rows=ROWS):
    d = spark.createDataFrame([("S.T", *r) for r in rules], DICTIONARY_SCHEMA)
    got = conformance(spark.createDataFrame(rows, SCHEMA), "t", d).collect()
    return {(r.column_name, r.rule): (r.kind, r.status, r.checked, r.violations) for r in got}


def test_each_shape(spark):
    got = run(spark, [
        ("k", "INTEGER", "Must be unique and not null. Primary key. Not null."), ("code", "VARCHAR(2)", "2 chars. Uppercase. Values: A1, ABC, etc."),
        ("amt", "DECIMAL(5,2)", "Must be positive. Can be zero or positive. Must be between 0 and 4. 1-current."),
        ("day", "DATE", "Valid date."), ("at", None, "Must be > start. Must be on or before today. Can be null.")])
    assert got["k", "Must be unique and not null"] == ("unique and not null", "checked", 4, 2)
    assert got["k", "Primary key"] == ("unique", "checked", 3, 1)
    assert got["k", "Not null"] == ("not null", "checked", 4, 1) and got["k", "INTEGER"][2:] == (3, 0)
    assert got["code", "2 chars"] == ("length", "checked", 3, 1) and got["code", "Uppercase"][3] == 1
    assert got["code", "Values: A1, ABC, etc"] == ("list", "checked", 3, 1)
    assert got["amt", "Must be positive"][2:] == (3, 2) and got["amt", "Can be zero or positive"][2:] == (3, 1)
    assert got["amt", "Must be between 0 and 4"][2:] == (3, 2) and got["amt", "1-current"][2:] == (3, 2)
    assert got["day", "DATE"][2:] == (3, 1) and got["day", "Valid date"][2:] == (3, 2)  # a blank is no value for a type
    assert got["at", "Must be > start"] == ("order of columns", "checked", 3, 1)  # nothing to compare with: no violation
    assert got["at", "Must be on or before today"][2:] == (3, 1) and got["at", "Can be null"][2:] == (3, 0)


def test_what_cannot_be_checked_has_a_row(spark):
    got = run(spark, [("k", "BLOB(7)", "Must match PRODUCT_CATALOG table. After the flood."), ("gone", "DATE", "Not null."), ("at", None, "Must be after nowhere.")])
    assert got["k", "Must match PRODUCT_CATALOG table"] == ("unknown", "not checked: no shape for this rule", None, None)
    assert got["k", "After the flood"][1].startswith("not checked") and got["gone", "Not null"][1] == "not checked: no column gone"
    assert got["at", "Must be after nowhere"] == ("order of columns", "not checked: no column nowhere", None, None)
    assert got["gone", "DATE"][0] == "missing column" and len(got) == 7 - 1 + (("k", "BLOB(7)") in got) - 1


def test_empty_table_and_empty_dictionary(spark):
    assert run(spark, []) == {}
    got = run(spark, [("amt", None, "Must be positive. Must be unique.")], [])
    assert {v[2:] for v in got.values()} == {(0, 0)}


@pytest.mark.parametrize("text,parts", [("Not null. Must be > 1.5. Ok", ["Not null", "Must be > 1.5", "Ok"]), (None, []), (" . ", []), ("A", ["A"])])
def test_sentences(text, parts):
    assert sentences(text) == parts


def test_rules_are_compiled_once_per_sentence(spark):
    assert [r.kind for r in compile_rules("a", "STRING", "Not null. Positive. What?", ["a"])] == ["type", "not null", "positive", "unknown"]
