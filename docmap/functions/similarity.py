"""String similarity (D9) and the length-bound candidate join.

The ratio is Ratcliff-Obershelp ``2*M/T`` as computed by
``difflib.SequenceMatcher(None, a, b).ratio()`` (argument order matters).
Built-in ``levenshtein`` is a different measure, so the ratio runs in an
Arrow-batched pandas UDF — but only on distinct (term, pattern) pairs that
can pass: since ``M <= min(len)``, ``ratio <= 2*min(la, lb)/(la + lb)``.
Candidate pairs are produced by an equi-join on an allowed length, never
by a cross join.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmap.session import ensure_worker_code


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
        else:
            out.append(SequenceMatcher(None, x, y).ratio())
    return pd.Series(out, dtype="float64")


def allowed_lengths(n: int, threshold: float, max_len: int | None = None) -> list[int]:
    """Lengths m with 2*min(n, m)/(n + m) > threshold (a necessary condition)."""
    if n == 0:
        return []
    lo = math.floor(n * threshold / (2 - threshold)) + 1          # m < n side
    hi = math.ceil(n * (2 - threshold) / threshold) - 1           # m > n side
    lo = max(lo, 1)
    if max_len is not None:
        hi = min(hi, max_len)
    return [m for m in range(lo, hi + 1) if 2 * min(n, m) / (n + m) > threshold]


def candidate_pairs(terms: DataFrame, term_col: str, patterns: DataFrame, pattern_col: str,
                    threshold: float) -> DataFrame:
    """(term, pattern) pairs whose length bound allows ratio > threshold.

    ``patterns`` is configuration-sized; each pattern is expanded to its
    allowed term lengths and joined to ``terms`` on length (equi-join).
    """
    n = F.length(F.col(pattern_col))
    lo = F.greatest(F.floor(n * threshold / (2 - threshold)) + 1, F.lit(1))
    hi = F.ceil(n * (2 - threshold) / threshold) - 1
    m = F.col("_len")
    pexp = (patterns.select("*", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("_len"))
            .where(2 * F.least(n, m) / (n + m) > threshold))
    t = terms.select("*", F.length(F.col(term_col)).alias("_len"))
    return t.join(F.broadcast(pexp), "_len").drop("_len")


def fuzzy_matches(terms: DataFrame, term_col: str, patterns: DataFrame, pattern_col: str,
                  threshold: float, pattern_first: bool = True) -> DataFrame:
    """Pairs with ``ratio(pattern, term) > threshold`` plus the ratio.

    ``pattern_first`` puts the pattern as the first ``SequenceMatcher``
    argument, as in tag/attribute evidence.
    """
    ensure_worker_code(terms.sparkSession)
    pairs = candidate_pairs(terms, term_col, patterns, pattern_col, threshold)
    a, b = (F.col(pattern_col), F.col(term_col)) if pattern_first else (F.col(term_col), F.col(pattern_col))
    return pairs.withColumn("similarity", similarity_ratio(a, b)).where(F.col("similarity") > threshold)


def ratio_col(a: Column, b: Column) -> Column:
    return similarity_ratio(a, b)
