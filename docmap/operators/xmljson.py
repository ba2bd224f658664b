"""XML -> JSON conversion (S3/S4) and the JSON stage.

Conversion needs a recursive walk of each document, so it runs as an
Arrow-batched pandas UDF (one parse per document); the JSON text becomes a
VARIANT with the built-in ``parse_json``.  Built-in ``from_xml(.., variant)``
is not used because it types values (``007`` -> 7, ``1250.00`` -> 1250).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmap.functions.transform import apply_transform
from docmap.session import ensure_worker_code


def _conv(convention: str):
    @F.pandas_udf(T.StringType())
    def conv(raw: pd.Series) -> pd.Series:
        from docmap.functions.xmlnodes import to_json_text
        return pd.Series([to_json_text(r, convention)[0] if r is not None else None for r in raw],
                         dtype="object")
    return conv


xml_to_json_a = _conv("a")
xml_to_json_b = _conv("b")


def to_variant(df: DataFrame, raw_col: str = "raw_xml", convention: str = "a",
               out_col: str = "xml_data") -> DataFrame:
    """Document -> VARIANT (NULL when the document does not parse)."""
    ensure_worker_code(df.sparkSession)
    fn = xml_to_json_a if convention == "a" else xml_to_json_b
    return df.withColumn(out_col, F.try_parse_json(fn(F.col(raw_col))))


def stage_rows(df: DataFrame, json_col: Column, target_table: Column, id_col: Column,
               doc_col: Column, processed: Column | None = None) -> DataFrame:
    """Append-ready stage rows: VARIANT payload, processed flag, load time."""
    return df.select(id_col.cast("string").alias("staging_id"), doc_col.cast("string").alias("xml_id"),
                     F.try_parse_json(json_col).alias("xml_data"), target_table.alias("target_table"),
                     (processed if processed is not None else F.lit(False)).alias("processed"),
                     F.lit(None).cast("timestamp").alias("processed_at"),
                     F.current_timestamp().alias("created_at"))


def stage_view(stage: DataFrame, target_table: str, mappings: list[tuple[str, str, str | None]]) -> DataFrame:
    """Unprocessed stage rows of one target table; per mapping
    (source_node, target_column, transformation) either the whitelisted
    transformation over the key's value or the key's value as text.
    The key is the last step of the source path."""
    s = stage.where((F.col("target_table") == target_table) & (F.col("processed") == F.lit(False)))
    outs = []
    for src, col, logic in mappings:
        key = src.rstrip("/").split("/")[-1]
        outs.append(apply_transform(logic, F.try_variant_get(F.col("xml_data"), f"$.{key}", "string")).alias(col))
    return s.select("staging_id", "xml_id", *outs)
