"""Column catalog of the Silver schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmap.functions.types import format_type
from docmap.schemas import CONTROL_TABLES, SILVER

_TYPE_RE = re.compile(r"^([A-Z_]+)(?:\((\d+)(?:,(\d+))?\))?$")


def catalog_from_schema(spark: SparkSession, tables: dict[str, list[tuple[str, str]]] | None = None,
                        schema: str = "SILVER", only: list[str] | None = None) -> DataFrame:
    """One row per column (qualified table, column, type, nullable,
    position, length/precision/scale, formatted type), ordered by table and
    position.  ``only`` filters by bare or qualified table names."""
    tables = tables or SILVER
    rows = []
    for t, cols in tables.items():
        for pos, (c, ty) in enumerate(cols, start=1):
            m = _TYPE_RE.match(ty.upper().replace(" ", ""))
            base, a, b = (m.group(1), m.group(2), m.group(3)) if m else (ty.upper(), None, None)
            is_char = base in ("VARCHAR", "CHAR", "STRING")
            rows.append((f"{schema}.{t}", c, base, "", "YES", None, pos,
                         int(a) if a and is_char else None,
                         int(a) if a and not is_char else None,
                         int(b) if b else None))
    df = spark.createDataFrame(rows, "table_name string, column_name string, data_type string, description string, "
                                     "is_nullable string, column_default string, ordinal_position int, "
                                     "max_length int, numeric_precision int, numeric_scale int")
    df = df.withColumn("formatted_data_type",
                       format_type(F.col("data_type"), F.col("max_length"), F.col("numeric_precision"),
                                   F.col("numeric_scale")))
    if only:
        wanted = [o.upper().split(".")[-1] for o in only]
        df = df.where(F.upper(F.element_at(F.split("table_name", r"\."), -1)).isin(wanted))
    return df.orderBy("table_name", "ordinal_position")


def catalog_from_spark(spark: SparkSession, database: str | None = None) -> DataFrame:
    """S13/S15 over the session catalog (base tables only)."""
    rows = []
    for t in spark.catalog.listTables(database):
        if t.tableType not in ("MANAGED", "EXTERNAL"):
            continue
        for pos, c in enumerate(spark.catalog.listColumns(t.name, database), start=1):
            rows.append((f"{(t.database or 'default').upper()}.{t.name.upper()}", c.name, c.dataType.upper(),
                         c.description or "", "YES" if c.nullable else "NO", pos))
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, "
                                       "description string, is_nullable string, ordinal_position int")


def table_list(catalog: DataFrame) -> DataFrame:
    """Distinct tables with bare-name -> qualified-name map."""
    return (catalog.select("table_name").distinct()
            .select(F.upper(F.element_at(F.split("table_name", r"\."), -1)).alias("table"), "table_name")
            .orderBy("table"))


def create_tables(spark: SparkSession, location: str, tables: dict[str, list[tuple[str, str]]] | None = None) -> None:
    """Silver and control tables (Bronze, registry, stage, ledger, logs,
    view definitions) as Parquet tables if missing."""
    for name, schema in CONTROL_TABLES.items():
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet LOCATION '{location}/{name}'")
    for t, cols in (tables or SILVER).items():
        ddl = ", ".join(f"`{c}` {ty}" for c, ty in cols)
        spark.sql(f"CREATE TABLE IF NOT EXISTS silver_{t.lower()} ({ddl}) USING parquet "
                  f"LOCATION '{location}/silver_{t.lower()}'")
