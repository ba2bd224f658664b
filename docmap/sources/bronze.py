"""Document sources: directory scan (S1), Bronze landing (S2), prolog repair (S6),
file registry (K8), document preview (N8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def xml_id_expr(path: Column, raw: Column) -> Column:
    """Deterministic document id from the full 256-bit digest: same path and
    content -> same id, and no collisions at any number of documents."""
    return F.concat(F.lit("XML-"), F.sha2(F.concat_ws("~", path, raw), 256))


def read_xml_files(spark: SparkSession, directory: str, glob: str = "*.xml",
                   recursive: bool = False) -> DataFrame:
    """Whole XML files of a directory -> (file_name, file_path, file_size, raw_xml).

    One row per file; Spark splits the listing across tasks, nothing is
    read on the driver.
    """
    r = (spark.read.option("pathGlobFilter", glob)
         .option("recursiveFileLookup", recursive).text(directory, wholetext=True))
    return r.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("raw_xml"),
    )


def land_documents(docs: DataFrame, uploaded_by: str = "system",
                   product_code: Column | str | None = None,
                   keep: list[str] | None = None) -> DataFrame:
    """Documents (file_name, file_path, raw_xml) -> Bronze rows.

    ``product_code`` may be a column (e.g. from detection) or a constant.
    """
    if product_code is None or isinstance(product_code, str):
        pc = F.lit(product_code).cast("string")
    else:
        pc = product_code
    cols = list(keep or [])
    return docs.select(
        *cols,
        xml_id_expr(F.col("file_path"), F.col("raw_xml")).alias("xml_id"),
        "file_name", "file_path", "raw_xml",
        F.current_timestamp().alias("uploaded_at"),
        pc.alias("product_code"),
        F.lit(uploaded_by).alias("uploaded_by"),
    )


def file_registry(bronze: DataFrame) -> DataFrame:
    """K8: registry rows for landed documents."""
    return bronze.select("xml_id", "file_name", "file_path", "product_code", "uploaded_by",
                         F.col("uploaded_at").alias("upload_date"))


def repair_prolog(df: DataFrame, col: str = "raw_xml") -> DataFrame:
    """Drop characters before ``<?xml``.

    status: ``ok`` (declaration at the start), ``fixed`` (junk removed),
    ``no_declaration`` (left unchanged).
    """
    pos = F.instr(F.col(col), "<?xml")
    return (df.withColumn("prolog_pos", pos)
            .withColumn("repair_status", F.when(pos == 1, "ok").when(pos > 1, "fixed").otherwise("no_declaration"))
            .withColumn(col, F.when(pos > 1, F.expr(f"substring({col}, prolog_pos)")).otherwise(F.col(col)))
            .drop("prolog_pos"))


def document_preview(df: DataFrame, col: str = "raw_xml", limit: int = 2000) -> DataFrame:
    """Length, first ``limit`` characters and a truncated flag."""
    return df.select(
        "*",
        F.length(col).alias("doc_length"),
        F.substring(col, 1, limit).alias("preview"),
        (F.length(col) > limit).alias("truncated"),
    )
