"""Reference-file readers (S7-S12) and the cleaned-copy sink (K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmap.schemas import HISTORICAL_MAPPING

REFERENCE_EXTENSIONS = ["csv", "xlsx", "xls", "json", "txt"]
DELIMITERS = [",", ";", "\t", "|", " "]


def list_reference_files(spark: SparkSession, directory: str) -> DataFrame:
    """Recursive listing (path, name, extension, length) of reference files.
    Only file metadata is read (``binaryFile`` with the content column pruned)."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
         .select("path", "length"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return (f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), ext.alias("extension"),
                     "length")
            .where(F.col("extension").isin(REFERENCE_EXTENSIONS)))


HEAD_LINES = 20
_NUMERIC_TOKEN = r"(^|[,;\t| ])-?\d+(\.\d+)?([,;\t| ]|$)"


def reference_bytes(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Files below a folder, whole: (path, content)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .load(directory).select("path", "content"))


def file_lines(files: DataFrame, encoding: str | None = None, sep: str | None = None, header: bool | None = None) -> DataFrame:
    """S8/S9 per file: path, ``encoding`` (UTF-8 when the bytes are valid, else
    ISO-8859-1), ``delimiter``, ``has_header`` and its non-blank ``lines``.

    The delimiter is the candidate with the highest count that is the same,
    and not zero, on each of the first 20 lines (comma if there is none); line
    1 is a header when it has no number.  What is given is not guessed.
    """
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    if encoding:
        text = F.decode("content", encoding)
    f = files.select("path", text.alias("_text"), F.lit(encoding).alias("encoding") if encoding else F.when(utf8, "UTF-8").otherwise(
        "ISO-8859-1").alias("encoding"))
    f = f.select("path", "encoding", F.filter(F.split(F.regexp_replace("_text", "^\ufeff", ""), r"\r\n|\n|\r"),
                                              lambda line: F.trim(line) != "").alias("lines"))
    # what stands in quotes does not count
    f = f.withColumn("_head", F.transform(F.slice("lines", 1, HEAD_LINES), lambda line: F.regexp_replace(line, '"[^"]*+"', "")))

    def candidate(i: int, d: str):
        counts = F.transform("_head", lambda line: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))))
        least = F.array_min(counts)
        return F.when((least > 0) & (least == F.array_max(counts)), F.struct(least.alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")))

    best = F.array_max(F.filter(F.array(*[candidate(i, d) for i, d in enumerate(DELIMITERS)]), lambda x: x.isNotNull()))
    delimiter = F.lit(sep) if sep else F.coalesce(best["d"], F.lit(","))
    has_header = F.lit(header) if header is not None else F.coalesce(~F.get("lines", 0).rlike(_NUMERIC_TOKEN), F.lit(False))
    return f.select("path", "encoding", delimiter.alias("delimiter"), has_header.alias("has_header"), "lines")


def parsed_lines(lines: DataFrame, schema: T.StructType = HISTORICAL_MAPPING) -> DataFrame:
    """One row per record of ``file_lines``: path, encoding, delimiter,
    ``line_no``, ``record`` (typed by ``schema``) and ``malformed`` (the raw
    line when its fields do not fit the schema, else null).

    Files with different delimiters are read by one plan: each line goes
    through the parser of its file's delimiter.  A record is a line.
    """
    sch = T.StructType([*schema.fields, T.StructField("_malformed", T.StringType())])
    rows = lines.select("path", "encoding", "delimiter", "has_header", F.posexplode("lines").alias("line_no", "_line"))
    rows = rows.where(~(F.col("has_header") & (F.col("line_no") == 0)))
    parse = None
    for d in DELIMITERS:
        as_rows = F.from_csv(F.col("_line"), sch.simpleString()[7:-1].replace(":", " "), {
            "sep": d, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
        parse = F.when(F.col("delimiter") == d, as_rows) if parse is None else parse.when(F.col("delimiter") == d, as_rows)
    rows = rows.withColumn("_r", parse)
    fields = [F.col(f"_r.`{f.name}`").alias(f.name) for f in schema.fields]
    malformed = F.when(F.col("_r").isNull() | F.col("_r._malformed").isNotNull(), F.col("_line"))
    return rows.select("path", "encoding", "delimiter", "line_no", F.struct(*fields).alias("record"), malformed.alias("malformed"))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType = HISTORICAL_MAPPING,
                   sep: str = ",", header: bool = True, encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine).  Malformed rows (wrong field count) go to the
    quarantine side with their raw text."""
    rows = parsed_lines(file_lines(reference_bytes(spark, path), encoding, sep, header), schema)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("_source_file")
    good = rows.where(F.col("malformed").isNull()).select("record.*", name)
    return good, rows.where(F.col("malformed").isNotNull()).select(name, F.col("malformed").alias("_corrupt_record"))


def sniff_delimiter(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``delimiter`` and ``has_header`` of every file of a folder."""
    return file_lines(reference_bytes(spark, path)).select(F.col("path").alias("file"), "delimiter", "has_header")


def read_json_reference(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line JSON reference files."""
    return spark.read.option("multiLine", True).json(path)


def decode_files(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 when valid, else ISO-8859-1, per file."""
    b = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    return b.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), utf8)
                    .otherwise(F.decode("content", "ISO-8859-1")).alias("text"),
                    F.when(F.is_valid_utf8(F.col("content").cast("string")), "UTF-8")
                    .otherwise("ISO-8859-1").alias("encoding"))


def load_profile(df: DataFrame) -> DataFrame:
    """Rows and columns per loaded file."""
    ncols = len([c for c in df.columns if not c.startswith("_")])
    return df.groupBy(F.col("_source_file").alias("file_name")).agg(
        F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(ncols))


def write_clean_copy(good: DataFrame, path: str) -> None:
    """K9: good rows of a reference file as CSV with header."""
    good.drop("_source_file").write.mode("overwrite").option("header", True).csv(path)
