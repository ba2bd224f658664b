"""Mapping application: compile approved mappings into one typed projection.

All approved source paths of a target table are merged into a prefix tree,
and one Arrow-batched pass reads them from every document: each document is
parsed once per table no matter how many columns are mapped, by the parser
that flattening uses, so both agree on which documents can be read.  At each
step the first matching child is taken (a missing step gives NULL); with a
record path every element of it is followed.  The built-in ``from_xml`` is not
used: it folds the case of names, keeps one piece of text around comments and
children, and reads documents with rubbish after the end.  Coercion,
transformations and output are built-in Spark expressions.

The mapping list itself is configuration (one row per target column) and is
collected to the driver, never the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmap.functions import transform as tx
from docmap.functions.types import coerce_by_rule, coerce_declared, name_rule
from docmap.functions.xmlnodes import Wanted
from docmap.operators.nodes import one_pass
from docmap.session import ensure_worker_code, written

# ------------------------------------------------------------------ X1 / X2
def is_surrogate_key(col: Column) -> Column:
    """Target column names that are skipped (contain ``_ID`` or equal ``ID``)."""
    u = F.upper(col)
    return F.coalesce((F.instr(u, "_ID") > 0) | (u == "ID"), F.lit(False))


def first_wins(mappings: DataFrame, order_cols: list[str], skip_ids: bool = True,
               partition: list[str] | None = None) -> DataFrame:
    """X1 + X2: drop surrogate keys, keep the first mapping per target column.

    ``order_cols`` is the input ordinal; ``partition`` defaults to
    (target_table, target_column) — add a document key to run it for many
    documents at once.
    """
    from docmap.operators.references import first_per_group
    part = partition or ["target_table", "target_column"]
    m = mappings
    if skip_ids:
        m = m.where(~is_surrogate_key(F.col("target_column")))
    return first_per_group(m, part, order_cols)


# ------------------------------------------------------------------ X3 compile
def split_path(path: str, root: str) -> tuple[list[str], str | None]:
    """Steps below the root element and an optional trailing ``@attribute``.

    ``/Root/A/B`` and ``A/B`` (relative to the root element) are the same path;
    a path whose first step is not the root gives ``None`` steps.
    """
    p = path.strip()
    absolute = p.startswith("/")
    steps = [s for s in p.split("/") if s != ""]
    attr = None
    if steps and steps[-1].startswith("@"):
        attr = steps.pop()[1:]
    if absolute:
        if not steps or steps[0] != root:
            return None, None
        steps = steps[1:]
    elif steps and steps[0] == root:
        steps = steps[1:]
    return steps, attr


def compile_paths(paths: list[str], root: str, record_path: str | None = None) -> tuple[list[Wanted], list[str]]:
    """Prefix trees of ``paths`` (one for each step of the record path) and the
    record path's steps.  A path hangs on the last record ancestor it shares;
    one that cannot be reached from ``root`` stays without a place."""
    steps = split_path(record_path, root)[0] if record_path else []
    if steps is None or (record_path and not steps):
        raise ValueError(f"record path {record_path} is not below {root}")
    levels = [Wanted() for _ in range(len(steps) + 1)]
    for place, path in enumerate(paths):
        below, attr = split_path(path, root) if path else (None, None)
        if below is None or (not below and attr is None):
            continue
        k = 0
        while k < len(steps) and k < len(below) and below[k] == steps[k]:
            k += 1
        levels[k].add(below[k:], attr, place)
    return levels, steps


VALUES_PER_BATCH = 200_000  # values after which a task hands on what it has


def read_paths(docs: DataFrame, paths: list[str], key_cols: list[str], root: str = "Session", raw_col: str = "raw_xml",
               record_path: str | None = None) -> DataFrame:
    """One parse of every document -> keys, ``parse_error``, ``values``.

    ``values`` holds the text at each of ``paths`` (null: absent, empty text:
    present and empty).  Names are compared exactly, without namespace
    prefixes; text is all of an element's own text.  A document that does not
    parse, or has another document element, is one row with ``parse_error``
    and null values.  With ``record_path`` every record is a row, with
    ``record_index`` (running number, null where an ancestor has no record)
    and ``record_ordinals`` (its number among its siblings at every step).
    """
    return one_pass(docs, {"paths": path_reader(docs, paths, key_cols, root, record_path)}, raw_col, with_name=False).drop("table")


def path_reader(docs: DataFrame, paths: list[str], key_cols: list[str], root: str = "Session", record_path: str | None = None) -> TableReader:
    """The reader of ``read_paths``, for ``nodes.one_pass`` over ``docs``."""
    return TableReader(docs.select(*key_cols).schema, [(paths, record_path)], root)


def read_tables(docs: DataFrame, wanted: list[tuple[list[str], str | None]], key_cols: list[str], root: str = "Session",
                raw_col: str = "raw_xml") -> DataFrame:
    """``read_paths`` for several (paths, record path) by one parse of every
    document; ``table`` is the place in ``wanted`` that a row belongs to."""
    return one_pass(docs, {"tables": TableReader(docs.select(*key_cols).schema, wanted, root)}, raw_col, with_name=False)


class TableReader:
    """The reader (``nodes.one_pass``) of ``read_tables``; ``keys`` are the key
    columns of the documents."""

    def __init__(self, keys: T.StructType, wanted: list[tuple[list[str], str | None]], root: str = "Session"):
        self.key_cols, self.root = keys.names, root
        self.tables = [(*compile_paths(paths, root, record_path), len(paths)) for paths, record_path in wanted]
        self.width = max(1, *[n for *_, n in self.tables])
        self.schema = T.StructType(keys.fields + [
            T.StructField("table", T.IntegerType()), T.StructField("parse_error", T.StringType()), T.StructField("record_index", T.IntegerType()),
            T.StructField("record_ordinals", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.StringType()))])

    def open(self) -> None:
        self.source, self.rows = [], {c: [] for c in ("table", "parse_error", "record_index", "record_ordinals", "values")}

    def add(self, part, i: int, doc, error: str | None):
        from docmap.functions.xmlnodes import local_name, record_rows
        source, rows = self.source, self.rows
        if doc is not None and local_name(doc.tag) != self.root:
            error = f"other document element: {local_name(doc.tag)}"
        for table, (levels, steps, n) in enumerate(self.tables):
            if error is not None:
                source.append(i)
                for c, v in (("table", table), ("parse_error", error), ("record_index", None), ("record_ordinals", None),
                             ("values", [None] * n)):
                    rows[c].append(v)
                continue
            count = 0
            for ordinals, values in record_rows(doc, levels, steps, n):
                whole = bool(steps) and ordinals[-1] is not None
                source.append(i)
                rows["table"].append(table)
                rows["parse_error"].append(None)
                rows["record_index"].append(count if whole else None)
                rows["record_ordinals"].append(ordinals)
                rows["values"].append(values)
                count += whole
                if len(source) * self.width >= VALUES_PER_BATCH:
                    yield from self.end(part)

    def end(self, part):
        if self.source:
            at = pa.array(self.source, pa.int32())
            columns = [part.column(k).take(at) for k in self.key_cols] + list(self.rows.values())
            self.open()
            yield columns

    def close(self):
        return ()


@dataclass
class CompiledMapping:
    target_column: str
    source_node: str
    transformation: str | None
    sql_type: str | None


def collect_mappings(mappings: DataFrame, order_cols: list[str] | None = None) -> list[CompiledMapping]:
    """Bring the approved mappings of one target table to the driver in input
    order: after ``first_wins`` at most one row for each of its columns."""
    cols = mappings.columns
    order_cols = order_cols if order_cols is not None else [c for c in ("ord",) if c in cols]
    sel = [F.col("target_column"), F.col("source_node"),
           (F.col("transformation_logic") if "transformation_logic" in cols else F.lit(None)).cast("string").alias("t"),
           (F.col("target_type") if "target_type" in cols else F.lit(None)).cast("string").alias("ty")]
    m = mappings.select(*sel, *order_cols)
    if order_cols:
        m = m.orderBy(*order_cols)
    return [CompiledMapping(r.target_column, r.source_node, r.t, r.ty) for r in m.collect()]


def typed(m: CompiledMapping, value: Column, mode: str = "declared") -> Column:
    """One raw value coerced (or transformed) for its target column."""
    if not tx.is_identity(m.transformation):
        return tx.apply_transform(m.transformation, value)
    if mode == "name_rules":
        return coerce_by_rule(value, name_rule(m.target_column))
    return coerce_declared(value, m.sql_type or "STRING")


def project(docs: DataFrame, mappings: list[CompiledMapping], key_cols: list[str],
            root: str = "Session", raw_col: str = "raw_xml", mode: str = "declared",
            record_path: str | None = None, strings: bool = False,
            empty_as_blank: bool = False, with_status: bool = False, with_ordinals: bool = False) -> DataFrame:
    """One parse, one projection.

    mode ``declared`` coerces by each mapping's ``sql_type``; ``name_rules``
    applies the X4-X8 rules chosen from the column name.  ``strings=True``
    gives the all-string view form (X12, untrimmed); ``empty_as_blank``
    turns missing values into '' (X13).  With ``record_path`` every record
    below that path becomes one output row (X17) with ``record_index`` (and
    ``with_ordinals`` its number at every step, ``record_ordinals``).

    Documents that do not parse have no row here; ``with_status`` keeps them,
    as rows with ``parse_error`` and nulls, so that one pass over the
    documents gives the typed rows and the ledger of those that failed.
    """
    stage = read_paths(docs, [m.source_node for m in mappings], key_cols, root, raw_col, record_path)
    return _project(stage, mappings, key_cols, mode, record_path, strings, empty_as_blank, with_status, with_ordinals)


def _project(stage: DataFrame, mappings: list[CompiledMapping], key_cols: list[str], mode: str, record_path: str | None, strings: bool = False,
             empty_as_blank: bool = False, with_status: bool = False, with_ordinals: bool = False) -> DataFrame:
    """``project`` of the values that ``read_paths`` has read."""
    extra = (["record_index"] if record_path else []) + (["record_ordinals"] if with_ordinals else [])
    if with_status:
        extra.append("parse_error")
    else:
        stage = stage.where(F.col("parse_error").isNull())
    out = []
    for i, m in enumerate(mappings):
        v = F.col("values")[i]
        c = v if strings else typed(m, v, mode)
        if empty_as_blank:
            c = F.coalesce(c.cast("string"), F.lit(""))
        out.append(c.alias(m.target_column))
    return stage.select(*key_cols, *extra, *out)


def parse_ledger(docs: DataFrame, key_cols: list[str], root: str = "Session", raw_col: str = "raw_xml") -> DataFrame:
    """One status row (keys, ``parse_error``) for every document that extraction
    cannot read."""
    return (read_paths(docs, [], key_cols, root, raw_col).where(F.col("parse_error").isNotNull())
            .select(*key_cols, "parse_error"))


def string_view(docs: DataFrame, mappings: list[CompiledMapping], id_col: str = "xml_id", root: str = "Session",
                raw_col: str = "raw_xml", empty_as_blank: bool = False) -> DataFrame:
    """All-string untrimmed view whose first column, ``SOURCE_XML_ID``,
    is the document's id."""
    return project(docs.withColumnRenamed(id_col, "SOURCE_XML_ID"), mappings, ["SOURCE_XML_ID"], root=root, raw_col=raw_col,
                   strings=True, empty_as_blank=empty_as_blank)


def quarantine_transforms(mappings: DataFrame) -> DataFrame:
    """X15 check as a column: reason text when a transformation is not allowed."""
    ensure_worker_code(mappings.sparkSession)

    @F.udf("string")
    def _why(t):
        from docmap.functions.transform import validate
        return validate(t)
    # the few distinct texts are checked, not every mapping
    texts = mappings.select(F.col("transformation_logic").alias("_t")).distinct().withColumn("transform_error", _why("_t"))
    return mappings.join(texts, F.col("transformation_logic").eqNullSafe(F.col("_t")), "left").drop("_t")


def bronze_missing(ledger: DataFrame, bronze: DataFrame, key: str = "xml_id") -> DataFrame:
    """X11: (document, table) pairs whose document has no Bronze row -> status NO_BRONZE."""
    pairs = ledger.select(key, "target_table").distinct()
    return (pairs.join(bronze.select(key).distinct(), key, "left_anti")
            .withColumn("status", F.lit("NO_BRONZE")))


def load_silver(docs: DataFrame, mappings: DataFrame, target_table: str, key_cols: list[str],
                columns: list[str] | None = None, order_cols: list[str] | None = None,
                mode: str = "declared", record_path: str | None = None,
                root: str = "Session", column_types: dict[str, str] | None = None) -> DataFrame:
    """Typed rows for one target table from all documents at once.

    ``columns`` fixes the output columns; those without a mapping are NULLs
    of the type in ``column_types`` (string if it names none).

    ``mappings``: source_node, target_table, target_column,
    transformation_logic, target_type and an ordinal column.  With no
    usable column left, the result has the key columns only and 0 rows.
    """
    order_cols = order_cols or ["ord"]
    m = first_wins(mappings.where(F.upper("target_table") == target_table.upper()), order_cols)
    compiled = collect_mappings(m, order_cols)
    if not compiled:
        return docs.select(*key_cols).limit(0)
    out = project(docs, compiled, key_cols, root=root, mode=mode, record_path=record_path)
    if columns:
        present = set(c.target_column for c in compiled)
        types = column_types or {}
        out = out.select(*key_cols, *(["record_index"] if record_path else []),
                         *[F.col(c) if c in present else F.lit(None).cast(types.get(c, "string")).alias(c)
                           for c in columns])
    return out


def load_tables(docs: DataFrame, mappings: DataFrame, tables: list[str], key_cols: list[str],
                order_cols: list[str] | None = None, mode: str = "declared",
                record_paths: dict[str, str] | None = None, root: str = "Session",
                write: Callable[[str, DataFrame], None] | None = None):
    """Typed rows for several target tables with per-table isolation.

    Returns ``(frames, status)``: a DataFrame per loadable table and one status
    row per table (OK / PARTIAL when some mappings were quarantined because
    their transformation is not allowed / NO_COLUMNS / FAILED with the error).
    A failing table never stops the others.  Spark runs a table only when it
    is written, so give ``write`` (table name, rows) to have errors of that
    time in the status as well, with ``rows_written`` and the documents that
    did not parse, both counted while the rows are written; without it only
    the plans are checked and these are null.  To be written, the values of all
    tables are read by one parse of every document and kept by table, so that
    the documents are not built and parsed again for each.
    """
    order_cols, paths_of = order_cols or ["ord"], record_paths or {}
    frames, status = {}, [None] * len(tables)
    compiled_for = {}  # place in ``tables`` -> usable mappings, errors of the others

    def failed(i: int, e: Exception) -> None:
        frames.pop(tables[i], None)
        compiled_for.pop(i, None)
        status[i] = (tables[i], "FAILED", str(e), 0, None, None)

    for i, t in enumerate(tables):
        try:
            m = first_wins(mappings.where(F.upper("target_table") == t.upper()), order_cols)
            compiled = collect_mappings(m, order_cols)
            errors = {c.target_column: tx.validate(c.transformation) for c in compiled}
            good = [c for c in compiled if errors[c.target_column] is None]
            bad = [f"{c}: {e}" for c, e in errors.items() if e is not None]
            if not good:
                status[i] = (t, "NO_COLUMNS", "; ".join(bad) or "no mapped columns", 0, None, None)
                continue
            compile_paths([c.source_node for c in good], root, paths_of.get(t))
            compiled_for[i] = (good, bad)
        except Exception as e:  # noqa: BLE001 - isolate the table, report the error
            failed(i, e)
    stage = None
    if write is not None and len(compiled_for) > 1:
        try:
            read = read_tables(docs, [([c.source_node for c in good], paths_of.get(tables[i])) for i, (good, _) in compiled_for.items()],
                               key_cols, root)
            stage = written(read, "table-values", by=["table"])
        except Exception as e:  # noqa: BLE001 - no table can be read
            for i in list(compiled_for):
                failed(i, e)
    for place, (i, (good, bad)) in enumerate(list(compiled_for.items())):
        t = tables[i]
        try:
            if stage is None:
                rows = project(docs, good, key_cols, root=root, mode=mode, record_path=paths_of.get(t), with_status=True)
            else:
                rows = _project(stage.where(F.col("table") == place), good, key_cols, mode, paths_of.get(t), with_status=True)
            seen = None
            if write is not None:
                seen = Observation()
                parsed = F.col("parse_error").isNull()
                rows = rows.observe(seen, F.count_if(parsed).alias("rows"), F.count_if(~parsed).alias("unparsed"))
            frames[t] = rows.where(F.col("parse_error").isNull()).drop("parse_error")
            if write is not None:
                write(t, frames[t])
            counted = (seen.get["rows"], seen.get["unparsed"]) if seen else (None, None)
            status[i] = (t, "PARTIAL" if bad else "OK", "; ".join(bad) or None, len(good), *counted)
        except Exception as e:  # noqa: BLE001 - isolate the table, report the error
            failed(i, e)
    st = docs.sparkSession.createDataFrame(status, "target_table string, status string, error string, columns int, rows_written long, "
                                                   "unparsed_documents long")
    return frames, st
