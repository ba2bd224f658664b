"""Document flattening and profiling.

``xml_nodes`` explodes every document into one row per element in document
order.  Parsing happens once per document in an Arrow-batched
``mapInArrow`` task (Python is needed: no built-in expression enumerates
element names); everything after that — sample values, type inference,
parent paths, counters — is built-in Spark SQL.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmap.functions.types import infer_type, sample_value
from docmap.functions.xmlnodes import TYPES
from docmap.session import ensure_worker_code

NODES_PER_BATCH = 50_000  # rows after which a task hands on what it has

_NODE_FIELDS = [
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("node_path", T.StringType()),
    T.StructField("node_name", T.StringType()),
    T.StructField("attributes", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("parse_error", T.StringType()),
]


def _arrow_type(dt: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(dt)


def _flatten_fn(key_cols: list[str], raw_col: str, key_types: list[T.DataType]):
    node_names = [f.name for f in _NODE_FIELDS]
    out_schema = pa.schema(
        [pa.field(k, _arrow_type(t)) for k, t in zip(key_cols, key_types)]
        + [pa.field(f.name, _arrow_type(f.dataType)) for f in _NODE_FIELDS])

    def fn(batches):
        from docmap.functions.xmlnodes import walk_columns
        out_keys = {k: [] for k in key_cols}
        cols = {n: [] for n in node_names}

        def flush():
            done = pa.RecordBatch.from_pydict({**out_keys, **cols}, schema=out_schema)
            for held in (*out_keys.values(), *cols.values()):
                held.clear()
            return done

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keys = {k: part.column(k).to_pylist() for k in key_cols}
                for i, raw in enumerate(part.column(raw_col).to_pylist()):
                    count, err = walk_columns(raw, cols)
                    if err is not None:
                        for n, v in (("ordinal", -1), ("node_path", None), ("node_name", None),
                                     ("attributes", None), ("text", None), ("depth", None)):
                            cols[n].append(v)
                        count = 1
                    cols["parse_error"].extend([err] * count)
                    for k in key_cols:
                        out_keys[k].extend([keys[k][i]] * count)
                    if len(cols["ordinal"]) >= NODES_PER_BATCH:
                        yield flush()
        if cols["ordinal"]:
            yield flush()

    return fn


COUNTED = ["node_path", "node_name", "attributes", "text", "depth"]  # what nodes may be counted by
DOCS_PER_COUNT = 2_000  # documents whose nodes are held as counts at a time


class NodeCounter:
    """The reader of ``xml_nodes(by=..)``: nodes of up to ``DOCS_PER_COUNT``
    documents as counts."""

    def __init__(self, by: list[str]):
        fields = {f.name: f for f in _NODE_FIELDS}
        self.by, self.schema = by, T.StructType([fields[c] for c in (*by, "parse_error")] + [T.StructField("n", T.LongType())])

    def open(self) -> None:
        from docmap.functions.xmlnodes import PathCounts, attribute_names
        text, attributes = "text" in self.by, "attributes" in self.by
        value = None
        if text or attributes:
            value = lambda el: (el.text if text else None, attribute_names(el) if attributes else None)
        self.value, self.new = value, lambda: PathCounts(value)
        self.counts, self.errors, self.documents = self.new(), {}, 0

    def add(self, part, i: int, root, error: str | None):
        if root is None:
            self.errors[error] = self.errors.get(error, 0) + 1
        else:
            self.counts.add_tree(root)
        self.documents += 1
        return self.close() if self.documents >= DOCS_PER_COUNT else ()

    def end(self, part):
        return ()

    def close(self):
        if not self.documents:
            return
        rows, errors, value = {}, self.errors, self.value
        for path, name, depth, at in self.counts.entries():
            for (t, a), n in (at[4].items() if value is not None else (((None, None), at[0]),)):
                full = {"node_path": path, "node_name": name, "attributes": a, "text": t, "depth": depth}
                key = tuple(full[c] for c in self.by)
                rows[key] = rows.get(key, 0) + n
        cols = [[*c, *[None] * len(errors)] for c in zip(*rows)] if rows else [[None] * len(errors) for _ in self.by]
        yield [*cols, [None] * len(rows) + list(errors), [*rows.values(), *errors.values()]]
        self.counts, self.errors, self.documents = self.new(), {}, 0


def one_pass(docs: DataFrame, readers: dict, raw_col: str = "raw_xml", with_name: bool = True) -> DataFrame:
    """Rows of several readers by one parse of every document: ``reader`` (the
    name, unless ``with_name`` is false) and the columns of all, null in the
    rows of a reader that has no such column.

    A reader has a ``schema`` and may name ``key_cols``; in the task it is
    opened, given every document (its place in a part of a batch, its tree or
    its error), told the end of every part, and closed.  Each of these gives
    the rows to hand on, as one list or array for each column of its schema.
    """
    ensure_worker_code(docs.sparkSession)
    fields = {"reader": T.StructField("reader", T.StringType())} if with_name else {}
    for r in readers.values():
        for f in r.schema.fields:
            if fields.setdefault(f.name, f).dataType != f.dataType or (with_name and f.name == "reader"):
                raise ValueError(f"column {f.name} has two meanings")
    schema = T.StructType(list(fields.values()))
    types = {f.name: _arrow_type(f.dataType) for f in schema.fields}
    keys = dict.fromkeys(k for r in readers.values() for k in getattr(r, "key_cols", ()))

    def fn(batches):
        from docmap.functions.xmlnodes import parse
        for r in readers.values():
            r.open()

        def batch_of(name, r, columns):
            n, own = len(columns[0]), dict(zip(r.schema.names, columns))
            if with_name:
                own["reader"] = pa.repeat(name, n)
            cols = [pa.nulls(n, t) if c not in own else own[c].cast(t) if isinstance(own[c], pa.Array) else pa.array(own[c], t) for c, t in types.items()]
            return pa.RecordBatch.from_arrays(cols, names=list(types))

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for i, raw in enumerate(part.column(raw_col).to_pylist()):
                    root, error = parse(raw)
                    for name, r in readers.items():
                        for columns in r.add(part, i, root, error):
                            yield batch_of(name, r, columns)
                for name, r in readers.items():
                    for columns in r.end(part):
                        yield batch_of(name, r, columns)
        for name, r in readers.items():
            for columns in r.close():
                yield batch_of(name, r, columns)

    return docs.select(*keys, raw_col).mapInArrow(fn, schema)


def xml_nodes(docs: DataFrame, key_cols: list[str] | None = None, raw_col: str = "raw_xml",
              keep_errors: bool = True, by: list[str] | None = None) -> DataFrame:
    """One row per element: keys + ordinal, node_path, node_name,
    attributes, text (raw), depth.  A document that does not parse is one row
    with ``ordinal = -1``, ``parse_error`` and nulls, so that no document is
    lost on the way; ``keep_errors=False`` leaves these rows and the column out.

    With ``by`` (some of ``COUNTED``) the nodes of all documents are counted:
    a row for those that are equal in these columns, with their number ``n``
    in some documents (the numbers are to be added up), so that what leaves
    Python are the different nodes and not every one.  Documents that do not
    parse are counted by ``parse_error``, with nulls in the columns.
    """
    ensure_worker_code(docs.sparkSession)
    if by is not None:
        out = one_pass(docs, {"nodes": NodeCounter(by)}, raw_col, with_name=False)
        return out if keep_errors else out.where(F.col("parse_error").isNull()).drop("parse_error")
    key_cols = key_cols or ["xml_id"]
    src = docs.select(*key_cols, raw_col)
    key_types = [src.schema[k].dataType for k in key_cols]
    schema = T.StructType([src.schema[k] for k in key_cols] + _NODE_FIELDS)
    out = src.mapInArrow(_flatten_fn(key_cols, raw_col, key_types), schema)
    if not keep_errors:
        out = out.where(F.col("parse_error").isNull()).drop("parse_error")
    return out


def error_kind(error: str) -> F.Column:
    """A parse error without its place in the document, to count errors by."""
    return F.regexp_replace(F.regexp_replace(error, "^parse error: ", ""), ":.*$", "")


def parent_path(path) -> F.Column:
    """Path without its last step; NULL for the root (one ``/``)."""
    p = F.col(path) if isinstance(path, str) else path
    n_slash = F.length(p) - F.length(F.regexp_replace(p, "/", ""))
    return F.when(n_slash > 1, F.regexp_replace(p, "/[^/]*$", ""))


def node_profile(nodes: DataFrame) -> DataFrame:
    """The extractor's per-node metadata row (a document that does
    not parse has no type); counted nodes have what their columns allow."""
    out = [parent_path("node_path").alias("parent_path")]
    if "text" in nodes.columns:
        parsed = F.col("parse_error").isNull() if "parse_error" in nodes.columns else F.lit(True)
        out = [sample_value("text").alias("sample_value"), F.when(parsed, infer_type("text")).alias("data_type"), *out]
    return nodes.select("*", *out)


def document_profile(docs: DataFrame, key_cols: list[str] | None = None, raw_col: str = "raw_xml") -> DataFrame:
    """N6/N7 in the task that parses: a row for every document with its
    elements of each type (``n_integer``, ..), the 64-bit digests of its
    different ``paths``, and ``parse_error``."""
    key_cols = key_cols or ["xml_id"]
    ensure_worker_code(docs.sparkSession)
    src = docs.select(*key_cols, raw_col)
    schema = T.StructType([src.schema[k] for k in key_cols] + [T.StructField(f"n_{t}", T.LongType()) for t in TYPES]
                          + [T.StructField("paths", T.ArrayType(T.LongType())), T.StructField("parse_error", T.StringType())])
    out_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def fn(batches):
        from docmap.functions.xmlnodes import DocumentCounts, parse
        counts = DocumentCounts()
        for batch in batches:
            of_type, paths, errors = [], [], []
            for raw in batch.column(raw_col).to_pylist():
                root, error = parse(raw)
                n, p = ([0] * len(TYPES), []) if root is None else counts.of(root)
                of_type.append(n)
                paths.append(p)
                errors.append(error)
            by_type = list(zip(*of_type)) if of_type else [[] for _ in TYPES]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).cast(out_schema.field(k).type) for k in key_cols] + [pa.array(c, pa.int64()) for c in by_type]
                + [pa.array(paths, out_schema.field("paths").type), pa.array(errors, pa.string())], schema=out_schema)

    return src.mapInArrow(fn, schema)


def document_metadata(profile: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Per document node count, distinct paths, counts per inferred type,
    and ``parse_status`` (the kind of error where the document does not parse,
    which leaves zeros).  ``profile``: rows of ``node_profile``, or those of
    ``document_profile``, of which one small row per document is moved."""
    key_cols = key_cols or ["xml_id"]
    status = F.coalesce(F.max(error_kind("parse_error")), F.lit("ok")).alias("parse_status")
    if "paths" in profile.columns:
        of_type = [F.sum(f"n_{t}").alias(f"n_{t}") for t in TYPES]
        return profile.groupBy(*key_cols).agg(
            F.sum(reduce(lambda a, b: a + b, [F.col(f"n_{t}") for t in TYPES])).alias("node_count"),
            F.size(F.array_distinct(F.flatten(F.collect_list("paths")))).cast("bigint").alias("distinct_paths"), *of_type, status)
    return profile.groupBy(*key_cols).agg(
        F.count("node_path").alias("node_count"),
        F.count_distinct("node_path").alias("distinct_paths"),
        *[F.count_if(F.col("data_type") == t).alias(f"n_{t}") for t in TYPES],
        status,
    )


def node_counts(docs: DataFrame, key_cols: list[str] | None = None, raw_col: str = "raw_xml") -> DataFrame:
    """Keys and ``node_count`` of every document (0 if it does not
    parse), counted in the worker: one small row per document is shipped."""
    key_cols = key_cols or ["xml_id"]
    ensure_worker_code(docs.sparkSession)
    src = docs.select(*key_cols, raw_col)

    def fn(batches):
        from docmap.functions.xmlnodes import parse
        for batch in batches:
            counts = []
            for raw in batch.column(raw_col).to_pylist():
                root, _ = parse(raw)
                counts.append(0 if root is None else sum(isinstance(el.tag, str) for el in root.iter()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key_cols], pa.array(counts, pa.int64())],
                                             names=[*key_cols, "node_count"])

    return src.mapInArrow(fn, T.StructType([src.schema[k] for k in key_cols] + [T.StructField("node_count", T.LongType())]))


UNPARSED = "!unparsed"  # path under which documents that do not parse are counted


def _summary_fn(raw_col: str):
    out_schema = pa.schema([pa.field("node_path", pa.string()), pa.field("occurrences", pa.int64()),
                            pa.field("documents", pa.int64())])

    def fn(batches):
        from docmap.functions.xmlnodes import PathCounts
        for batch in batches:
            counts = PathCounts()
            unparsed = sum(not counts.add(raw) for raw in batch.column(raw_col).to_pylist())
            rows = counts.rows() + ([(UNPARSED, unparsed, unparsed)] if unparsed else [])
            yield pa.RecordBatch.from_pydict(dict(zip(out_schema.names, map(list, zip(*rows)))) if rows else {n: [] for n in out_schema.names},
                                             schema=out_schema)

    return fn


def path_summary(docs: DataFrame, raw_col: str = "raw_xml") -> DataFrame:
    """N2/N7 corpus summary: occurrences and documents per absolute path.

    Map-side combine in the worker: each Arrow batch of documents is reduced
    to one row per distinct path before anything leaves Python, and Spark
    sums the partial counts (exact: a document belongs to one batch).
    Documents that do not parse are counted under the path ``UNPARSED``.
    """
    ensure_worker_code(docs.sparkSession)
    partial = docs.select(raw_col).mapInArrow(
        _summary_fn(raw_col), "node_path string, occurrences long, documents long")
    return partial.groupBy("node_path").agg(F.sum("occurrences").alias("occurrences"),
                                            F.sum("documents").alias("documents"))
