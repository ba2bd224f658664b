"""Turn the driver's relational tables into the engine's inputs.

* ``order_documents``: one XML transaction document per order *part*
  (orders + customer + lineitem -> ``to_xml``).  Line items are dealt into
  parts of about ``RECORDS_PER_PART`` records by a per-order count, copies of
  one line item round-robin, so an order with millions of line items, equal
  ones included, becomes many documents.  Every value is cast to text
  *before* ``to_xml`` so the document text is stable.  A fixed share of the
  documents has what real ones have: long comments, document types, byte
  order marks, processing instructions, escaped markup and CDATA.
* ``mapping_ledger``: one mapping row per lineitem (ledger operators).
* ``typed_strings``: columns of part/orders/customer as text plus fixed
  edge cases (type inference and coercion operators).

The DuckDB oracles in ``docmap.plans.oracle`` rebuild the same values from
the base tables, so extraction is checked end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmap.session import partitions_for, written
from docmap.sources.bronze import land_documents

RECORDS_PER_PART = 16
# Bytes of XML per document partition the parse stages should see, and the
# growth of columnar line-item bytes into document text.
DOC_PARTITION_BYTES = 64 * 1024 * 1024
TEXT_EXPANSION = 8


def doc_partitions(spark: SparkSession, lineitem: DataFrame) -> int:
    """Partitions for the document stages: enough for every core, and sized so
    each holds about DOC_PARTITION_BYTES of XML text at any scale."""
    return partitions_for(lineitem, DOC_PARTITION_BYTES, TEXT_EXPANSION)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dec_text(c, scale: int = 2) -> Column:
    """Number -> fixed-scale decimal text (``1250.00``)."""
    return F.col(c).cast(f"decimal(15,{scale})").cast("string") if isinstance(c, str) \
        else c.cast(f"decimal(15,{scale})").cast("string")


LINE_FIELDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
               "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _part_expr(copy: Column, n_parts: Column) -> Column:
    # Deterministic dealer (also written in the oracle SQL): by the keys of
    # the line item, and its copies one after the other.
    h = F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 31 + copy
    return F.pmod(h, n_parts).cast("int")


def split_orders(li: DataFrame) -> DataFrame:
    """(l_orderkey, n_parts) of the orders whose line items fill more than one
    document, written once: its size decides how it is joined."""
    n = F.ceil(F.count(F.lit(1)) / RECORDS_PER_PART).cast("int")
    return written(li.groupBy("l_orderkey").agg(n.alias("n_parts")).where("l_orderkey IS NOT NULL AND n_parts > 1"), "split-orders")


def whole_items(li: DataFrame, split: DataFrame) -> DataFrame:
    """Line items of the orders that are one document (``part`` 0)."""
    return (li.where("l_orderkey IS NOT NULL").join(split, "l_orderkey", "left_anti")
            .withColumn("part", _part_expr(F.lit(0), F.lit(1))).select(*LINE_FIELDS, "part"))


def dealt_items(li: DataFrame, split: DataFrame) -> DataFrame:
    """Line items of the orders that are many documents, with the ``part``
    that each goes to.

    Copies of a line item are counted before the shuffle and dealt one after
    the other.  The join is on the order, but its sides are plain exchanges
    that AQE may split, and what follows groups by (order, part).
    """
    copies = li.join(split, "l_orderkey").groupBy(*LINE_FIELDS, "n_parts").agg(F.count(F.lit(1)).alias("_times"))
    return (copies.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1)))
            .withColumn("part", _part_expr(F.col("_copy"), F.col("n_parts"))).select(*LINE_FIELDS, "part"))


def _records(items: DataFrame) -> DataFrame:
    """(o_orderkey, part, recs): the records of every document part, in the
    order of their keys and then the remaining fields, so that it is total."""
    rec = F.struct(
        F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_quantity").alias("t1"), F.col("l_extendedprice").alias("t2"), F.col("l_discount").alias("t3"),
        F.col("l_tax").alias("t4"), F.col("l_returnflag").alias("t5"), F.col("l_linestatus").alias("t6"),
        F.col("l_shipdate").alias("t7"))
    # (sort_array compares rows itself, array_sort by an expression that it interprets)
    return items.groupBy(F.col("l_orderkey").alias("o_orderkey"), "part").agg(F.sort_array(F.collect_list(rec)).alias("recs"))


def _whole_parts(li: DataFrame, split: DataFrame, n: int) -> DataFrame:
    # few line items each, so they may go by their order alone
    return _records(whole_items(li, split).repartition(n, "l_orderkey"))


def _split_parts(li: DataFrame, split: DataFrame, n: int) -> DataFrame:
    # The exchange is on (order, part): without it the grouping would reuse
    # the join's distribution by order and build a hot order in one task.
    return _records(dealt_items(li, split).repartition(n, "l_orderkey", "part"))


def order_parts(li: DataFrame) -> DataFrame:
    """(o_orderkey, part, recs): the records of every document part."""
    n, split = doc_partitions(li.sparkSession, li), split_orders(li)
    return _whole_parts(li, split, n).unionByName(_split_parts(li, split, n))


def parts_of_orders(orders: DataFrame, li: DataFrame, split: DataFrame, keep_empty: bool) -> DataFrame:
    """Columns of ``orders`` with ``part`` and ``recs``, a row for every document
    part; ``keep_empty`` keeps orders without line items as a part of their own.

    The line items of an order that is one document are dealt by the order, so
    that the join moves the orders to them and not the grouped records.  The
    parts of the others are joined on the order by exchanges that AQE may split.
    """
    n = doc_partitions(li.sparkSession, li)
    key = split.select(F.col("l_orderkey").alias("o_orderkey"))
    whole = (orders.join(key, "o_orderkey", "left_anti").join(_whole_parts(li, split, n), "o_orderkey", "left" if keep_empty else "inner")
             .withColumn("part", F.when(F.col("recs").isNull(), 0).otherwise(F.col("part"))))
    many = _split_parts(li, split, n).join(orders.join(key, "o_orderkey", "left_semi"), "o_orderkey")
    return whole.unionByName(many)


def record_text(r: Column) -> dict[str, Column]:
    """The fields of a record as text."""
    text = lambda c: r[c].cast("string")
    return {
        "_id": F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), text("ln"), F.lit("-"), text("pk")),
        "CoverageCode": text("pk"), "SupplierCode": text("sk"), "LineNumber": text("ln"),
        "Quantity": dec_text(r["t1"]), "LimitAmount": dec_text(r["t2"]), "DiscountRate": dec_text(r["t3"]), "TaxRate": dec_text(r["t4"]),
        "ReturnFlag": r["t5"], "LineStatus": r["t6"], "ShipDate": F.date_format(r["t7"], "yyyy-MM-dd")}


# Fixed prologs of some documents, by order key.
LONG_COMMENT, HUGE_COMMENT = 3_000, 1_000_000


def _prolog() -> Column:
    k = F.col("o_orderkey")
    # the lengths depend on a column (by nothing), or the folded comments would
    # be megabytes of literals in every plan
    times = lambda text, n: F.expr(f"repeat('{text}', CAST({n} + pmod(o_orderkey, 1) AS INT))")
    xml = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n')
    return (F.when(k % 4001 == 1, F.concat(xml, F.lit("<!--"), times("c > d ", HUGE_COMMENT // 6), F.lit("-->")))
            .when(k % 16 == 1, F.concat(xml, F.lit("<!--"), times("a - b ", LONG_COMMENT // 6), F.lit("-->\n")))
            .when(k % 16 == 3, F.concat(xml, F.lit("<!DOCTYPE Session [<!ELEMENT Session ANY>]>\n")))
            .when(k % 16 == 5, F.concat(F.lit("\ufeff"), xml))
            .when(k % 16 == 7, F.concat(xml, F.lit("<?note a > b?>\n")))
            .otherwise(xml))


def _damaged(raw: Column, k: Column) -> Column:
    """Some documents do not parse: cut short, with rubbish after the end, with
    an entity that nothing declares, or missing altogether."""
    return (F.when(k % 256 == 10, F.lit(None).cast("string"))
            .when(k % 64 == 2, F.regexp_replace(raw, "</Session>$", ""))
            .when(k % 64 == 4, F.concat(raw, F.lit(" end of file")))
            .when(k % 64 == 6, F.regexp_replace(raw, "</Session>$", "&nope;</Session>")).otherwise(raw))


def _priority() -> Column:
    """Priority, in some documents with markup in its text (escaped, or in a
    CDATA section, see ``order_documents``) or with a product's code."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return (F.when(k % 16 == 9, F.concat(F.lit("<b>"), p, F.lit("</b>")))
            .when(k % 16 == 11, F.concat(F.lit("<i>"), p, F.lit("</i>")))
            .when(k % 16 == 13, F.concat(F.lit("Plan PA001 "), p)).otherwise(p))


def _segment_struct(segment: str, fields: dict[str, Column]) -> Column:
    return F.when(F.col("c_mktsegment") == segment, F.struct(*[v.alias(k) for k, v in fields.items()]))


def order_documents(spark: SparkSession, sf_dir: str, split: DataFrame | None = None) -> DataFrame:
    """Raw XML order documents: (o_orderkey, part, file_name, file_path, raw_xml).
    ``split``: ``split_orders`` of the line items, where it is there already."""
    li = read_table(spark, sf_dir, "lineitem")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    orders = read_table(spark, sf_dir, "orders")
    orders = orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
    doc = parts_of_orders(orders, li, split_orders(li) if split is None else split, keep_empty=True)
    ck = F.col("c_custkey")
    year = (F.lit(1950) + ck % 70).cast("string")
    coverage = F.transform(F.col("recs"), lambda r: F.struct(*[c.alias(k) for k, c in record_text(r).items()]))
    session = F.struct(
        F.struct(
            F.concat(F.lit("TX-"), F.col("o_orderkey").cast("string"), F.lit("-"),
                     F.col("part").cast("string")).alias("TransactionID"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("TransactionDate"),
            F.lit("ORDERS").alias("SourceSystem"),
            F.col("part").cast("string").alias("DocumentPart"),
        ).alias("TransactionInfo"),
        F.struct(
            F.struct(
                F.col("o_orderkey").cast("string").alias("PolicyNumber"),
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("EffectiveDate"),
                dec_text("o_totalprice").alias("TotalPremium"),
                F.col("o_orderstatus").alias("PolicyStatus"),
                _priority().alias("Priority"),
                F.when(F.col("o_orderpriority").rlike("^[12]-"), "true").otherwise("false").alias("IsPriority"),
            ).alias("Policy"),
            F.struct(
                F.concat(F.lit("C"), ck.cast("string")).alias("_id"),
                F.col("o_custkey").cast("string").alias("AccountNumber"),
                F.col("c_name").alias("AccountName"),
                F.col("c_mktsegment").alias("Segment"),
                dec_text("c_acctbal").alias("Balance"),
                F.col("c_nationkey").cast("string").alias("NationCode"),
            ).alias("Account"),
            _segment_struct("AUTOMOBILE", {
                "VIN": F.concat(F.lit("VIN"), F.lpad(ck.cast("string"), 10, "0")),
                "Make": F.concat(F.lit("MK"), (ck % 20).cast("string")),
                "Model": F.concat(F.lit("MD"), (ck % 7).cast("string")),
                "_vehiclevin": ck.cast("string"),
            }).alias("Vehicle"),
            _segment_struct("HOUSEHOLD", {
                "ConstructionType": F.lit("Frame"),
                "Occupancy": F.lit("Owner"),
                "BuildingYear": F.when(ck % 11 == 3, F.concat(F.lit("about "), year)).when(ck % 11 == 7, " ").otherwise(year),
                "_propertyvalues": ck.cast("string"),
            }).alias("Dwelling"),
            _segment_struct("BUILDING", {
                "BusinessName": F.col("c_name"),
                "OccupancyType": F.lit("Office"),
            }).alias("CommercialBuilding"),
            _segment_struct("MACHINERY", {
                "EmployeeCount": (ck % 500).cast("string"),
                "PayrollAmount": dec_text("c_acctbal"),
            }).alias("Payroll"),
            F.struct(coverage.alias("Coverage")).alias("Coverages"),
        ).alias("Data"),
    )
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit("_"),
                    F.col("part").cast("string"), F.lit(".xml"))
    # the text is a column of its own before each step that names it twice
    doc = doc.select("o_orderkey", "part", F.to_xml(session, {"rowTag": "Session", "indent": ""}).alias("_body"))
    body = F.when(F.col("o_orderkey") % 16 == 11, F.regexp_replace(
        "_body", "<Priority>&lt;i&gt;([^&<]*)&lt;/i&gt;</Priority>", r"<Priority><![CDATA[<i>$1</i>]]></Priority>")).otherwise(F.col("_body"))
    doc = doc.select("o_orderkey", "part", F.concat(_prolog(), body).alias("_raw"))
    return doc.select(
        "o_orderkey", "part",
        name.alias("file_name"),
        F.concat(F.lit(f"{sf_dir}/documents/"), name).alias("file_path"),
        _damaged(F.col("_raw"), F.col("o_orderkey")).alias("raw_xml"),
    )


ORDERS_PER_ACCOUNT = 8  # about so many order parts in an account document


def account_documents(spark: SparkSession, sf_dir: str, split: DataFrame | None = None) -> DataFrame:
    """Raw XML account documents: (c_custkey, account_part, raw_xml).

    Two levels repeat: an account's orders, and each order's lines (orders
    divisible by 7 have none).  Beside ``Name`` there is another element
    ``name``; ``Memo`` has a comment and ``Remark`` a child amid its text.  The
    order parts of an account are dealt to documents like line items to parts.
    """
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    split, n = split_orders(li) if split is None else split, doc_partitions(spark, li)
    # how many documents an account has is known before any record is moved
    keys = whole_items(li, split).unionByName(dealt_items(li, split)).select(F.col("l_orderkey").alias("o_orderkey"), "part").distinct()
    counts = keys.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey").agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / ORDERS_PER_ACCOUNT)).cast("int").alias("n_docs"))
    counts = written(counts, "account-counts")
    parts = parts_of_orders(orders.join(counts, "o_custkey"), li, split, keep_empty=False)
    line = F.transform(F.col("recs"), lambda r: F.struct(
        *[record_text(r)[c].alias(k) for k, c in (("_id", "_id"), ("Part", "CoverageCode"), ("Quantity", "Quantity"))]))
    order = F.struct(
        F.col("o_orderkey").alias("k"), F.col("part").alias("p"),
        F.concat_ws("-", "o_orderkey", "part").alias("_id"), dec_text("o_totalprice").alias("Total"),
        F.when(F.col("o_orderkey") % 7 != 0, F.struct(line.alias("Line"))).alias("Lines"))
    dealt = parts.select("o_custkey", F.pmod(F.col("o_orderkey") * 7 + F.col("part"), F.col("n_docs")).cast("int").alias("account_part"),
                         order.alias("_order")).withColumn("_at", F.coalesce("account_part", F.lit(-1)))
    grouped = (dealt.repartition(n, "o_custkey", "_at").groupBy("o_custkey", "_at", "account_part")
               .agg(F.sort_array(F.collect_list("_order")).alias("orders")))
    # the customers go to the grouped orders: a row for each of their documents
    owners = (cust.join(counts.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
              .withColumn("_at", F.explode(F.sequence(F.lit(-1), F.col("n_docs") - 1))).drop("n_docs"))
    doc = grouped.withColumnRenamed("o_custkey", "c_custkey").join(owners, ["c_custkey", "_at"])
    ck = F.col("c_custkey").cast("string")
    session = F.struct(F.struct(
        F.struct(F.concat(F.lit("C"), ck).alias("_id"), F.col("c_name").alias("Name"), F.concat(F.lit("n"), ck).alias("LowerName"),
                 F.concat(F.lit("v"), ck, F.lit("~w")).alias("Memo"), F.lit("x~y~z").alias("Remark")).alias("Account"),
        F.struct(F.transform("orders", lambda o: o.dropFields("k", "p")).alias("Order")).alias("Orders")).alias("Data"))
    body = F.to_xml(session, {"rowTag": "Session", "indent": ""})
    for pattern, to in (("(</?)LowerName>", "$1name>"), ("<Memo>([^~<]*)~([^<]*)</Memo>", "<Memo>$1<!-- > amid -->$2</Memo>"),
                        ("<Remark>([^~<]*)~([^~<]*)~([^<]*)</Remark>", "<Remark>$1<b>$2</b>$3</Remark>")):
        body = F.regexp_replace(body, pattern, to)
    doc = doc.select("c_custkey", "account_part", body.alias("_raw"))
    return doc.select("c_custkey", "account_part", _damaged(F.col("_raw"), F.col("c_custkey")).alias("raw_xml"))


def bronze_documents(spark: SparkSession, sf_dir: str, split: DataFrame | None = None) -> DataFrame:
    """Order documents landed as Bronze rows."""
    docs = order_documents(spark, sf_dir, split)
    return land_documents(docs, uploaded_by="testbed", product_code=None,
                          keep=["o_orderkey", "part"])


# --------------------------------------------------------------------------
# Mapping ledger derived from lineitem (one mapping per line item)
# --------------------------------------------------------------------------

# Fixed vocabularies of the synthetic ledger.
LEDGER_TABLES = ["POLICY", "CUSTOMER", "COVERAGE", "RISK", "PAYMENT"]
LEDGER_PATHS = [
    "/Session/TransactionInfo/TransactionID", "/Session/Data/Policy/PolicyNumber",
    "/Session/Data/Policy/EffectiveDate", "/Session/Data/Policy/TotalPremium",
    "/Session/Data/Account/AccountNumber", "/Session/Data/Account/Balance",
    "/Session/Data/Coverages/Coverage/LimitAmount", "/Session/Data/Coverages/Coverage/ShipDate",
    "/Session/Data/Vehicle/VIN", "/Session/Data/Dwelling/BuildingYear",
    "/Session/Data/Payment/Amount", "Data/Quote/QuoteNumber", "/Session/Data/Risks/Risk/RiskNumber",
]
LEDGER_COLUMNS = [
    "POLICY_NUMBER", "EFFECTIVE_DATE", "TOTAL_PREMIUM", "POLICY_ID", "ACCOUNT_HOLDER_NAME",
    "RISK_COUNTRY", "UPDATED_BY", "PAYMENT_TERM", "IS_ACTIVE", "HAS_LIEN", "RENEWAL_FLAG",
    "CREATED_DATE", "DISCOUNT_AMOUNT", "RISK_NUMBER", "ID", "COVERAGE_LIMIT", "TAX_AMOUNT",
    "INSTALLMENTS", "STATUS", "DESCRIPTION", "QUOTE_NUMBER", "CUSTOMER_ID", "RATE_FACTOR",
]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def mapping_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping ledger with one row per line item (7.3 of the survey).

    ``LEDGER_ORDER`` (doc_key, line_no, part_key, supp_key, then the other
    line fields) is the total input order every first-wins operator sorts by.
    """
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.format_string("MAP-%d-%d-%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("mapping_id"),
        F.format_string("XML-%d", "l_orderkey").alias("xml_id"),
        F.col("l_orderkey").alias("doc_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_quantity").alias("ord_qty"), F.col("l_extendedprice").alias("ord_price"),
        F.col("l_discount").alias("ord_disc"), F.col("l_tax").alias("ord_tax"),
        F.col("l_returnflag").alias("ord_flag"), F.col("l_linestatus").alias("ord_status"),
        F.col("l_shipdate").alias("ord_ship"),
        F.when(F.col("l_suppkey") % 17 == 0, F.lit(None).cast("string"))
         .otherwise(_pick(LEDGER_PATHS, F.col("l_suppkey"))).alias("source_node"),
        _pick(LEDGER_TABLES, F.col("l_linenumber")).alias("target_table"),
        _pick(LEDGER_COLUMNS, F.col("l_partkey")).alias("target_column"),
        F.when(F.col("l_tax") > 0.06, F.lit("TO_DATE(value)"))
         .when(F.col("l_tax") > 0.05, F.lit("CAST(value AS INTEGER)"))
         .when(F.col("l_tax") > 0.04, F.lit("None"))
         .when(F.col("l_tax") > 0.03, F.lit(""))
         .otherwise(F.lit(None).cast("string")).alias("transformation_logic"),
        (F.col("l_discount") * 10).cast("decimal(3,2)").alias("confidence_score"),
        F.concat(F.lit("from line "), F.col("l_linenumber").cast("string")).alias("reasoning"),
        F.when(F.col("l_returnflag") == "A", "Approved").when(F.col("l_returnflag") == "R", "Rejected")
         .otherwise("Pending").alias("approval_status"),
        F.when(F.col("l_linestatus") == "F", "Failed")
         .when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"), "Completed")
         .otherwise("Not Started").alias("execution_status"),
        F.col("l_shipdate").cast("date").alias("created_date"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


LEDGER_ORDER = ["doc_key", "line_no", "part_key", "supp_key", "ord_qty", "ord_price", "ord_disc", "ord_tax",
                "ord_flag", "ord_status", "ord_ship"]
