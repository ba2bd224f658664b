"""Table schemas: bronze/stage/control tables, node rows, mappings, Silver.

Silver tables here are the targets the order documents are mapped into
(see ``docmap.sources.testbed``).  Control-table layouts follow the data
model of the mapping workflow: raw documents, a JSON stage, a file
registry, the mapping ledger, execution and reconciliation logs.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
TS, TSN, DT = T.TimestampType(), T.TimestampNTZType(), T.DateType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


BRONZE = _st(("xml_id", S), ("file_name", S), ("file_path", S), ("raw_xml", S),
             ("uploaded_at", TS), ("product_code", S), ("uploaded_by", S))

FILE_REGISTRY = _st(("xml_id", S), ("file_name", S), ("file_path", S),
                    ("product_code", S), ("uploaded_by", S), ("upload_date", TS))

JSON_STAGE = _st(("staging_id", S), ("xml_id", S), ("xml_data", T.VariantType()),
                 ("target_table", S), ("processed", B), ("processed_at", TS), ("created_at", TS))

NODE = _st(("ordinal", I), ("node_path", S), ("node_name", S),
           ("attributes", T.ArrayType(S)), ("text", S), ("depth", I))

MAPPING = _st(("source_node", S), ("target_table", S), ("target_column", S),
              ("transformation_logic", S), ("confidence_score", D), ("reasoning", S))

LEDGER = _st(("mapping_id", S), ("xml_id", S), ("source_node", S), ("target_table", S),
             ("target_column", S), ("transformation_logic", S), ("confidence_score", D),
             ("reasoning", S), ("approval_status", S), ("approved_by", S),
             ("approved_date", TS), ("user_notes", S), ("execution_status", S),
             ("last_execution_id", S), ("last_execution_at", TS), ("execution_error", S))

HISTORICAL_MAPPING = _st(("source_system", S), ("source_node", S), ("source_attribute", S),
                         ("target_table", S), ("target_column", S), ("transformation", S),
                         ("notes", S), ("product_code", S))

DATA_DICTIONARY = _st(("table_name", S), ("column_name", S), ("data_type", S),
                      ("description", S), ("business_rules", S), ("sample_values", S))

VIEW_DEFINITION = _st(("view_id", S), ("xml_id", S), ("target_table", S), ("view_name", S),
                      ("view_query", S), ("created_at", TS), ("created_by", S), ("is_active", B))

EXECUTION_LOG = _st(("execution_id", S), ("xml_id", S), ("tables_succeeded", S),
                    ("tables_failed", S), ("rows_loaded", L), ("status", S),
                    ("error", S), ("executed_at", TS), ("executed_by", S))

RECONCILIATION = _st(("reconciliation_id", S), ("source_count", L), ("target_count", L),
                     ("match_count", L), ("mismatch_count", L), ("missing_in_target", L),
                     ("extra_in_target", L), ("status", S), ("details", S))

CONTROL_TABLES = {
    "bronze_documents": BRONZE, "file_registry": FILE_REGISTRY, "mapping_ledger": LEDGER, "view_definitions": VIEW_DEFINITION,
    "execution_log": EXECUTION_LOG, "reconciliation_log": RECONCILIATION,
}

# Silver targets of the order documents: (column, declared SQL type).
SILVER = {
    "POLICY": [
        ("transaction_ref", "STRING"), ("policy_number", "STRING"),
        ("effective_date", "DATE"), ("total_premium", "DECIMAL(15,2)"),
        ("policy_status", "STRING"), ("priority", "STRING"),
        ("is_priority", "BOOLEAN"), ("created_timestamp", "TIMESTAMP_NTZ"),
        ("document_part", "INT"),
    ],
    "CUSTOMER": [
        ("account_number", "BIGINT"), ("account_ref", "STRING"), ("account_name", "STRING"),
        ("market_segment", "STRING"), ("account_balance", "DECIMAL(15,2)"),
        ("nation_code", "INT"),
    ],
    "COVERAGE": [
        ("policy_number", "STRING"), ("coverage_ref", "STRING"), ("coverage_code", "BIGINT"),
        ("supplier_code", "BIGINT"), ("line_number", "INT"), ("quantity", "DECIMAL(15,2)"),
        ("limit_amount", "DECIMAL(15,2)"), ("discount_rate", "DECIMAL(15,2)"),
        ("tax_rate", "DECIMAL(15,2)"), ("return_flag", "STRING"), ("line_status", "STRING"),
        ("ship_date", "DATE"),
    ],
    "RISK": [
        ("policy_number", "STRING"), ("vehicle_vin", "STRING"), ("building_year", "INT"),
        ("construction_type", "STRING"), ("business_name", "STRING"),
        ("employee_count", "INT"), ("payroll_amount", "DECIMAL(15,2)"),
    ],
}


def silver_ddl(table: str) -> str:
    """DDL column list of a Silver table (usable in ``CREATE TABLE`` / schemas)."""
    return ", ".join(f"{c} {t}" for c, t in SILVER[table])


def silver_types(table: str) -> dict[str, str]:
    return dict(SILVER[table])
