"""Approved mappings of the order documents into the Silver tables.

This is configuration (one row per target column), the analogue of the
reviewed mapping ledger after approval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmap.schemas import SILVER

_P = "/Session/Data/Policy/"
_A = "/Session/Data/Account/"
_C = "/Session/Data/Coverages/Coverage/"
_T = "/Session/TransactionInfo/"

# (target_table, target_column, source_node, transformation_logic)
DOC_MAPPINGS = [
    ("POLICY", "transaction_ref", _T + "TransactionID", None),
    ("POLICY", "policy_number", _P + "PolicyNumber", None),
    ("POLICY", "effective_date", _P + "EffectiveDate", None),
    ("POLICY", "total_premium", _P + "TotalPremium", None),
    ("POLICY", "policy_status", _P + "PolicyStatus", None),
    ("POLICY", "priority", _P + "Priority", None),
    ("POLICY", "is_priority", _P + "IsPriority", None),
    ("POLICY", "created_timestamp", _T + "TransactionDate", "TO_TIMESTAMP_NTZ(value)"),
    ("POLICY", "document_part", _T + "DocumentPart", None),
    ("CUSTOMER", "account_number", _A + "AccountNumber", None),
    ("CUSTOMER", "account_ref", _A + "@id", None),
    ("CUSTOMER", "account_name", _A + "AccountName", None),
    ("CUSTOMER", "market_segment", _A + "Segment", None),
    ("CUSTOMER", "account_balance", _A + "Balance", None),
    ("CUSTOMER", "nation_code", _A + "NationCode", None),
    ("COVERAGE", "policy_number", _P + "PolicyNumber", None),
    ("COVERAGE", "coverage_ref", _C + "@id", None),
    ("COVERAGE", "coverage_code", _C + "CoverageCode", None),
    ("COVERAGE", "supplier_code", _C + "SupplierCode", None),
    ("COVERAGE", "line_number", _C + "LineNumber", None),
    ("COVERAGE", "quantity", _C + "Quantity", None),
    ("COVERAGE", "limit_amount", _C + "LimitAmount", None),
    ("COVERAGE", "discount_rate", _C + "DiscountRate", None),
    ("COVERAGE", "tax_rate", _C + "TaxRate", None),
    ("COVERAGE", "return_flag", _C + "ReturnFlag", None),
    ("COVERAGE", "line_status", _C + "LineStatus", None),
    ("COVERAGE", "ship_date", _C + "ShipDate", "TO_DATE(value)"),
    ("RISK", "policy_number", _P + "PolicyNumber", None),
    ("RISK", "vehicle_vin", "/Session/Data/Vehicle/VIN", None),
    ("RISK", "building_year", "/Session/Data/Dwelling/BuildingYear", None),
    ("RISK", "construction_type", "/Session/Data/Dwelling/ConstructionType", None),
    ("RISK", "business_name", "/Session/Data/CommercialBuilding/BusinessName", None),
    ("RISK", "employee_count", "/Session/Data/Payroll/EmployeeCount", None),
    ("RISK", "payroll_amount", "/Session/Data/Payroll/PayrollAmount", None),
]

COVERAGE_RECORD = "/Session/Data/Coverages/Coverage"


def approved_mappings(spark: SparkSession) -> DataFrame:
    """Approved mappings with declared target types and an input ordinal."""
    rows = []
    for i, (t, c, src, logic) in enumerate(DOC_MAPPINGS):
        rows.append((i, src, t, c, logic, dict(SILVER[t])[c], 0.95, "Approved"))
    return spark.createDataFrame(
        rows, "ord int, source_node string, target_table string, target_column string, "
              "transformation_logic string, target_type string, confidence_score double, approval_status string")
