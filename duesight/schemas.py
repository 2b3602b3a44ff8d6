"""Explicit table schemas. Bronze is text as delivered, silver is typed."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
}


def _struct(spec: str) -> T.StructType:
    pairs = [item.split() for item in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BRONZE_INVOICE = _struct(
    "CUSTOMER_TRX_ID string, TRX_NUMBER string, PARTY_ID string, TRX_DATE string, "
    "DUE_DATE string, TRX_AMOUNT string, TRANS_TYPE string, CURRENCY_CODE string, "
    "ORG_ID string, PREVIOUS_CUSTOMER_TRX_ID string"
)
BRONZE_RECEIPT = _struct(
    "APPLIED_CUSTOMER_TRX_ID string, APPLY_DATE string, RECEIPT_DATE string, "
    "AMOUNT_APPLIED string, RECEIPT_STATUS string"
)
BRONZE_CUSTOMER = _struct(
    "PARTY_ID string, ACCOUNT_NUMBER string, TRX_NUMBER string, "
    "CUSTOMER_NAME string, BU_NAME string"
)

INVOICE = _struct(
    "CUSTOMER_TRX_ID bigint, TRX_NUMBER string, PARTY_ID bigint, TRX_DATE timestamp, "
    "DUE_DATE timestamp, TRX_AMOUNT double, TRANS_TYPE string, CURRENCY_CODE string, "
    "ORG_ID bigint, PREVIOUS_CUSTOMER_TRX_ID bigint"
)
RECEIPT = _struct(
    "APPLIED_CUSTOMER_TRX_ID bigint, APPLY_DATE timestamp, RECEIPT_DATE timestamp, "
    "AMOUNT_APPLIED double, RECEIPT_STATUS string"
)
CUSTOMER = _struct(
    "PARTY_ID bigint, ACCOUNT_NUMBER string, TRX_NUMBER string, "
    "CUSTOMER_NAME string, BU_NAME string"
)

# Published invoice scores; the last columns say which run they belong to.
SCORES = _struct(
    "ACCOUNT_NUMBER string, CUSTOMER_NAME string, SBU string, CUSTOMER_TRX_ID bigint, "
    "TRX_DATE date, DUE_DATE date, days_to_due bigint, TRX_AMOUNT_GROSS double, "
    "credit_memo_reduction double, TRX_AMOUNT double, expected_financial_loss double, "
    "prob_bad_debt double, risk_level string, recommended_action string, "
    "job_id string, published_at timestamp, start_date date, end_date date, "
    "model_key string, snapshot_date date, time_range string, date_window string"
)

# Published customer risk.
CUSTOMER_RISK = _struct(
    "PARTY_ID bigint, ACCOUNT_NUMBER string, CUSTOMER_NAME string, "
    "cust_score_max double, cust_score_mean double, cust_score_wavg_amount double, "
    "invoice_cnt bigint, total_amount double, total_amt_paid_pre_due double, "
    "paid_ratio_pre_due_total double, paid_ratio_pre_due_mean double, "
    "pct_invoices_gap_gt_90_pre_due double, party_prior_invoice_cnt bigint, "
    "party_prior_gap90_cnt bigint, party_prior_gap90_rate double, risk_cust string, "
    "job_id string, published_at timestamp, start_date date, end_date date, "
    "model_key string, snapshot_date date, time_range string, date_window string"
)

# Both published tables are partitioned by what identifies a result; the window
# is "start_end" for a custom range and "-" otherwise.
PARTITION = ["model_key", "snapshot_date", "time_range", "date_window"]

# The index of publications: one row for each publication of a run, with its number of score rows, and whether it
# replaced what its partition held.
PUBLICATIONS = _struct(
    "job_id string, model_key string, snapshot_date date, time_range string, date_window string, "
    "start_date date, end_date date, published_at timestamp, total_invoices bigint, replaces boolean"
)

RUNS = _struct(
    "job_id string, status string, model_key string, snapshot_date date, time_range string, "
    "start_date date, end_date date, total_invoices bigint, total_customers bigint, "
    "risk_summary_json string, customer_risk_summary_json string, error_message string, "
    "started_at timestamp, completed_at timestamp, duration_sec double"
)
