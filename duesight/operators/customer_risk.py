"""Customer risk and the counts over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesight.functions.cleaning import finite
from duesight.functions.risk import risk_level
from duesight.settings import THRESHOLD_HIGH, THRESHOLD_LOW

CUSTOMER_KEY = ["PARTY_ID", "ACCOUNT_NUMBER", "CUSTOMER_NAME"]


def weighted_score(p: Column, amount: Column) -> Column:
    """Mean weighted by absolute amount; the plain mean where all amounts are zero."""
    weight = F.abs(F.coalesce(amount, F.lit(0.0)))
    value = F.coalesce(p, F.lit(0.0))
    return F.when(F.sum(weight) > 0, F.sum(value * weight) / F.sum(weight)).otherwise(F.avg(value))


def gap_share(columns: list[str]) -> Column:
    if "count_gaps_gt_90_pre_due" in columns:
        flagged = F.coalesce("count_gaps_gt_90_pre_due", F.lit(0)) > 0
    elif "max_gap_pre_due" in columns:
        flagged = F.coalesce("max_gap_pre_due", F.lit(0)) > 90
    else:
        return F.lit(None).cast("double")
    return F.avg(flagged.cast("double")) * 100


def first_known(name: str) -> Column:
    """The value of the lowest invoice id that has one."""
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("CUSTOMER_TRX_ID")))


def customer_risk(
    scored: DataFrame, one_row_per_invoice: bool = False, low: float = THRESHOLD_LOW, high: float = THRESHOLD_HIGH
) -> DataFrame:
    """One row per (party, account, name); missing keys form groups of their own.

    With `one_row_per_invoice` the invoices are counted instead of counted
    distinct, which spares a shuffle of every row.
    """
    ids = F.count("CUSTOMER_TRX_ID") if one_row_per_invoice else F.countDistinct("CUSTOMER_TRX_ID")
    p = F.col("prob_bad_debt")
    paid = F.coalesce(F.sum("amt_paid_pre_due"), F.lit(0.0))
    billed = F.sum(F.abs(F.coalesce("TRX_AMOUNT", F.lit(0.0))))
    out = scored.groupBy(*CUSTOMER_KEY).agg(
        F.max(p).alias("cust_score_max"),
        F.avg(p).alias("cust_score_mean"),
        weighted_score(p, F.col("TRX_AMOUNT")).alias("cust_score_wavg_amount"),
        ids.alias("invoice_cnt"),
        F.coalesce(F.sum("TRX_AMOUNT"), F.lit(0.0)).alias("total_amount"),
        paid.alias("total_amt_paid_pre_due"),
        F.when(billed > 0, paid / billed * 100).alias("paid_ratio_pre_due_total"),
        F.avg("paid_ratio_pre_due").alias("paid_ratio_pre_due_mean"),
        gap_share(scored.columns).alias("pct_invoices_gap_gt_90_pre_due"),
        first_known("party_prior_invoice_cnt").cast("bigint").alias("party_prior_invoice_cnt"),
        first_known("party_prior_gap90_cnt").cast("bigint").alias("party_prior_gap90_cnt"),
        # Read by the report but produced by no step: always missing.
        F.lit(None).cast("double").alias("party_prior_gap90_rate"),
    )
    return out.withColumn("risk_cust", risk_level(F.col("cust_score_max"), low, high))


def level_counts(rows: DataFrame, level: str) -> DataFrame:
    return rows.where(F.col(level).isNotNull()).groupBy(level).agg(F.count("*").alias("cnt"))


def warning_counts(scores: DataFrame, low: float = THRESHOLD_LOW, high: float = THRESHOLD_HIGH) -> DataFrame:
    """Rows, alerts and high-risk rows in one pass."""
    p = finite(F.col("prob_bad_debt"))
    return scores.agg(
        F.count("*").alias("processed_invoices"),
        F.count_if(p >= low).alias("alerts_count"),
        F.count_if(p >= high).alias("high_risk_count"),
    )
