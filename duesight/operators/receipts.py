"""Receipts: cleaning, status, payment date, and the facts per invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesight.functions.cleaning import (
    days_between,
    holds,
    midnight,
    plus_days,
    repair_dates,
    require,
    to_id,
    to_number,
    to_timestamp,
    with_missing_columns,
)
from duesight.operators.skew import exact_sum
from duesight.schemas import RECEIPT


# Columns without which there is nothing to work on.
REQUIRED = ("APPLIED_CUSTOMER_TRX_ID", "AMOUNT_APPLIED")


def status_counts(status: Column) -> Column:
    """Applied receipts, and those without a status."""
    return status.isNull() | (status == "APP")


def base_payments(receipt: DataFrame, snapshot, repair_years: bool = True) -> DataFrame:
    """(INVOICE_ID, PAYMENT_DATE, AMOUNT_APPLIED) of the receipts that count.

    The apply date wins over the receipt date. Rows without any date stay.
    """
    df = with_missing_columns(require(receipt, REQUIRED, "receipt"), RECEIPT).where(status_counts(F.col("RECEIPT_STATUS")))
    names = ["APPLY_DATE", "RECEIPT_DATE"]
    rows = df.select(
        to_id(df, "APPLIED_CUSTOMER_TRX_ID").alias("INVOICE_ID"),
        *[to_timestamp(df, c).alias(c) for c in names],
        F.coalesce(to_number(df, "AMOUNT_APPLIED"), F.lit(0.0)).alias("AMOUNT_APPLIED"),
    ).where(F.col("INVOICE_ID").isNotNull())
    if repair_years:
        rows = repair_dates(rows, names, snapshot)
    return rows.select("INVOICE_ID", F.coalesce(*names).alias("PAYMENT_DATE"), "AMOUNT_APPLIED")


def invoices_with_receipt(receipt: DataFrame) -> DataFrame:
    """Ids that have any receipt row, whatever its status."""
    key = next(
        (c for c in ("APPLIED_CUSTOMER_TRX_ID", "CUSTOMER_TRX_ID", "INVOICE_ID") if c in receipt.columns)
    )
    ids = receipt.select(to_id(receipt, key).alias("_receipt_id"))
    return ids.where(F.col("_receipt_id").isNotNull()).distinct()


def payment_days(payments: DataFrame) -> DataFrame:
    """One row per invoice and payment date, with the date before it.

    Summing per date first keeps the window small however many receipts an
    invoice has: its rows are bounded by the calendar.
    """
    days = payments.groupBy("INVOICE_ID", "PAYMENT_DATE").agg(
        F.count("*").alias("day_receipts"), exact_sum(F.col("AMOUNT_APPLIED")).alias("day_amount")
    )
    order = W.partitionBy("INVOICE_ID").orderBy("PAYMENT_DATE")
    lagged = days.withColumn("previous_date", F.lag("PAYMENT_DATE").over(order))
    # Undated rows sort first and are dropped only here: a filter before the
    # aggregation would be moved into the date repair and work it out again.
    dated = lagged.where(F.col("PAYMENT_DATE").isNotNull())
    return dated.withColumn("gap_days", days_between(F.col("PAYMENT_DATE"), F.col("previous_date")))


def gap_variance(receipts: Column, gap_sum: Column, gap_squares: Column) -> Column:
    """Sample variance of the gaps between all receipts in date order.

    Receipts on one day are zero gaps: they add to the number of gaps only.
    """
    gaps = receipts - 1
    gap_sum, gap_squares = F.coalesce(gap_sum, F.lit(0)), F.coalesce(gap_squares, F.lit(0))
    spread = gaps * gap_squares - gap_sum * gap_sum
    return F.when(gaps >= 2, spread / (gaps * (gaps - 1)))


def _receipt_totals() -> list[Column]:
    n = F.sum("day_receipts")
    gap = F.col("gap_days")
    return [
        n.alias("receipt_count"),
        F.min("PAYMENT_DATE").alias("first_pay_date"),
        F.max("PAYMENT_DATE").alias("last_pay_date"),
        exact_sum(F.col("day_amount")).alias("total_paid"),
        gap_variance(n, F.sum(gap), F.sum(gap * gap)).alias("gap_variance"),
    ]


def receipt_totals(payments: DataFrame) -> DataFrame:
    """Count, first, last, sum and gap variance per invoice, over all its payments."""
    out = payment_days(payments).groupBy("INVOICE_ID").agg(*_receipt_totals())
    return out.withColumnRenamed("INVOICE_ID", "CUSTOMER_TRX_ID").withColumn(
        "is_partial", (F.col("receipt_count") > 1).cast("int")
    )


def payment_facts(invoices: DataFrame, payments: DataFrame, snapshot, as_of_col: str, prefix: str) -> DataFrame:
    """Every invoice with all payment facts that the feature builders need.

    One join and one aggregation on the invoice id, which share a partitioning.
    What a caller does not select is pruned.

    * `*_{prefix}`: payments within [TRX_DATE, as_of_col]
    * receipt_count .. gap_variance: all payments
    * paid_by_bd90: paid up to 90 days past due, as known at the snapshot
    * first_pay_known, first_gap90_known: as known at the snapshot
    """
    snap = midnight(snapshot)
    paid_on, before = F.col("PAYMENT_DATE"), F.col("previous_date")
    inside = holds((paid_on >= F.col("TRX_DATE")) & (paid_on <= F.col(as_of_col)))
    inside_gap = F.when(inside & (before >= F.col("TRX_DATE")), F.col("gap_days"))
    known = paid_on <= snap

    def n_where(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("day_receipts"))), F.lit(0))

    def sum_where(cond):
        return F.coalesce(exact_sum(F.when(cond, F.col("day_amount"))), F.lit(0.0))

    return (
        invoices.join(payment_days(payments), F.col("CUSTOMER_TRX_ID") == F.col("INVOICE_ID"), "left")
        .groupBy(*invoices.columns)
        .agg(
            n_where(inside).alias(f"n_pay_{prefix}"),
            sum_where(inside).alias(f"amt_paid_{prefix}"),
            F.min(F.when(inside, paid_on)).alias(f"first_pay_{prefix}"),
            F.max(F.when(inside, paid_on)).alias(f"last_pay_{prefix}"),
            F.coalesce(F.max(inside_gap), F.lit(0)).alias(f"max_gap_{prefix}"),
            F.count_if(inside_gap > 90).alias(f"count_gaps_gt_90_{prefix}"),
            *_receipt_totals(),
            sum_where(known & (paid_on <= plus_days(F.col("DUE_DATE"), 90))).alias("paid_by_bd90"),
            F.min(F.when(known, paid_on)).alias("first_pay_known"),
            F.min(F.when(known & (F.col("gap_days") > 90), paid_on)).alias("first_gap90_known"),
        )
    )


PAYMENT_FACTS = [
    "receipt_count",
    "first_pay_date",
    "last_pay_date",
    "total_paid",
    "gap_variance",
    "paid_by_bd90",
    "first_pay_known",
    "first_gap90_known",
]
