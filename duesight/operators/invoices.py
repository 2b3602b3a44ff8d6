"""Invoices: cleaning, dropping, credit-memo netting, one row per id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesight.functions.cleaning import (
    keep_first,
    midnight,
    require,
    to_id,
    to_number,
    to_timestamp,
    with_missing_columns,
)
from duesight.operators.receipts import invoices_with_receipt
from duesight.operators.skew import exact_sum
from duesight.schemas import INVOICE

# Columns without which there is nothing to work on.
REQUIRED = ("CUSTOMER_TRX_ID", "TRX_DATE", "DUE_DATE", "TRX_AMOUNT")
CARRIED = ["TRX_NUMBER", "PARTY_ID", "TRX_DATE", "DUE_DATE", "TRX_AMOUNT", "TRANS_TYPE", "CURRENCY_CODE", "ORG_ID"]
# Which row of several with one id is kept: the earliest, then by every kept column.
KEEP_ORDER = ["TRX_DATE", *[c for c in CARRIED if c != "TRX_DATE"]]


def clean_invoices(invoice: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Typed columns in a fixed order, then those of `more`; columns the input lacks are typed NULLs, required ones an error."""
    df = with_missing_columns(require(invoice, REQUIRED, "invoice"), INVOICE)
    kinds = {"bigint": to_id, "double": to_number, "timestamp": to_timestamp}

    def typed(name: str, kind: str) -> Column:
        return kinds[kind](df, name) if kind in kinds else F.col(name).cast(kind)

    return df.select(*[typed(f.name, f.dataType.simpleString()).alias(f.name) for f in INVOICE], *more)


def drop_unpaid_nonpositive(invoice: DataFrame, receipt: DataFrame) -> DataFrame:
    """Drop amounts <= 0 of ids without any receipt row; a missing amount stays."""
    nonpositive = F.col("TRX_AMOUNT") <= 0
    paid = invoice.where(nonpositive).join(
        invoices_with_receipt(receipt), F.col("CUSTOMER_TRX_ID") == F.col("_receipt_id"), "left_semi"
    )
    return invoice.where(~nonpositive | F.col("TRX_AMOUNT").isNull()).unionByName(paid)


def credit_memo_totals(invoice: DataFrame, snapshot) -> DataFrame:
    """Sum, number and first date per original invoice of the memos up to the snapshot.

    An invoice whose memos are all later has a row with count 0.
    """
    in_time = F.col("TRX_DATE") <= midnight(snapshot)
    return (
        invoice.where(F.col("PREVIOUS_CUSTOMER_TRX_ID").isNotNull())
        .groupBy(F.col("PREVIOUS_CUSTOMER_TRX_ID").alias("_original_id"))
        .agg(
            F.coalesce(exact_sum(F.when(in_time, F.coalesce("TRX_AMOUNT", F.lit(0.0)))), F.lit(0.0)).alias("cm_amount"),
            F.count_if(in_time).alias("cm_count"),
            F.min(F.when(in_time, F.col("TRX_DATE"))).alias("cm_first_date"),
        )
    )


def net_credit_memos(invoice: DataFrame, memo_source: DataFrame, snapshot, has_memos: bool | None = None) -> DataFrame:
    """Reduce amounts by their credit memos.

    Only a negative memo total reduces. When `memo_source` has memos at all,
    every amount is cut at zero, otherwise amounts are left as they are; `has_memos`
    says so where the source is part of a larger table.
    """
    totals = credit_memo_totals(memo_source, snapshot)
    if has_memos is None:
        memos = memo_source.agg(F.coalesce(F.max(F.col("PREVIOUS_CUSTOMER_TRX_ID").isNotNull()), F.lit(False))).scalar()
    else:
        memos = F.lit(has_memos)
    gross = F.coalesce("TRX_AMOUNT", F.lit(0.0))
    effect = F.least(F.coalesce("cm_amount", F.lit(0.0)), F.lit(0.0))
    net = F.greatest(gross + effect, F.lit(0.0))
    kept = [c for c in invoice.columns if c != "TRX_AMOUNT"]
    return invoice.join(totals, F.col("CUSTOMER_TRX_ID") == F.col("_original_id"), "left").select(
        *kept,
        F.when(memos, net).otherwise(gross).alias("TRX_AMOUNT"),
        gross.alias("TRX_AMOUNT_GROSS"),
        (F.lit(0.0) - effect).alias("credit_memo_reduction"),
        F.coalesce("cm_count", F.lit(0)).alias("cm_count"),
        "cm_first_date",
    )


def one_per_id(invoice: DataFrame) -> DataFrame:
    """One row per CUSTOMER_TRX_ID; copies collapse before the shuffle."""
    rows = invoice.where(F.col("CUSTOMER_TRX_ID").isNotNull()).select("CUSTOMER_TRX_ID", *CARRIED)
    return keep_first(rows, ["CUSTOMER_TRX_ID"], KEEP_ORDER)
