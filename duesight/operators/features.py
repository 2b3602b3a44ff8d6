"""Row-level features derived from the payment facts of an invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesight.functions.cleaning import clip, days_between, flag, plus_days, ratio
from duesight.operators.receipts import payment_facts


def paid_percent(paid: Column, amount: Column) -> Column:
    """Percent of the absolute amount, within 0 and 100; 0 for a zero amount."""
    return clip(ratio(paid * 100, F.abs(amount), 0.0), 0, 100)


def paid_fraction_signed(paid: Column, amount: Column) -> Column:
    """Fraction of the signed amount, without bounds; 0 where undefined."""
    return ratio(paid, amount, 0.0)


def paid_fraction(paid: Column, amount: Column) -> Column:
    """Fraction within 0 and 1; 0 for amounts that are not positive."""
    value = clip(ratio(F.coalesce(paid, F.lit(0.0)), amount, 0.0), 0, 1)
    return F.when(amount > 0, value).otherwise(0.0)


def due_calendar() -> list[Column]:
    return [
        days_between(F.col("DUE_DATE"), F.col("TRX_DATE")).alias("days_to_due"),
        F.month("TRX_DATE").alias("trx_month"),
        F.weekday("TRX_DATE").alias("trx_weekday"),
    ]


def pre_due_columns() -> list[Column]:
    """Monday is weekday 0. Needs the facts with prefix pre_due."""
    return [
        paid_percent(F.col("amt_paid_pre_due"), F.col("TRX_AMOUNT")).alias("paid_ratio_pre_due"),
        days_between(F.col("first_pay_pre_due"), F.col("TRX_DATE")).alias("days_trx_to_first_pay_pre_due"),
        days_between(F.col("DUE_DATE"), F.col("last_pay_pre_due")).alias("days_before_due_last_pay"),
        *due_calendar(),
    ]


def asof_columns(as_of_col: str, prefix: str) -> list[Column]:
    first, last = F.col(f"first_pay_{prefix}"), F.col(f"last_pay_{prefix}")
    to_first = days_between(first, F.col("TRX_DATE"))
    reached = F.col(as_of_col) >= plus_days(F.col("TRX_DATE"), 90)
    return [
        paid_fraction_signed(F.col(f"amt_paid_{prefix}"), F.col("TRX_AMOUNT")).alias(f"paid_ratio_{prefix}"),
        to_first.alias(f"days_trx_to_first_pay_{prefix}"),
        days_between(F.col(as_of_col), F.coalesce(last, "TRX_DATE")).alias(f"days_since_last_pay_{prefix}"),
        flag(reached & first.isNull()).alias(f"no_payment_by_90_{prefix}"),
        flag(to_first > 90).alias(f"first_pay_gt_90_{prefix}"),
        *due_calendar(),
    ]


def window_columns(prefix: str) -> list[str]:
    return [f"{stem}_{prefix}" for stem in ("n_pay", "amt_paid", "first_pay", "last_pay", "max_gap", "count_gaps_gt_90")]


def pre_due_features(invoices: DataFrame, payments: DataFrame, snapshot) -> DataFrame:
    """One row per invoice with its payments up to AS_OF_DATE."""
    facts = payment_facts(invoices, payments, snapshot, "AS_OF_DATE", "pre_due")
    return facts.select(*invoices.columns, *window_columns("pre_due"), *pre_due_columns())


def asof_features(invoices: DataFrame, payments: DataFrame, snapshot, as_of_col: str, prefix: str) -> DataFrame:
    """The same up to a chosen date column, with the as-of ratio and 90-day flags."""
    facts = payment_facts(invoices, payments, snapshot, as_of_col, prefix)
    return facts.select(*invoices.columns, *window_columns(prefix), *asof_columns(as_of_col, prefix))
