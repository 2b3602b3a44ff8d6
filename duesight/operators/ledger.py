"""The cleaned, netted, unique invoices with their payments, in one exchange of the invoices.

The stepwise operators (`drop_unpaid_nonpositive`, `one_per_id`, `net_credit_memos`, `payment_facts`) each say what one
step does. Composed, they would read the invoices three times and group wide rows once more. Here

* receipts are summed per id and day, then listed per id (`receipt_days`): the drop test, the memos' own drop test and
  all payment facts read that one table, a row per id whose list is bounded by the calendar;
* invoices are cut to one row per id by an aggregate that runs before the exchange, too. The first of the positive rows
  and the first of the others are kept apart, as only the receipts tell whether the others count;
* memos are summed per memo and original before they meet the receipts, then per original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesight.functions.cleaning import (
    as_of,
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
from duesight.operators.invoices import CARRIED, KEEP_ORDER, clean_invoices
from duesight.operators.quality import Quality
from duesight.operators.receipts import REQUIRED, gap_variance, status_counts
from duesight.operators.skew import exact_sum
from duesight.schemas import RECEIPT

#: Carried through where the input has it: whether a run reports the row.
TARGET = "_is_target"


def receipt_lists(receipt: DataFrame, snapshot, repair_years: bool = True, quality: Quality | None = None) -> DataFrame:
    """_receipt_id, _days: a row for each id with any receipt row, whatever its status; _days as in `receipt_days`, but
    in no order and without the gaps."""
    df = with_missing_columns(require(receipt, REQUIRED, "receipt"), RECEIPT)
    names = ["APPLY_DATE", "RECEIPT_DATE"]
    rows = df.select(
        to_id(df, "APPLIED_CUSTOMER_TRX_ID").alias("_receipt_id"),
        *[to_timestamp(df, c).alias(c) for c in names],
        F.when(status_counts(F.col("RECEIPT_STATUS")), F.coalesce(to_number(df, "AMOUNT_APPLIED"), F.lit(0.0))).alias("amount"),
    ).where(F.col("_receipt_id").isNotNull())
    if quality is not None:
        rows = rows.withColumn("_was", F.col(names[0]))
    if repair_years:
        rows = repair_dates(rows, names, snapshot)
    if quality is not None:
        rows = quality.watch_repairs(rows, "_was", names[0])
    daily = rows.groupBy("_receipt_id", F.coalesce(*names).alias("day")).agg(
        F.count("amount").alias("n"), exact_sum(F.col("amount")).alias("amount"))
    counts = F.col("day").isNotNull() & (F.col("n") > 0)
    return daily.groupBy("_receipt_id").agg(
        F.collect_list(F.when(counts, F.struct("day", "n", "amount"))).alias("_days"))


def with_gaps(listed: DataFrame) -> DataFrame:
    """The lists of `receipt_lists` in order of days, with the gaps."""
    ordered = listed.select("_receipt_id", F.sort_array("_days").alias("_days"))

    def with_gap(d: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("_days", i - 1)["day"])
        return F.struct(d["day"], d["n"], d["amount"], before.alias("before"), days_between(d["day"], before).alias("gap"))

    return ordered.select("_receipt_id", F.transform("_days", with_gap).alias("_days"))


def receipt_days(receipt: DataFrame, snapshot, repair_years: bool = True, quality: Quality | None = None) -> DataFrame:
    """_receipt_id, _days: a row for each id with any receipt row, whatever its status.

    _days lists the dates of the payments that count, in order: day, n, amount, and for all but the first the day before
    and the gap to it.
    """
    return with_gaps(receipt_lists(receipt, snapshot, repair_years, quality))


def memo_totals(clean: DataFrame, listed: DataFrame, snapshot) -> DataFrame:
    """cm_amount, cm_count, cm_first_date per _original_id, of the memos that survive the drop test.

    `listed` are the `receipt_lists`: the test asks whether there is a receipt, for which no list has to be in order.

    An invoice whose memos are all later than the snapshot has a row with count 0.
    """
    in_time = F.col("TRX_DATE") <= midnight(snapshot)
    low = holds(F.col("TRX_AMOUNT") <= 0)
    amount = F.coalesce("TRX_AMOUNT", F.lit(0.0))
    memos = clean.where(F.col("PREVIOUS_CUSTOMER_TRX_ID").isNotNull()).groupBy(
        "CUSTOMER_TRX_ID", F.col("PREVIOUS_CUSTOMER_TRX_ID").alias("_original_id"), low.alias("_low")).agg(
        exact_sum(F.when(in_time, amount)).alias("_amount"), F.count_if(in_time).alias("_count"),
        F.min(F.when(in_time, F.col("TRX_DATE"))).alias("_first"))
    paid = memos.join(listed, F.col("CUSTOMER_TRX_ID") == F.col("_receipt_id"), "left")
    # The size keeps the list among the columns, so that this is the same exchange as the invoices' own.
    survive = ~F.col("_low") | (F.coalesce(F.size("_days"), F.lit(-1)) >= 0)
    return paid.where(survive).groupBy("_original_id").agg(
        F.coalesce(exact_sum(F.col("_amount")), F.lit(0.0)).alias("cm_amount"), F.sum("_count").alias("cm_count"),
        F.min("_first").alias("cm_first_date"))


def first_rows(clean: DataFrame) -> DataFrame:
    """_positive, _other: per id the first row with a positive or missing amount, and the first of the others."""
    cells = [cell for c in KEEP_ORDER for cell in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    row, low = F.struct(*cells), holds(F.col("TRX_AMOUNT") <= 0)
    flag = [F.max(TARGET).alias(TARGET)] if TARGET in clean.columns else []
    return clean.where(F.col("CUSTOMER_TRX_ID").isNotNull()).groupBy("CUSTOMER_TRX_ID").agg(
        F.min(F.when(~low, row)).alias("_positive"), F.min(F.when(low, row)).alias("_other"), *flag)


def ledger(
    invoice: DataFrame, receipt: DataFrame, snapshot, repair_years: bool = True, has_memos: bool | None = None,
    quality: Quality | None = None,
) -> DataFrame:
    """Unique netted invoices with AS_OF_DATE and `_days`, without customer columns.

    Memos without a receipt are dropped before netting, so they reduce nothing. Amounts are cut at zero if there are
    memos at all: `has_memos` says so where the rows are part of a larger table.
    """
    flag = [TARGET] if TARGET in invoice.columns else []
    clean = clean_invoices(invoice, flag)
    listed = receipt_lists(receipt, snapshot, repair_years, quality)
    days = with_gaps(listed)
    totals = memo_totals(clean, listed, snapshot)
    watched = clean if quality is None else clean_invoices(quality.watch_invoices(invoice), flag)
    found = first_rows(watched).join(days, F.col("CUSTOMER_TRX_ID") == F.col("_receipt_id"), "left")
    kept = F.when(F.coalesce(F.size("_days"), F.lit(-1)) >= 0, F.least("_positive", "_other")).otherwise(F.col("_positive"))
    rows = found.select("CUSTOMER_TRX_ID", kept.alias("_row"), "_days", *flag).where(F.col("_row").isNotNull())
    if has_memos is None:
        memos = totals.agg(F.max(F.struct(*totals.columns)).isNotNull()).scalar()
    else:
        memos = F.lit(has_memos)
    gross = F.coalesce("_row.TRX_AMOUNT", F.lit(0.0))
    effect = F.least(F.coalesce("cm_amount", F.lit(0.0)), F.lit(0.0))
    return rows.join(totals, F.col("CUSTOMER_TRX_ID") == F.col("_original_id"), "left").select(
        "CUSTOMER_TRX_ID",
        *[F.col(f"_row.{c}").alias(c) for c in CARRIED if c != "TRX_AMOUNT"],
        F.when(memos, F.greatest(gross + effect, F.lit(0.0))).otherwise(gross).alias("TRX_AMOUNT"),
        gross.alias("TRX_AMOUNT_GROSS"),
        (F.lit(0.0) - effect).alias("credit_memo_reduction"),
        F.coalesce("cm_count", F.lit(0)).alias("cm_count"),
        "cm_first_date",
        as_of(F.col("_row.DUE_DATE"), snapshot).alias("AS_OF_DATE"),
        "_days",
        *flag,
    )


def invoice_core(invoice: DataFrame, receipt: DataFrame, snapshot) -> DataFrame:
    """Cleaned, netted and unique invoices with AS_OF_DATE, without customer columns and payments."""
    return ledger(invoice, receipt, snapshot).drop("_days", TARGET)


def with_payment_facts(rows: DataFrame, snapshot, as_of_col: str, prefix: str) -> DataFrame:
    """`payment_facts` of ledger rows, from `_days`, which goes."""
    days, snap = F.col("_days"), midnight(snapshot)

    def inside(d: Column) -> Column:
        return (d["day"] >= F.col("TRX_DATE")) & (d["day"] <= F.col(as_of_col))

    def n_of(found: Column) -> Column:
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, d: a + d["n"])

    def amount_of(found: Column) -> Column:
        # In order of days, so always the same.
        return F.aggregate(found, F.lit(0.0), lambda a, d: a + d["amount"])

    def sum_of(value) -> Column:
        return F.aggregate(days, F.lit(0).cast("bigint"), lambda a, d: a + F.coalesce(value(d["gap"]), F.lit(0)))

    def first(found: Column) -> Column:
        return F.get(found, F.lit(0))["day"]

    names = [c for c in rows.columns if c != "_days"]
    within = rows.select(
        *names, "_days", F.filter(days, inside).alias("_inside"))
    gaps = F.filter("_inside", lambda d: d["before"] >= F.col("TRX_DATE"))
    some, n = F.coalesce(F.size(days), F.lit(0)) > 0, n_of(days)
    return within.select(
        *names,
        F.coalesce(n_of(F.col("_inside")), F.lit(0)).alias(f"n_pay_{prefix}"),
        F.coalesce(amount_of(F.col("_inside")), F.lit(0.0)).alias(f"amt_paid_{prefix}"),
        first(F.col("_inside")).alias(f"first_pay_{prefix}"),
        F.try_element_at("_inside", F.lit(-1))["day"].alias(f"last_pay_{prefix}"),
        F.coalesce(F.array_max(F.transform(gaps, lambda d: d["gap"])), F.lit(0)).alias(f"max_gap_{prefix}"),
        F.coalesce(F.size(F.filter(gaps, lambda d: d["gap"] > 90)), F.lit(0)).cast("bigint").alias(f"count_gaps_gt_90_{prefix}"),
        F.when(some, n).alias("receipt_count"),
        first(days).alias("first_pay_date"),
        F.try_element_at(days, F.lit(-1))["day"].alias("last_pay_date"),
        F.when(some, amount_of(days)).alias("total_paid"),
        F.when(some, gap_variance(n, sum_of(lambda g: g), sum_of(lambda g: g * g))).alias("gap_variance"),
        F.coalesce(amount_of(F.filter(days, lambda d: (d["day"] <= snap) & (d["day"] <= plus_days(F.col("DUE_DATE"), 90)))),
                   F.lit(0.0)).alias("paid_by_bd90"),
        first(F.filter(days, lambda d: d["day"] <= snap)).alias("first_pay_known"),
        first(F.filter(days, lambda d: (d["day"] <= snap) & (d["gap"] > 90))).alias("first_gap90_known"),
    )
