"""What was known about a party from its earlier invoices.

Input is one row per invoice with its payment facts. The invoice rows and the
dated events of the same party (an unpaid rest 90 days past due, a late first
payment, a long gap between payments) are put into one stream per party in date
order, so one exchange and one sort serve every running value, the event counts
included: on equal dates invoices come first, which makes an event count only
for invoices dated strictly after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesight.functions.cleaning import clip, days_between, flag, holds, log1p_floor0, midnight, plus_days
from duesight.operators.features import paid_fraction
from duesight.operators.skew import NO_SKEW, Skew, running, with_lane
from duesight.settings import COLD_START, UNPAID_EPS

SEED, INVOICE_ROW, BD90, LATE_FIRST, GAP90 = -1, 0, 1, 2, 3
EVENT_COUNTS = {
    BD90: "party_prior_bd90_cnt",
    LATE_FIRST: "party_prior_late_firstpay90_cnt",
    GAP90: "party_prior_gap90_cnt",
}
EVENT_DATES = {BD90: "bd90_event_date", LATE_FIRST: "late_firstpay90_event_date", GAP90: "gap90_event_date"}


def days_past_due() -> Column:
    return days_between(F.col("last_pay_date"), F.col("DUE_DATE"))


def outcome_columns() -> dict[str, Column]:
    """How an invoice ended, from all its payments and `actual_dpd`."""
    paid = F.col("last_pay_date").isNotNull()
    dpd = F.col("actual_dpd")
    return {
        "is_paid": paid.cast("int"),
        "is_late": flag(dpd > 0),
        "is_partial": F.when(paid, (F.col("receipt_count") > 1).cast("int")),
        "paid_ratio": paid_fraction(F.col("total_paid"), F.col("TRX_AMOUNT")),
        "paid_within_30d": flag((dpd <= 30) & paid),
        "paid_within_60d": flag((dpd <= 60) & paid),
        "bad_debt_flag": flag(holds(dpd > 90) | ~paid),
    }


def event_columns(snapshot, eps: float = UNPAID_EPS) -> dict[str, Column]:
    """Date of each event, missing where it did not happen by the snapshot.

    Invoices without a date or party bring no events.
    """
    known = F.col("TRX_DATE").isNotNull() & F.col("PARTY_ID").isNotNull()
    bd90 = plus_days(F.col("DUE_DATE"), 90)
    # Rounded, so that the order in which payments were summed does not decide.
    unpaid = F.round(F.col("TRX_AMOUNT") - F.col("paid_by_bd90"), 6) > eps
    late = days_between(F.col("first_pay_known"), F.col("TRX_DATE")) > 90
    return {
        "bd90_event_date": F.when(known & (bd90 <= midnight(snapshot)) & unpaid, bd90),
        "late_firstpay90_event_date": F.when(known & late, F.col("first_pay_known")),
        "gap90_event_date": F.when(known, F.col("first_gap90_known")),
    }


def invoice_history(facts: DataFrame) -> DataFrame:
    """Invoices with their payment outcome."""
    aged = facts.withColumn("actual_dpd", days_past_due())
    return aged.select("*", *[c.alias(n) for n, c in outcome_columns().items()])


def _event_stream(rows: DataFrame, keep: list[str], work: list[str]) -> DataFrame:
    """Invoice rows plus one narrow row per event; `_kind`, `_at` and the key order them."""
    dates = {INVOICE_ROW: "TRX_DATE", **EVENT_DATES}
    entries = F.array(*[F.struct(F.lit(k).alias("_kind"), F.col(c).alias("_at")) for k, c in dates.items()])
    keys = ["PARTY_ID", "_lane", "CUSTOMER_TRX_ID"]
    payload = [c for c in dict.fromkeys([*keep, *work]) if c not in keys]
    return (
        rows.select("*", F.inline(entries))
        .where(f"_kind = {INVOICE_ROW} OR _at IS NOT NULL")
        .selectExpr(
            *keys,
            "_kind",
            "_at",
            *[f"CASE WHEN _kind = {INVOICE_ROW} THEN `{c}` END AS `{c}`" for c in payload],
        )
    )


def prior_measures() -> dict[str, dict[str, Column]]:
    """The running values behind the history features."""
    paid = F.col("is_paid") == 1
    amount = F.coalesce("TRX_AMOUNT", F.lit(0.0))

    def of_paid(name):
        return F.when(paid, F.col(name))

    rest = amount - F.coalesce("total_paid", F.lit(0.0))
    return {
        "sums": {
            "_amount": amount,
            "_unpaid": F.when(paid, F.lit(0.0)).otherwise(amount),
            "_rest": clip(rest, low=0),
            "_completion": of_paid("paid_ratio"),
            "_gapvar": of_paid("gap_variance"),
        },
        "totals": {
            "_dpd": of_paid("actual_dpd"),
            "_late": of_paid("is_late"),
            "_partial": of_paid("is_partial"),
            "_w30": F.col("paid_within_30d"),
            "_w60": F.col("paid_within_60d"),
            "_bad": F.col("bad_debt_flag"),
        },
        "counts": {
            "_n": F.col("CUSTOMER_TRX_ID"),
            "_n_paid": of_paid("CUSTOMER_TRX_ID"),
            "_n_dpd": of_paid("actual_dpd"),
            "_n_gapvar": of_paid("gap_variance"),
        },
        "lows": {"_first_date": F.col("TRX_DATE")},
        "medians": {"_median_dpd": of_paid("actual_dpd")},
    }


def history_columns() -> dict[str, Column]:
    """History features from the running values; missing where there is no history."""

    def mean(total, n):
        return F.try_divide(F.col(total), F.col(n))

    n = F.col("_n")
    return {
        "customer_maturity_days": F.when(n == 0, 0).otherwise(
            days_between(F.col("TRX_DATE"), F.col("_first_date"))
        ),
        "business_scale_proxy": F.col("_amount"),
        "historical_avg_dpd": mean("_dpd", "_n_dpd"),
        "historical_late_payment_ratio": 100 * mean("_late", "_n_paid"),
        "unpaid_exposure_ratio": F.when(F.col("_amount") > 0, F.col("_unpaid") / (F.col("_amount") + 1)).otherwise(0.0),
        "payment_consistency_variance": mean("_gapvar", "_n_gapvar"),
        "historical_partial_payment_freq": 100 * mean("_partial", "_n_paid"),
        "hist_avg_payment_completion_ratio": mean("_completion", "_n_paid"),
        "total_outstanding_at_trx": F.col("_rest"),
        "prob_paid_within_30d": mean("_w30", "_n"),
        "prob_paid_within_60d": mean("_w60", "_n"),
        "median_payment_delay": F.col("_median_dpd"),
        "hazard_approx": mean("_bad", "_n"),
    }


POOLED = [
    "customer_maturity_days",
    "business_scale_proxy",
    "historical_avg_dpd",
    "historical_late_payment_ratio",
    "unpaid_exposure_ratio",
    "payment_consistency_variance",
    "historical_partial_payment_freq",
    "hist_avg_payment_completion_ratio",
    "total_outstanding_at_trx",
]


def dated_rows(facts: DataFrame, snapshot, eps: float = UNPAID_EPS) -> DataFrame:
    """Invoices with their payment outcome and the dates of their events."""
    aged = facts.withColumn("actual_dpd", days_past_due())
    return aged.select("*", *[c.alias(n) for n, c in {**outcome_columns(), **event_columns(snapshot, eps)}.items()])


def running_values() -> list[str]:
    """Names of the running values of a party but for the median, which goes on from a histogram."""
    measures = prior_measures()
    return [n for kind in ("sums", "totals", "counts", "lows") for n in measures[kind]] + list(EVENT_COUNTS.values())


def party_stream(
    rows: DataFrame, keep: Sequence[str], skew: Skew = NO_SKEW, earlier: DataFrame | None = None
) -> DataFrame:
    """The running values of every invoice and event of `dated_rows`, which have a `_lane`.

    `earlier` has what the parties had before these rows: SEED rows with the running values (under the prefix `_s_`),
    SEED rows of the median's histogram (`_s_value`, `_s_freq`), and events of invoices that are not among the rows.
    Sums go on from a seed as if its rows were there, bit by bit.
    """
    stream = _event_stream(rows, list(keep), ["actual_dpd", *outcome_columns()])
    measures = prior_measures()
    is_invoice = F.col("_kind") == INVOICE_ROW
    sums = {n: F.when(is_invoice, c) for n, c in measures["sums"].items()}
    totals = {n: F.when(is_invoice, c) for n, c in measures["totals"].items()}
    counts = {n: F.when(is_invoice, c) for n, c in measures["counts"].items()}
    counts |= {n: F.when(F.col("_kind") == k, 1) for k, n in EVENT_COUNTS.items()}
    lows, medians, weight = measures["lows"], measures["medians"], None
    if earlier is not None:
        stream = stream.unionByName(earlier, allowMissingColumns=True)
        is_seed = F.col("_kind") == SEED

        def seeded(measure: dict[str, Column]) -> dict[str, Column]:
            return {n: F.when(is_seed, F.col(f"_s_{n}")).otherwise(c) for n, c in measure.items()}

        ones = {n: F.when(c.isNotNull(), F.lit(1).cast("bigint")) for n, c in counts.items()}
        sums, totals, counts, lows = seeded(sums), seeded(totals | ones), {}, seeded(lows)
        medians = {n: F.when(is_seed, F.col("_s_value")).otherwise(c) for n, c in medians.items()}
        weight = F.coalesce("_s_freq", F.lit(1).cast("bigint"))
    done = running(
        stream,
        ["PARTY_ID", "_lane"],
        ["_at", "_kind", "CUSTOMER_TRX_ID"],
        sums=sums,
        totals=totals,
        counts=counts,
        lows=lows,
        medians=medians,
        weight=weight,
        skew=skew,
    )
    return done if earlier is None else done.where(F.col("_kind") != SEED).drop(*[c for c in earlier.columns if c.startswith("_s_")])


def history_of_stream(done: DataFrame, keep: Sequence[str], pooled: bool = False) -> DataFrame:
    """The columns to keep and the history features of the invoices of a party stream.

    With `pooled` also the pooled variant of a party that is no part of the pool, from the same running values.
    """
    has_party = F.col("PARTY_ID").isNotNull()
    dated = has_party & F.col("TRX_DATE").isNotNull()
    prior = F.when(dated, F.col("_n")).otherwise(0)
    history = {
        n: F.coalesce(F.when(has_party, c), F.lit(COLD_START[n])) for n, c in history_columns().items()
    }
    history["business_scale_proxy"] = log1p_floor0(history["business_scale_proxy"])
    return done.where(F.col("_kind") == INVOICE_ROW).select(
        *keep,
        (~has_party).cast("int").alias("party_missing"),
        prior.alias("party_prior_invoice_cnt"),
        flag(has_party & (prior == 0)).alias("party_is_new_customer"),
        *[F.when(dated, F.col(n)).otherwise(0).alias(n) for n in EVENT_COUNTS.values()],
        *[c.alias(n) for n, c in history.items()],
        log1p_floor0(F.col("TRX_AMOUNT")).alias("TRX_AMOUNT_log1p"),
        *([history_columns()[n].alias(f"pooled_{n}") for n in POOLED] if pooled else []),
    )


def with_window_lane(facts: DataFrame, skew: Skew = NO_SKEW) -> DataFrame:
    """Lanes that spread a hot party for a join must not split its window."""
    if "PARTY_ID" in skew.lanes or "_lane" not in facts.columns:
        facts = with_lane(facts.drop("_lane"), "PARTY_ID", "CUSTOMER_TRX_ID")
    return facts


def party_history(
    facts: DataFrame, snapshot, eps: float = UNPAID_EPS, skew: Skew = NO_SKEW, pooled: bool = False
) -> DataFrame:
    """Add the party's history to every invoice; all columns of `facts` are kept. `pooled` as in `history_of_stream`.

    Invoices without a party get the cold-start values. They are windowed one by
    one, by id, so that they do not pile up in one task.
    """
    facts = with_window_lane(facts, skew)
    keep = [c for c in facts.columns if c != "_lane"]
    return history_of_stream(party_stream(dated_rows(facts, snapshot, eps), keep, skew), keep, pooled)


def in_pool() -> Column:
    """Whether the pooled variant counts the invoice to party -1."""
    return F.coalesce("PARTY_ID", F.lit(-1)) == -1


def pooled_history(history: DataFrame, skew: Skew = NO_SKEW, keep: Sequence[str] = ()) -> DataFrame:
    """History of the pooled variant, from invoice_history rows: the id and the values, under the prefix `pooled_`
    beside columns to `keep`.

    All invoices without a party form one party, -1. Values stay missing where
    there is no history, and the business scale is a plain sum.
    """
    measures = prior_measures()
    rows = history.withColumn("_pool", F.coalesce("PARTY_ID", F.lit(-1)))
    done = running(
        rows,
        ["_pool"],
        ["TRX_DATE", "CUSTOMER_TRX_ID"],
        sums=measures["sums"],
        totals=measures["totals"],
        counts=measures["counts"],
        lows=measures["lows"],
        skew=skew,
    )
    columns = history_columns()
    prefix = "pooled_" if keep else ""
    return done.select(*(keep or ["CUSTOMER_TRX_ID"]), *[columns[n].alias(f"{prefix}{n}") for n in POOLED])
