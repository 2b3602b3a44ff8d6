"""Reports over published results: pages, summaries, top lists, alerts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesight.operators.customer_risk import level_counts, warning_counts
from duesight.plans.catalogue import covering_publication, latest_covering_run, rows_of, rows_of_found
from duesight.functions.risk import checked
from duesight.settings import MAX_PAGE_SIZE, PAGE_SIZE, PREVIEW_ROWS, RISK_LEVELS, THRESHOLD_HIGH, THRESHOLD_LOW, TOP_LOSS_ROWS
from duesight.sinks.publish import latest_per_invoice
from duesight.sources.tables import scored_in_range

# Columns a report may sort by; the first is the default.
SCORE_SORT = [
    "prob_bad_debt",
    "expected_financial_loss",
    "TRX_AMOUNT",
    "CUSTOMER_NAME",
    "SBU",
    "TRX_DATE",
    "DUE_DATE",
    "days_to_due",
    "risk_level",
    "CUSTOMER_TRX_ID",
]
ALERT_SORT = ["prob_bad_debt", "expected_financial_loss", "TRX_AMOUNT", "CUSTOMER_NAME"]
RISK_SORT = [
    "cust_score_max",
    "cust_score_mean",
    "cust_score_wavg_amount",
    "invoice_cnt",
    "total_amount",
    "risk_cust",
    "CUSTOMER_NAME",
]
# Columns of the score report, of the chart and of the customer report.
SCORE_REPORT = [
    "CUSTOMER_TRX_ID",
    "ACCOUNT_NUMBER",
    "CUSTOMER_NAME",
    "SBU",
    "TRX_DATE",
    "DUE_DATE",
    "days_to_due",
    "TRX_AMOUNT",
    "TRX_AMOUNT_GROSS",
    "credit_memo_reduction",
    "prob_bad_debt",
    "risk_level",
    "recommended_action",
    "expected_financial_loss",
]
CHART = [
    "CUSTOMER_TRX_ID",
    "ACCOUNT_NUMBER",
    "CUSTOMER_NAME",
    "SBU",
    "prob_bad_debt",
    "expected_financial_loss",
    "risk_level",
    "recommended_action",
]
RISK_REPORT = [
    "PARTY_ID",
    "ACCOUNT_NUMBER",
    "CUSTOMER_NAME",
    "cust_score_max",
    "cust_score_mean",
    "cust_score_wavg_amount",
    "invoice_cnt",
    "total_amount",
    "total_amt_paid_pre_due",
    "paid_ratio_pre_due_total",
    "paid_ratio_pre_due_mean",
    "pct_invoices_gap_gt_90_pre_due",
    "party_prior_invoice_cnt",
    "party_prior_gap90_cnt",
    "party_prior_gap90_rate",
    "risk_cust",
]
RISK_TIE = ["PARTY_ID", "ACCOUNT_NUMBER", "CUSTOMER_NAME"]


def sort_order(sort_by: str, direction: str, allowed: list[str], ties: list[str]) -> list[Column]:
    """An unknown column means the default one, an unknown direction descending."""
    name = sort_by if sort_by in allowed else allowed[0]
    first = F.asc(name) if direction.lower() == "asc" else F.desc(name)
    return [first, *[F.asc(c) for c in ties if c != name]]


def with_level(rows: DataFrame, level: str | None, column: str) -> DataFrame:
    return rows.where(F.col(column) == level) if level in RISK_LEVELS else rows


def with_name(rows: DataFrame, search: str | None) -> DataFrame:
    """Case-blind substring; % and _ in the text act as wildcards."""
    return rows.where(F.col("CUSTOMER_NAME").ilike(f"%{search}%")) if search else rows


def page_of(rows: DataFrame, order: list[Column], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a total order. Spark keeps only page*size rows per task for it."""
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be >= 1 and size within 1..{MAX_PAGE_SIZE}")
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(
    rows: DataFrame, last: Mapping[str, object], sort_by: str, direction: str, allowed: list[str], ties: list[str],
    size: int = PAGE_SIZE,
) -> DataFrame:
    """The page after the row `last` in the order of sort_order. However deep it is, a task keeps `size` rows."""
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"size must be within 1..{MAX_PAGE_SIZE}")
    name = sort_by if sort_by in allowed else allowed[0]
    names = [name, *[c for c in ties if c != name]]
    later, same = F.lit(False), F.lit(True)
    for k, c in enumerate(names):
        rising, value = k > 0 or direction.lower() == "asc", last[c]
        # Missing values come first in rising order, last in falling.
        if value is None:
            beyond = F.col(c).isNotNull() if rising else F.lit(False)
        else:
            beyond = F.col(c) > F.lit(value) if rising else (F.col(c) < F.lit(value)) | F.col(c).isNull()
        later = later | (same & beyond)
        same = same & F.col(c).eqNullSafe(F.lit(value))
    return rows.where(later).orderBy(*sort_order(sort_by, direction, allowed, ties)).limit(size)


def page_totals(rows: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    total = F.count("*")
    return rows.agg(
        F.lit(page).alias("page"),
        F.lit(size).alias("page_size"),
        total.alias("total_records"),
        F.ceil(total / size).alias("total_pages"),
    )


def top_loss(rows: DataFrame, n: int = TOP_LOSS_ROWS) -> DataFrame:
    known = rows.where(F.col("expected_financial_loss").isNotNull())
    return known.orderBy(F.desc("expected_financial_loss"), "CUSTOMER_TRX_ID").limit(n)


def alerts(rows: DataFrame, threshold: float = THRESHOLD_LOW) -> DataFrame:
    """Rows at or above the threshold, most likely first."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be within 0 and 1")
    return rows.where(F.col("prob_bad_debt") >= threshold).orderBy(F.desc("prob_bad_debt"), "CUSTOMER_TRX_ID")


def preview(rows: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    return rows.orderBy("CUSTOMER_TRX_ID").limit(n)


def answering_rows(
    scores: DataFrame, model_key: str, snapshot, time_range: str, start=None, end=None, index: DataFrame | None = None
) -> DataFrame:
    """Newest row per invoice of the covering publication, cut to the requested range.

    With the index of publications no score row is read to find it, and only its partition is read.
    """
    run = covering_publication(scores, model_key, snapshot, time_range, start, end, index)
    wanted = scores.where(
        (F.col("model_key") == model_key) & (F.col("snapshot_date") == F.lit(str(snapshot)).cast("date"))
    )
    rows = rows_of(wanted, run) if index is None else rows_of_found(scores, run)
    return latest_per_invoice(scored_in_range(rows, time_range, snapshot, start, end))


def _paged(
    shown: DataFrame, page: int, size: int, sort_by: str, direction: str, allowed: list[str], ties: list[str],
    after: Mapping[str, object] | None,
) -> DataFrame:
    """The page of a number, or the one after a row that the caller has seen."""
    if after is not None:
        return page_after(shown, after, sort_by, direction, allowed, ties, size)
    return page_of(shown, sort_order(sort_by, direction, allowed, ties), page, size)


def _score_parts(
    rows: DataFrame, page: int, size: int, sort_by: str, direction: str, level: str | None, search: str | None,
    after: Mapping[str, object] | None = None,
) -> dict[str, DataFrame]:
    shown = with_name(with_level(rows, level, "risk_level"), search)
    return {
        "page": _paged(shown, page, size, sort_by, direction, SCORE_SORT, ["CUSTOMER_TRX_ID"], after).select(*SCORE_REPORT),
        "totals": page_totals(shown, page, size),
        "risk_summary": level_counts(rows, "risk_level"),
        "top_loss": top_loss(rows).select(*SCORE_REPORT),
    }


def score_report(
    scores: DataFrame, model_key: str, snapshot, time_range: str, start=None, end=None, page: int = 1,
    size: int = PAGE_SIZE, sort_by: str = "prob_bad_debt", direction: str = "desc",
    level: str | None = None, search: str | None = None, index: DataFrame | None = None,
    after: Mapping[str, object] | None = None,
) -> dict[str, DataFrame]:
    """Page, totals, counts per level and the largest expected losses.

    The parts are separate frames over the same rows; a caller who wants several
    of them may write the answering rows out first. `after` is the last row of the page before.
    """
    rows = answering_rows(scores, model_key, snapshot, time_range, start, end, index)
    return _score_parts(rows, page, size, sort_by, direction, level, search, after)


def alerts_report(
    scores: DataFrame, model_key: str, snapshot, time_range: str, start=None, end=None,
    threshold: float = THRESHOLD_LOW, page: int = 1, size: int = PAGE_SIZE,
    sort_by: str = "prob_bad_debt", direction: str = "desc", search: str | None = None,
    index: DataFrame | None = None, after: Mapping[str, object] | None = None,
) -> dict[str, DataFrame]:
    rows = answering_rows(scores, model_key, snapshot, time_range, start, end, index)
    shown = with_name(rows.where(F.col("prob_bad_debt") >= threshold), search)
    return {
        "page": _paged(shown, page, size, sort_by, direction, ALERT_SORT, ["CUSTOMER_TRX_ID"], after).select(*SCORE_REPORT),
        "totals": page_totals(shown, page, size),
        "risk_summary": level_counts(rows, "risk_level"),
    }


def early_warning_report(
    scores: DataFrame, model_key: str, snapshot, time_range: str, start=None, end=None, page: int = 1,
    size: int = PAGE_SIZE, sort_by: str = "prob_bad_debt", direction: str = "desc",
    level: str | None = None, search: str | None = None, low: float = THRESHOLD_LOW, high: float = THRESHOLD_HIGH,
    index: DataFrame | None = None, after: Mapping[str, object] | None = None,
) -> dict[str, DataFrame]:
    """The score report plus alert and high-risk counts over the searched rows."""
    low, high = checked(low, high)
    rows = answering_rows(scores, model_key, snapshot, time_range, start, end, index)
    parts = _score_parts(rows, page, size, sort_by, direction, level, search, after)
    return {**parts, "counts": warning_counts(with_name(rows, search), low, high)}


def chart_rows(
    scores: DataFrame, model_key: str, snapshot, time_range: str, start=None, end=None, index: DataFrame | None = None
) -> DataFrame:
    """Narrow rows for a chart; empty when nothing was published.

    A request that no publication answers is served from the `all` run, cut to
    its range.
    """
    run = covering_publication(scores, model_key, snapshot, time_range, start, end, index)
    other = covering_publication(scores, model_key, snapshot, "all", index=index)
    first = (
        run.withColumn("_choice", F.lit(0))
        .unionByName(other.withColumn("_choice", F.lit(1)))
        .orderBy("_choice")
        .limit(1)
    )
    wanted = scores.where(
        (F.col("model_key") == model_key) & (F.col("snapshot_date") == F.lit(str(snapshot)).cast("date"))
    )
    found = rows_of(wanted, first) if index is None else rows_of_found(scores, first)
    rows = scored_in_range(found, time_range, snapshot, start, end)
    return latest_per_invoice(rows).select(*CHART)


def customer_risk_report(
    runs: DataFrame, risk: DataFrame, model_key: str, snapshot, time_range: str, start=None, end=None,
    page: int = 1, size: int = PAGE_SIZE, sort_by: str = "cust_score_max", direction: str = "desc",
    level: str | None = None, search: str | None = None, after: Mapping[str, object] | None = None,
) -> dict[str, DataFrame]:
    """Customer risk of the run that answers, with the run itself."""
    run = latest_covering_run(runs, model_key, snapshot, time_range, start, end)
    # The model and the snapshot are literals, so only their partitions are read; the run's own are pruned by the join.
    wanted = risk.where((F.col("model_key") == model_key) & (F.col("snapshot_date") == F.lit(str(snapshot)).cast("date")))
    rows = rows_of(wanted, run.select("job_id", "time_range"))
    shown = with_name(with_level(rows, level, "risk_cust"), search)
    return {
        "page": _paged(shown, page, size, sort_by, direction, RISK_SORT, RISK_TIE, after).select(*RISK_REPORT),
        "totals": page_totals(shown, page, size),
        "run": run,
    }
