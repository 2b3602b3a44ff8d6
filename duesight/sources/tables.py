"""Table scans with a date range, as the fetch step uses them.

Dates are typed columns, so the predicates reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesight.functions.cleaning import midnight
from duesight.schemas import CUSTOMER
from duesight.settings import RANGE_DAYS

# Bounds reported when the table has no readable date.
FALLBACK_DATES = ("2020-01-01", "2026-03-15")


def date_range(invoice: DataFrame) -> DataFrame:
    """First and last invoice date, one row."""
    low, high = F.min("TRX_DATE"), F.max("TRX_DATE")
    known = low.isNotNull()
    return invoice.agg(
        F.when(known, F.date_format(low, "yyyy-MM-dd")).otherwise(FALLBACK_DATES[0]).alias("min_date"),
        F.when(known, F.date_format(high, "yyyy-MM-dd")).otherwise(FALLBACK_DATES[1]).alias("max_date"),
    )


def _bounds(invoice: DataFrame | None, time_range, snapshot, start, end, year) -> tuple[Column | None, Column | None] | None:
    """(from, to) of a request, or None when it is a year request."""
    if time_range == "all":
        return None, midnight(snapshot) if snapshot else None
    if time_range == "custom" and start and end:
        return midnight(start), midnight(end)
    if time_range in RANGE_DAYS:
        days = RANGE_DAYS[time_range]
        if snapshot:
            first = dt.date.fromisoformat(str(snapshot)) - dt.timedelta(days=days)
            return midnight(first), midnight(snapshot)
        latest = date_range(invoice).select(F.col("max_date").cast("timestamp")).scalar()
        return latest - F.make_dt_interval(days=F.lit(days)), latest
    if time_range == "year" and year is not None:
        return None
    raise ValueError(f"no such range, or its dates are missing: {time_range}")


def _within(col: Column, low: Column | None, high: Column | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = col >= low
    if high is not None:
        out = out & (col <= high) if low is not None else col <= high
    return out


def invoices_in_range(
    invoice: DataFrame, time_range: str, snapshot=None, start=None, end=None, year: int | None = None
) -> DataFrame:
    """Invoices of a request: a preset, `all`, `custom` with both dates, or `year` with a year."""
    return invoice.where(invoice_range_predicate(invoice, time_range, snapshot, start, end, year))


def invoice_range_predicate(
    invoice: DataFrame, time_range: str, snapshot=None, start=None, end=None, year: int | None = None
) -> Column:
    bounds = _bounds(invoice, time_range, snapshot, start, end, year)
    day = F.col("TRX_DATE")
    return F.year(day) == year if bounds is None else _within(day, *bounds)


def receipts_in_range(
    receipt: DataFrame, time_range: str, snapshot=None, start=None, end=None, year: int | None = None,
    invoice: DataFrame | None = None,
) -> DataFrame:
    """Receipts whose apply or receipt date lies in the range.

    `invoice` is needed only for a preset without a snapshot: the newest invoice
    date is then the anchor.
    """
    bounds = _bounds(invoice, time_range, snapshot, start, end, year)
    apply, received = F.col("APPLY_DATE"), F.col("RECEIPT_DATE")
    if bounds is None:
        return receipt.where((F.year(apply) == year) | (F.year(received) == year))
    return receipt.where(_within(apply, *bounds) | _within(received, *bounds))


def scored_in_range(scores: DataFrame, time_range: str, snapshot, start=None, end=None) -> DataFrame:
    """Range of a read request on stored scores; presets have a lower bound only."""
    day = F.col("TRX_DATE")
    if time_range == "custom" and start and end:
        return scores.where(day.between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    days = RANGE_DAYS.get(time_range, 0)
    if not days:
        return scores
    first = dt.date.fromisoformat(str(snapshot)) - dt.timedelta(days=days)
    return scores.where(day >= F.lit(first))


def customer_columns(customer: DataFrame) -> DataFrame:
    return customer.select(*CUSTOMER.names)
