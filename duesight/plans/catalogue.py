"""Which stored run answers a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesight.schemas import PUBLICATIONS
from duesight.settings import COVER_DAYS


def range_days(col: Column) -> Column:
    """Days a range covers; 0 for a custom or unknown one."""
    out = F.lit(0)
    for name, days in COVER_DAYS.items():
        out = F.when(col == name, days).otherwise(out)
    return out


def _day(value) -> Column:
    return F.lit(None if value is None else str(value)).cast("date")


def _exact(time_range: str, start, end) -> Column:
    same = F.col("time_range") == time_range
    if time_range == "custom":
        if start is not None:
            same = same & (F.col("start_date") == _day(start))
        if end is not None:
            same = same & (F.col("end_date") == _day(end))
    return same


def completed_runs(runs: DataFrame, model_key: str, snapshot) -> DataFrame:
    return runs.where(
        (F.col("model_key") == model_key) & (F.col("snapshot_date") == _day(snapshot)) & (F.col("status") == "completed")
    )


def latest_run(runs: DataFrame, model_key: str, snapshot, time_range: str, start=None, end=None) -> DataFrame:
    """The newest completed run of exactly this request; no row when there is none."""
    return (
        completed_runs(runs, model_key, snapshot)
        .where(_exact(time_range, start, end))
        .orderBy(F.desc("completed_at"), "job_id")
        .limit(1)
    )


def latest_covering_run(
    runs: DataFrame, model_key: str, snapshot, time_range: str, start=None, end=None
) -> DataFrame:
    """As latest_run, else the newest completed run with a range at least as long.

    Adds fallback_used and effective_time_range. Custom requests have no fallback.
    """
    exact = _exact(time_range, start, end)
    answers = exact
    need = COVER_DAYS.get(time_range, 0)
    if need:
        answers = exact | (range_days(F.col("time_range")) >= need)
    return (
        completed_runs(runs, model_key, snapshot)
        .where(answers)
        .withColumn("fallback_used", ~exact)
        .withColumn("effective_time_range", F.col("time_range"))
        .orderBy("fallback_used", F.desc("completed_at"), "job_id")
        .limit(1)
    )


def publications(scores: DataFrame) -> DataFrame:
    """The index of a published table: a row per publication. Jobs append theirs, so that no report has to count."""
    keys = [c for c in PUBLICATIONS.names if c not in ("total_invoices", "replaces")]
    return scores.groupBy(*keys).agg(F.count("*").alias("total_invoices"))


def _wanted(rows: DataFrame, model_key: str, snapshot) -> DataFrame:
    return rows.where((F.col("model_key") == model_key) & (F.col("snapshot_date") == _day(snapshot)))


def published_runs(scores: DataFrame, model_key: str, snapshot, index: DataFrame | None = None) -> DataFrame:
    """Every publication of a model and snapshot with its number of rows, from the index where there is one."""
    return publications(_wanted(scores, model_key, snapshot)) if index is None else _wanted(index, model_key, snapshot)


def covering_publication(
    scores: DataFrame, model_key: str, snapshot, time_range: str, start=None, end=None, index: DataFrame | None = None
) -> DataFrame:
    """The newest publication that covers the request, else the newest exact one.

    `all` covers every preset and an `all` request; a preset covers shorter
    ones; a custom request needs its own dates.
    """
    found = published_runs(scores, model_key, snapshot, index)
    exact = _exact(time_range, start, end)
    if time_range == "custom":
        covers = exact
    else:
        covers = F.col("time_range") == "all"
        need = COVER_DAYS.get(time_range, 0)
        if time_range != "all" and need:
            covers = covers | (range_days(F.col("time_range")) >= need)
    return (
        found.where(covers | exact)
        .withColumn("covering", covers)
        .orderBy(F.desc("covering"), F.desc("published_at"), "job_id")
        .limit(1)
    )


def exact_publication(scores: DataFrame, model_key: str, snapshot, time_range: str) -> DataFrame:
    """The job of exactly this range with the latest publication."""
    return (
        scores.where(
            (F.col("model_key") == model_key)
            & (F.col("snapshot_date") == _day(snapshot))
            & (F.col("time_range") == time_range)
        )
        .groupBy("job_id", "snapshot_date")
        .agg(F.max("published_at").alias("last_published_at"))
        .orderBy(F.desc("last_published_at"), "job_id")
        .limit(1)
    )


def rows_of(rows: DataFrame, run: DataFrame) -> DataFrame:
    """Rows of the one run found. It is a single row, and its partition columns
    take part in the join, so only its partition is read."""
    keys = ["job_id", *[c for c in ("time_range", "date_window") if c in run.columns and c in rows.columns]]
    return rows.join(F.broadcast(run.select(*keys)), keys, "left_semi").select(*rows.columns)


def rows_of_found(rows: DataFrame, run: DataFrame) -> DataFrame:
    """As rows_of, with the run looked up first: its partition is named by literals, so that nothing else is listed or read."""
    found = run.first()
    if found is None:
        return rows.where(F.lit(False))
    keys = ["model_key", "snapshot_date", "time_range", "date_window", "job_id"]
    for c in (k for k in keys if k in run.columns and k in rows.columns):
        rows = rows.where(F.col(c) == F.lit(found[c]))
    return rows
