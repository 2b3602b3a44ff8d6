"""Composed jobs: score files, run a snapshot and publish it."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duesight.operators.customer_risk import CUSTOMER_KEY, customer_risk, level_counts
from duesight.operators.exclusion import exclude_affiliates
from duesight.operators.scoring import SCORE_COLUMNS, Model, default_models, resolve_model_key, score, score_table
from duesight.operators.skew import Skew
from duesight.operators.targets import restrict_to_targets, run_inputs
from duesight.plans.features import RawTables, party_skew, snapshot_features
from duesight.plans.reports import preview, top_loss
from duesight.schemas import CUSTOMER_RISK, RUNS, SCORES
from duesight.session import materialise
from duesight.settings import KEEP_PUBLISHED_DAYS, KEEP_RUN_DAYS, THRESHOLD_HIGH, THRESHOLD_LOW
from duesight.sinks.publish import (
    RunKey,
    drop_expired,
    drop_from_index,
    drop_jobs,
    expired_runs,
    publish_customer_risk,
    publish_scores,
    read_table,
    retain_published,
    retain_runs,
    rewrite,
)
from duesight.sources.files import load_raw_tables

_RISK_INPUTS = [
    "PARTY_ID",
    "amt_paid_pre_due",
    "paid_ratio_pre_due",
    "count_gaps_gt_90_pre_due",
    "party_prior_invoice_cnt",
    "party_prior_gap90_cnt",
]
#: What both result tables are made of.
PUBLISHED_INPUTS = [*SCORE_COLUMNS, *[c for c in _RISK_INPUTS if c not in SCORE_COLUMNS]]


def score_snapshot(
    raw: RawTables, snapshot, model: Model | None = None, skew: Skew | None = None,
    low: float = THRESHOLD_LOW, high: float = THRESHOLD_HIGH,
) -> DataFrame:
    """Features and scores of the target invoices (of all when there are no targets)."""
    return restrict_to_targets(score(snapshot_features(raw, snapshot, skew), model, low, high), raw.target_ids)


def model_of(key: str | None, models: Mapping[str, Model] | None = None) -> Model:
    """The model of a key, an unknown key meaning the default one."""
    return {**default_models(), **(models or {})}[resolve_model_key(key)]


def score_files(
    spark: SparkSession, invoice_path: str, receipt_path: str, customer_path: str | None, snapshot,
    customer_name: str | None = None, customer_format: str | None = None, model_key: str | None = None,
    models: Mapping[str, Model] | None = None, low: float = THRESHOLD_LOW, high: float = THRESHOLD_HIGH,
) -> dict[str, DataFrame]:
    """Score delivered files by the model of the key. Affiliates are not left out here."""
    raw = load_raw_tables(spark, invoice_path, receipt_path, customer_path, customer_name, customer_format)
    scored = score_snapshot(raw, snapshot, model_of(model_key, models), low=low, high=high)
    rows = score_table(scored)
    risk = customer_risk(scored, True, low, high)
    return {
        "scores": rows,
        "preview": preview(rows),
        "top_loss": top_loss(rows),
        "risk_summary": level_counts(rows, "risk_level"),
        "customer_risk": risk,
        "customer_risk_summary": level_counts(risk, "risk_cust"),
    }


def _counts(rows: DataFrame, level: str) -> dict[str, int]:
    return {r[level]: r["cnt"] for r in level_counts(rows, level).collect()}


def run_snapshot(
    spark: SparkSession,
    source: RawTables,
    snapshot: str,
    time_range: str,
    scores_path: str,
    risk_path: str,
    job_id: str,
    published_at: str,
    model_key: str | None = None,
    start: str | None = None,
    end: str | None = None,
    excluded: DataFrame | None = None,
    models: Mapping[str, Model] | None = None,
    replace: bool = True,
    runs_path: str | None = None,
    index_path: str | None = None,
    keep_published_days: int | None = None,
    keep_run_days: int | None = None,
    year: int | None = None,
    low: float = THRESHOLD_LOW,
    high: float = THRESHOLD_HIGH,
) -> DataFrame:
    """Fetch, score, exclude, aggregate and publish one run; returns its catalogue row.

    The scored rows are written out once and feed both result tables. The row is
    appended to the run catalogue at `runs_path`, once both tables are published, and
    the publication to the index at `index_path`, from which the reports find it.
    With `keep_published_days` older score rows go then; with `keep_run_days` older
    runs of that catalogue with all their score and risk rows.
    """
    began = time.time()
    key = resolve_model_key(model_key)
    run = RunKey(job_id, key, snapshot, time_range, published_at, start, end)
    skew = party_skew(source)
    raw = run_inputs(source, time_range, snapshot, start, end, year, skew)
    scored = score_snapshot(raw, snapshot, model_of(key, models), skew, low, high)
    if excluded is not None:
        scored = exclude_affiliates(scored, excluded)
    kept = materialise(scored.select(*PUBLISHED_INPUTS), "scored")

    risk = customer_risk(kept, True, low, high)
    publish_scores(score_table(kept), scores_path, run, replace, index_path)
    publish_customer_risk(risk, risk_path, run, replace)

    levels = _counts(kept, "risk_level")
    risk_levels = _counts(risk, "risk_cust")
    started = dt.datetime.fromisoformat(published_at)
    seconds = time.time() - began
    row = (
        job_id, "completed", key, dt.date.fromisoformat(snapshot), time_range,
        dt.date.fromisoformat(start) if start else None, dt.date.fromisoformat(end) if end else None,
        sum(levels.values()), sum(risk_levels.values()), _json(levels), _json(risk_levels), None,
        started, started + dt.timedelta(seconds=seconds), seconds,
    )
    found = spark.createDataFrame([row], RUNS)
    if runs_path is not None:
        found.coalesce(1).write.mode("append").parquet(runs_path)
    if keep_published_days is not None:
        drop_expired(spark, scores_path, SCORES, published_at, keep_published_days)
    if keep_run_days is not None and runs_path is not None:
        runs = stored_runs(spark, runs_path)
        stay = materialise(retain_in_place(spark, runs, scores_path, risk_path, published_at, -1, keep_run_days), "runs")
        if index_path is not None:
            drop_from_index(spark, index_path, runs.join(stay, "job_id", "left_anti"))
        stay.coalesce(1).write.mode("overwrite").parquet(runs_path)
    return found


def stored_runs(spark: SparkSession, runs_path: str) -> DataFrame:
    """The run catalogue, which the reports look their run up in."""
    return read_table(spark, runs_path, RUNS)


def _json(counts: dict[str, int]) -> str:
    return json.dumps(counts, sort_keys=True)


def retain_results(
    spark: SparkSession,
    runs: DataFrame,
    scores_path: str,
    risk_path: str,
    as_of: str,
    new_scores_path: str,
    new_risk_path: str,
    keep_published_days: int = KEEP_PUBLISHED_DAYS,
    keep_run_days: int = KEEP_RUN_DAYS,
) -> DataFrame:
    """Clean up after a run: old published rows, and old runs with all their rows.

    The kept rows are written to new paths beside the old tables; returns the
    runs that stay.
    """
    scores = retain_published(read_table(spark, scores_path, SCORES), as_of, keep_published_days)
    risk = read_table(spark, risk_path, CUSTOMER_RISK)
    runs, scores, risk = retain_runs(runs, scores, risk, as_of, keep_run_days)
    rewrite(scores, new_scores_path)
    rewrite(risk, new_risk_path)
    return runs


def retain_in_place(
    spark: SparkSession,
    runs: DataFrame,
    scores_path: str,
    risk_path: str,
    as_of: str,
    keep_published_days: int = KEEP_PUBLISHED_DAYS,
    keep_run_days: int = KEEP_RUN_DAYS,
) -> DataFrame:
    """retain_results on the tables themselves, by dropping partitions; returns the runs that stay."""
    drop_expired(spark, scores_path, SCORES, as_of, keep_published_days)
    old = materialise(expired_runs(runs, as_of, keep_run_days).select("job_id"), "expired")
    for path, schema in ((scores_path, SCORES), (risk_path, CUSTOMER_RISK)):
        drop_jobs(spark, path, schema, old)
    return runs.join(old, "job_id", "left_anti").select(*runs.columns)


def run_summary(runs_rows: DataFrame) -> DataFrame:
    """Rows and customers per published job."""
    customer = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CUSTOMER_KEY if c in runs_rows.columns])
    return runs_rows.groupBy("job_id").agg(
        F.count("*").alias("total_invoices"), F.countDistinct(customer).alias("total_customers")
    )
