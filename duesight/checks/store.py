"""Published runs over the derived tables, for the report queries.

Each run publishes the invoices of its range, scored with all history. One run
is published twice in append mode, with other probabilities for every second
invoice, so that readers must pick the newest row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duesight.checks.fixtures import SNAPSHOT, raw_tables
from duesight.operators.customer_risk import customer_risk
from duesight.operators.scoring import score, score_table
from duesight.plans.features import RawTables, snapshot_features
from duesight.plans.jobs import PUBLISHED_INPUTS
from duesight.schemas import CUSTOMER_RISK, SCORES
from duesight.session import materialise, scratch_path
from duesight.sinks.publish import RunKey, publish_customer_risk, publish_scores, read_index, read_table
from duesight.sources.tables import invoices_in_range

# job, model, range, start, end, published at
RUNS = [
    ("job-all", "stacked", "all", None, None, "2000-07-01 06:00:00"),
    ("job-3m", "stacked", "3m", None, None, "2000-07-01 07:00:00"),
    ("job-6m", "stacked", "6m", None, None, "2000-07-01 08:00:00"),
    ("job-c1", "stacked", "custom", "2000-01-01", "2000-03-31", "2000-07-01 09:00:00"),
    ("job-c2", "stacked", "custom", "2000-02-01", "2000-05-31", "2000-07-01 10:00:00"),
    ("job-lg", "lgbm_hyper_smote", "1y", None, None, "2000-07-01 05:00:00"),
]
AGAIN = ("job-3m", "2000-07-01 11:00:00")


def run_keys() -> list[RunKey]:
    return [RunKey(job, model, SNAPSHOT, span, at, start, end) for job, model, span, start, end, at in RUNS]


@dataclass(frozen=True)
class Store:
    """Each part is made when it is first asked for: a query that reads the scored rows publishes nothing."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def raw(self) -> RawTables:
        return raw_tables(self.spark, self.sf_dir)

    @cached_property
    def scored(self) -> DataFrame:
        return materialise(scored_all(self.spark, self.sf_dir), "scored")

    @cached_property
    def published_rows(self) -> DataFrame:
        """The scored rows with the columns that publications and customer risk read."""
        if "scored" in self.__dict__:
            return self.scored.select(*PUBLISHED_INPUTS)
        return materialise(scored_all(self.spark, self.sf_dir).select(*PUBLISHED_INPUTS), "published")

    def _rows_of_runs(self) -> Iterator[tuple[RunKey, DataFrame]]:
        for run in run_keys():
            yield run, invoices_in_range(self.published_rows, run.time_range, SNAPSHOT, run.start_date, run.end_date)

    @cached_property
    def _published(self) -> tuple[str, str]:
        scores_path, index_path = scratch_path(self.spark, "scores"), scratch_path(self.spark, "index")
        for run, rows in self._rows_of_runs():
            publish_scores(score_table(rows), scores_path, run, index_path=index_path)
        again = RunKey(AGAIN[0], "stacked", SNAPSHOT, "3m", AGAIN[1])
        rows = invoices_in_range(halved(self.published_rows), "3m", SNAPSHOT)
        publish_scores(score_table(rows), scores_path, again, replace=False, index_path=index_path)
        return scores_path, index_path

    @property
    def scores_path(self) -> str:
        return self._published[0]

    @cached_property
    def scores(self) -> DataFrame:
        return read_table(self.spark, self.scores_path, SCORES)

    @cached_property
    def index(self) -> DataFrame:
        return read_index(self.spark, self._published[1])

    @cached_property
    def risk(self) -> DataFrame:
        path = scratch_path(self.spark, "risk")
        for run, rows in self._rows_of_runs():
            publish_customer_risk(customer_risk(rows, True), path, run)
        return read_table(self.spark, path, CUSTOMER_RISK)


_stores: dict[tuple[str, str], Store] = {}


def scored_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(snapshot_features(raw_tables(spark, sf_dir), SNAPSHOT))


def halved(scored: DataFrame) -> DataFrame:
    half = scored.where(F.col("CUSTOMER_TRX_ID") % 2 == 0).withColumn("prob_bad_debt", F.col("prob_bad_debt") / 2)
    return score(half.drop("risk_level", "recommended_action", "expected_financial_loss"), F.col("prob_bad_debt"))


def store(spark: SparkSession, sf_dir: str) -> Store:
    """One per session and source folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = Store(spark, sf_dir)
    return _stores[key]


def catalogue(risk: DataFrame) -> DataFrame:
    """The run catalogue as the published risk table shows it."""
    keys = ["job_id", "model_key", "snapshot_date", "time_range", "start_date", "end_date"]
    return risk.groupBy(*keys).agg(
        F.count("*").alias("total_customers"),
        F.sum("invoice_cnt").alias("total_invoices"),
        F.max("published_at").alias("completed_at"),
    ).withColumn("status", F.lit("completed"))
