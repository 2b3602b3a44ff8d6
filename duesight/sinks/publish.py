"""Writing result tables: partition replace, append, retention, export."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duesight.functions.cleaning import finite
from duesight.schemas import CUSTOMER_RISK, PARTITION, PUBLICATIONS, SCORES
from duesight.session import materialise, shuffles_cleared


@dataclass(frozen=True)
class RunKey:
    """What a published result answers, and the run that made it."""

    job_id: str
    model_key: str
    snapshot_date: str
    time_range: str
    published_at: str
    start_date: str | None = None
    end_date: str | None = None

    @property
    def date_window(self) -> str:
        return f"{self.start_date}_{self.end_date}" if self.time_range == "custom" else "-"

    def columns(self) -> dict[str, Column]:
        names = ("job_id", "model_key", "snapshot_date", "time_range", "published_at", "start_date", "end_date",
                 "date_window")
        return {n: F.lit(getattr(self, n)) for n in names}


def conform(rows: DataFrame, schema: T.StructType, run: RunKey) -> DataFrame:
    """Add the run's columns and cut to the target table; numbers are finite or missing."""
    stamped = rows.withColumns(run.columns())

    def cell(f: T.StructField) -> Column:
        if f.name not in stamped.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        col = F.col(f.name)
        if isinstance(stamped.schema[f.name].dataType, (T.DoubleType, T.FloatType)):
            col = finite(col)
        return col.cast(f.dataType).alias(f.name)

    return stamped.select(*[cell(f) for f in schema])


def _write(rows: DataFrame, path: str, replace: bool) -> None:
    writer = rows.write.partitionBy(*PARTITION)
    with shuffles_cleared(rows.sparkSession):
        if replace:
            # Dynamic: only the partitions that receive rows are replaced.
            writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        else:
            writer.mode("append").parquet(path)


def drop_partition(spark: SparkSession, path: str, values: dict) -> None:
    """Remove the partition of a run, as a rerun without rows replaces nothing by itself."""
    folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *(f"{n}={values[n]}" for n in PARTITION)]))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _publish(rows: DataFrame, path: str, run: RunKey, replace: bool) -> int:
    """The number of rows written, counted by the write itself. A rerun without rows removes what the run had published."""
    seen = Observation()
    _write(rows.observe(seen, F.count("*").alias("n")), path, replace)
    written = seen.get["n"]
    if replace and not written:
        drop_partition(rows.sparkSession, path, {n: getattr(run, n) for n in PARTITION})
    return written


def publish_scores(
    scored: DataFrame, path: str, run: RunKey, replace: bool = True, index_path: str | None = None
) -> int:
    """Publish invoice scores; returns how many. Replacing touches only the run's own partition,
    custom windows each having their own; appending leaves older rows, which
    readers skip by taking the newest row per invoice. With `index_path` the
    publication's row goes to the index of publications."""
    written = _publish(conform(scored, SCORES, run), path, run, replace)
    if index_path is not None:
        spark = scored.sparkSession
        keys = {n: c.cast(PUBLICATIONS[n].dataType).alias(n) for n, c in run.columns().items()}
        keys |= {"total_invoices": F.lit(written).cast("bigint").alias("total_invoices"), "replaces": F.lit(replace).alias("replaces")}
        row = spark.range(1).select(*[keys[n] for n in PUBLICATIONS.names])
        row.coalesce(1).write.mode("append").parquet(index_path)
    return written


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The publications that have rows: of a partition the newest that replaced it, and what was appended since."""
    order = F.struct("published_at", "job_id")
    newest = F.max(F.when(F.col("replaces"), order)).over(W.partitionBy(*PARTITION))
    rows = read_table(spark, path, PUBLICATIONS).withColumn("_from", newest)
    return rows.where((F.col("_from").isNull() | (order >= F.col("_from"))) & (F.col("total_invoices") > 0)).drop("_from")


def drop_from_index(spark: SparkSession, path: str, jobs: DataFrame) -> None:
    """Take the rows of jobs out of the index, which has a row per publication."""
    rows = read_table(spark, path, PUBLICATIONS)
    kept = materialise(rows.join(jobs.select("job_id").distinct(), "job_id", "left_anti").select(*rows.columns), "index")
    kept.coalesce(1).write.mode("overwrite").parquet(path)


def publish_customer_risk(risk: DataFrame, path: str, run: RunKey, replace: bool = True) -> int:
    return _publish(conform(risk, CUSTOMER_RISK, run), path, run, replace)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def published_scores(
    spark: SparkSession, path: str, model_key: str | None = None, snapshot_date: str | None = None
) -> DataFrame:
    """The published table, cut to the partitions of a model and snapshot."""
    rows = read_table(spark, path, SCORES)
    if model_key is not None:
        rows = rows.where(F.col("model_key") == model_key)
    if snapshot_date is not None:
        rows = rows.where(F.col("snapshot_date") == F.lit(str(snapshot_date)).cast("date"))
    return rows


def latest_per_invoice(rows: DataFrame) -> DataFrame:
    """The newest published row of each invoice."""
    newest = W.partitionBy("CUSTOMER_TRX_ID").orderBy(F.desc("published_at"), F.desc("job_id"))
    return rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn")


def _cutoff(as_of: str, keep_days: int) -> Column:
    moment = dt.datetime.fromisoformat(str(as_of)) - dt.timedelta(days=keep_days)
    return F.lit(moment.isoformat(" ")).cast("timestamp")


def retain_published(rows: DataFrame, as_of: str, keep_days: int) -> DataFrame:
    """Rows published within the last `keep_days`; a negative number keeps all."""
    if keep_days < 0:
        return rows
    old = F.col("published_at") < _cutoff(as_of, keep_days)
    return rows.where(F.coalesce(~old, F.lit(True)))


def drop_expired(spark: SparkSession, path: str, schema: T.StructType, as_of: str, keep_days: int) -> None:
    """retain_published in place: partitions that are old as a whole go, and only those that appends have mixed are rewritten."""
    if keep_days < 0:
        return
    rows = read_table(spark, path, schema)
    cutoff = _cutoff(as_of, keep_days)
    # One row per partition, that is, per published run.
    found = rows.groupBy(*PARTITION).agg(
        F.coalesce(F.max("published_at") < cutoff, F.lit(False)).alias("whole"),
        F.coalesce(F.min("published_at") < cutoff, F.lit(False)).alias("part"),
        F.count_if(F.col("published_at").isNull()).alias("undated")).where("part").collect()
    for r in found:
        if r["whole"] and not r["undated"]:
            drop_partition(spark, path, r.asDict())
        else:
            mixed = retain_published(rows.where(_of_partition(r)), as_of, keep_days)
            _write(materialise(mixed, "retained"), path, True)


def _of_partition(values) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.lit(values[n])) for n in PARTITION])


def drop_jobs(spark: SparkSession, path: str, schema: T.StructType, jobs: DataFrame) -> None:
    """Remove the rows of jobs in place: partitions that are theirs as a whole go, only shared ones are rewritten."""
    rows = read_table(spark, path, schema)
    old = jobs.select("job_id").distinct()
    # A row for each partition that changes, that is, for each expired run.
    found = rows.join(old.withColumn("_old", F.lit(True)), "job_id", "left").groupBy(*PARTITION).agg(
        F.count("_old").alias("old"), F.count("*").alias("n")).where("old > 0").collect()
    for r in found:
        if r["old"] == r["n"]:
            drop_partition(spark, path, r.asDict())
        else:
            kept = rows.where(_of_partition(r)).join(old, "job_id", "left_anti").select(*rows.columns)
            _write(materialise(kept, "retained"), path, True)


def expired_runs(runs: DataFrame, as_of: str, keep_days: int) -> DataFrame:
    return runs.where(F.col("started_at") < _cutoff(as_of, keep_days))


def retain_runs(
    runs: DataFrame, scores: DataFrame, risk: DataFrame, as_of: str, keep_days: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop old runs and, by job id, their rows in both result tables."""
    old = expired_runs(runs, as_of, keep_days).select("job_id")

    def without(rows: DataFrame) -> DataFrame:
        return rows.join(old, "job_id", "left_anti").select(*rows.columns)

    return without(runs), without(scores), without(risk)


def rewrite(rows: DataFrame, new_path: str) -> None:
    """Store a retained table beside the old one; the caller switches over."""
    rows.write.partitionBy(*PARTITION).mode("errorifexists").parquet(new_path)


def export_csv(rows: DataFrame, path: str) -> None:
    """All columns but technical ones, with a header, dates as YYYY-MM-DD."""
    out = rows.drop("id", "_rn")
    out.write.options(header=True, escape='"', dateFormat="yyyy-MM-dd").mode("errorifexists").csv(path)


def json_records(rows: DataFrame) -> DataFrame:
    """One JSON object per row, missing values written as null."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


