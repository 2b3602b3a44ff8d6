"""Receivables tables derived from the order tables, in Spark.

checks/oracle.py derives the same rows in SQL. Dates are midnight, UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duesight.plans.features import RawTables
from duesight.session import materialise

SNAPSHOT = "2000-06-30"
MEMO_BASE = 1_000_000_000
DUE_DAYS = {"1": 14, "2": 30, "3": 45, "4": 60, "5": 90}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def _after(day: Column, days: Column | int) -> Column:
    return day + F.make_dt_interval(days=F.lit(days) if isinstance(days, int) else days)


def _cents(hundredths: Column) -> Column:
    """Amount from a number of cents, rounded by plain arithmetic that every engine shares."""
    return F.floor(hundredths + 0.5).cast("double") / 100


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices, and a credit memo for a third of them."""
    orders = _orders(spark, sf_dir)
    key, amount, day = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate")
    due = F.lit(90)
    for digit, days in DUE_DAYS.items():
        due = F.when(F.left("o_orderpriority", F.lit(1)) == digit, days).otherwise(due)
    null_id, null_ts = F.lit(None).cast("bigint"), F.lit(None).cast("timestamp")
    rows = orders.select(
        key.alias("CUSTOMER_TRX_ID"),
        F.concat(F.lit("INV-"), key).alias("TRX_NUMBER"),
        F.when(key % 53 != 0, F.col("o_custkey")).alias("PARTY_ID"),
        day.alias("TRX_DATE"),
        _after(day, due).alias("DUE_DATE"),
        F.when(key % 101 == 0, 0.0).when(key % 103 == 0, -amount).otherwise(amount).alias("TRX_AMOUNT"),
        F.lit("INV").alias("TRANS_TYPE"),
        F.lit("IDR").alias("CURRENCY_CODE"),
        (key % 5).alias("ORG_ID"),
        null_id.alias("PREVIOUS_CUSTOMER_TRX_ID"),
    )
    memos = orders.where((key % 6).isin(0, 1)).select(
        (key + MEMO_BASE).alias("CUSTOMER_TRX_ID"),
        F.concat(F.lit("CM-"), key).alias("TRX_NUMBER"),
        F.col("o_custkey").alias("PARTY_ID"),
        _after(day, 20).alias("TRX_DATE"),
        null_ts.alias("DUE_DATE"),
        (-_cents(amount * 10)).alias("TRX_AMOUNT"),
        F.lit("CM").alias("TRANS_TYPE"),
        F.lit("IDR").alias("CURRENCY_CODE"),
        (key % 5).alias("ORG_ID"),
        key.alias("PREVIOUS_CUSTOMER_TRX_ID"),
    )
    return rows.unionByName(memos)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as payment applications, and one row per surviving memo."""
    orders = _orders(spark, sf_dir)
    lines = _read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    shift = (F.col("l_partkey") * 11 + F.col("l_suppkey") * 7 + F.col("l_linenumber") * 17) % 240
    day = _after(F.col("o_orderdate"), shift.cast("int"))
    far = F.add_months(F.to_date(day), 2400).cast("timestamp")
    rows = lines.select(
        F.col("l_orderkey").alias("APPLIED_CUSTOMER_TRX_ID"),
        F.when(F.col("l_suppkey") % 19 == 0, F.lit(None))
        .when(F.col("l_partkey") % 211 == 0, far)
        .otherwise(day)
        .alias("APPLY_DATE"),
        _after(day, 2).alias("RECEIPT_DATE"),
        _cents(F.col("o_totalprice") * F.col("l_quantity")).alias("AMOUNT_APPLIED"),
        F.when(F.col("l_returnflag") == "A", "APP").when(F.col("l_returnflag") == "R", "REV").alias("RECEIPT_STATUS"),
    )
    memo_day = _after(F.col("o_orderdate"), 20)
    memos = orders.where(F.col("o_orderkey") % 6 == 0).select(
        (F.col("o_orderkey") + MEMO_BASE).alias("APPLIED_CUSTOMER_TRX_ID"),
        memo_day.alias("APPLY_DATE"),
        memo_day.alias("RECEIPT_DATE"),
        F.lit(0.0).alias("AMOUNT_APPLIED"),
        F.lit("APP").alias("RECEIPT_STATUS"),
    )
    return rows.unionByName(memos)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows per party; some parties are missing."""
    orders = _orders(spark, sf_dir).where((F.col("o_orderkey") % 7 != 0) & (F.col("o_custkey") % 29 != 0))
    names = _read(spark, sf_dir, "customer")
    return orders.join(names, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("PARTY_ID"),
        F.when(F.col("c_custkey") % 13 != 0, F.concat(F.lit("ACC-"), F.col("c_custkey"))).alias("ACCOUNT_NUMBER"),
        F.concat(F.lit("INV-"), F.col("o_orderkey")).alias("TRX_NUMBER"),
        F.col("c_name").alias("CUSTOMER_NAME"),
        F.col("c_mktsegment").alias("BU_NAME"),
    )


def excluded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affiliate names in two columns, spelled differently on purpose, with junk cells."""
    names = _read(spark, sf_dir, "customer").where(F.col("c_custkey") % 41 == 0)
    key, name = F.col("c_custkey"), F.col("c_name")
    return names.select(
        F.when(key % 3 == 0, F.lower(name))
        .when(key % 3 == 1, F.regexp_replace(name, "#", " # "))
        .otherwise(F.concat(name, F.lit(".")))
        .alias("_c0"),
        F.when(key % 2 == 0, "0").otherwise("").alias("_c1"),
    )


_stored: dict[tuple[str, str], RawTables] = {}


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """The three tables as stored Parquet, written once per session and source folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        tables = [
            materialise(make(spark, sf_dir), make.__name__) for make in (invoices, receipts, customers)
        ]
        _stored[key] = RawTables(*tables)
    return _stored[key]


def text_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices as delivered: all text, with a few odd ids and dates."""
    key = F.col("CUSTOMER_TRX_ID")
    day = F.when(key % 97 == 1, F.date_format("TRX_DATE", "d-MMM-yyyy")).otherwise(
        F.date_format("TRX_DATE", "dd-MMM-yyyy")
    )
    return invoices(spark, sf_dir).select(
        F.when(key % 89 == 0, "abc")
        .when(key % 83 == 0, F.concat(key.cast("string"), F.lit(".0")))
        .otherwise(key.cast("string"))
        .alias("CUSTOMER_TRX_ID"),
        "TRX_NUMBER",
        F.col("PARTY_ID").cast("string"),
        F.when(key % 97 == 0, "junk").otherwise(day).alias("TRX_DATE"),
        F.date_format("DUE_DATE", "dd-MMM-yyyy").alias("DUE_DATE"),
        F.col("TRX_AMOUNT").cast("string"),
        "TRANS_TYPE",
        "CURRENCY_CODE",
        F.col("ORG_ID").cast("string"),
        F.col("PREVIOUS_CUSTOMER_TRX_ID").cast("string"),
    )


def text_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = "yyyy-MM-dd'T'00:00:00.000+00:00"
    return receipts(spark, sf_dir).select(
        F.col("APPLIED_CUSTOMER_TRX_ID").cast("string"),
        F.date_format("APPLY_DATE", iso).alias("APPLY_DATE"),
        F.date_format("RECEIPT_DATE", iso).alias("RECEIPT_DATE"),
        F.col("AMOUNT_APPLIED").cast("string"),
        "RECEIPT_STATUS",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run catalogue: one run per order, over several models, ranges, days and outcomes."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    ranges = F.array(*[F.lit(r) for r in ("1w", "2w", "1m", "3m", "6m", "1y", "all", "custom")])
    pick = (key % 8 + 1).cast("int")
    custom = key % 8 == 7
    start = F.trunc(F.to_date(day), "month")
    failed = key % 10 == 3
    running = key % 10 == 6
    done = F.when(~running, day + F.make_dt_interval(hours=F.lit(6), mins=(key % 60).cast("int")))
    return _orders(spark, sf_dir).select(
        F.concat(F.lit("job-"), key).alias("job_id"),
        F.when(failed, "failed").when(running, "running").otherwise("completed").alias("status"),
        F.when(key % 3 == 0, "lgbm_hyper_smote").otherwise("stacked").alias("model_key"),
        F.last_day(F.to_date(day)).alias("snapshot_date"),
        F.element_at(ranges, pick).alias("time_range"),
        F.when(custom, start).alias("start_date"),
        F.when(custom, F.date_add(start, (key % 5).cast("int") * 7)).alias("end_date"),
        (key % 1000).alias("total_invoices"),
        (key % 100).alias("total_customers"),
        F.to_json(F.struct((key % 7).alias("HIGH"), (key % 11).alias("LOW"))).alias("risk_summary_json"),
        F.to_json(F.struct((key % 5).alias("HIGH"))).alias("customer_risk_summary_json"),
        F.when(failed, "no rows").alias("error_message"),
        day.alias("started_at"),
        done.alias("completed_at"),
        F.when(~running, (key % 600).cast("double")).alias("duration_sec"),
    )
