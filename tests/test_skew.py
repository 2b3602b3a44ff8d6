"""Hot parties, hot invoices and copies: same results, and plans that spread them."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from duesight.checks.fixtures import SNAPSHOT, raw_tables
from duesight.functions.cleaning import keep_first
from duesight.operators.history import invoice_history, pooled_history
from duesight.operators.ledger import invoice_core
from duesight.operators.receipts import base_payments, payment_facts
from duesight.operators.skew import NO_SKEW, Skew, exact_sum, lookup_join, measure_skew, running
from duesight.plans.features import RawTables, snapshot_features


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _same(left, right):
    """Equal rows by invoice id; doubles up to the order of summing."""
    names = sorted(left.columns)
    assert names == sorted(right.columns)
    mine, theirs = [{r["CUSTOMER_TRX_ID"]: r for r in df.collect()} for df in (left, right)]
    assert set(mine) == set(theirs)
    for key, row in mine.items():
        for name in names:
            x, y = row[name], theirs[key][name]
            both = isinstance(x, float) and isinstance(y, float)
            assert x == y or (both and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (key, name, x, y)


@pytest.fixture(scope="module")
def hot(spark, sf_dir):
    """The tables with a third of all invoices and receipts in one party."""
    raw = raw_tables(spark, sf_dir)
    third = F.when(F.col("CUSTOMER_TRX_ID") % 3 == 0, F.lit(5)).otherwise(F.col("PARTY_ID"))
    return RawTables(raw.invoice.withColumn("PARTY_ID", third), raw.receipt, raw.customer)


def test_measure(spark, hot):
    found = measure_skew(hot.invoice, "PARTY_ID", hot_rows=200)
    assert found.heavy and found.top_rows > 500 and found.total_rows == 2000 and not found.lanes
    assert not measure_skew(hot.invoice, "PARTY_ID").heavy
    assert not measure_skew(hot.invoice.limit(0), "PARTY_ID").heavy


def test_lanes_follow_the_counts(spark):
    """Each hot key has a lane per so many rows; which keys these are is never collected."""
    rows = spark.range(10_000).select(
        F.col("id"), F.when(F.col("id") < 5_000, 1).when(F.col("id") < 7_500, 2).when(F.col("id") < 7_600, None).otherwise(
            F.col("id")).alias("k"), F.when(F.col("id") % 2 == 0, "x").otherwise(F.col("id").cast("string")).alias("name"))
    skew = measure_skew(rows, "k", "name", lane_rows=1_000)
    lanes = {tuple(r) for r in skew.lanes["k"].table.collect()}
    assert lanes == {(1, 5), (2, 3)} and [tuple(r) for r in skew.lanes["name"].table.collect()] == [("x", 5)]
    lookup = rows.where("k IS NOT NULL").select("k").distinct().select("k", (F.col("k") * 2).alias("found"))
    joined = lookup_join(rows, lookup, "k", "id", skew)
    assert joined.count() == 10_000 and joined.where("found = 2 * k").count() == 9_900
    most = joined.groupBy("k", "_lane").count().where("k IS NOT NULL").agg(F.max("count")).first()[0]
    assert 700 < most < 1_300
    assert joined.where("k IS NULL").select("_lane").distinct().count() == 100
    assert lookup_join(rows, lookup, "k", "id").count() == 10_000
    assert "isin" not in _plan(joined).lower() and measure_skew(rows, "k").lanes == {}


def test_hot_party_gives_the_same_features(hot):
    plain = snapshot_features(hot, SNAPSHOT, NO_SKEW)
    spread = snapshot_features(hot, SNAPSHOT, Skew(700, 2000, hot_rows=100, chunk_rows=64))
    lanes = measure_skew(hot.invoice, "PARTY_ID", "TRX_NUMBER", hot_rows=200, chunk_rows=100, lane_rows=50)
    assert lanes.heavy and "PARTY_ID" in lanes.lanes
    _same(plain, spread)
    _same(plain, snapshot_features(hot, SNAPSHOT, lanes))


def test_pooled_history_with_hot_party(hot):
    core = invoice_core(hot.invoice, hot.receipt, SNAPSHOT)
    facts = payment_facts(core, base_payments(hot.receipt, SNAPSHOT), SNAPSHOT, "AS_OF_DATE", "pre_due")
    rows = invoice_history(facts)
    _same(pooled_history(rows), pooled_history(rows, Skew(700, 2000, hot_rows=100, chunk_rows=150)))


def test_running_against_plain_python(spark):
    data = [(k, i, (i * 37 + k) % 101 if i % 4 else None) for k, n in ((1, 300), (2, 3), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(data, "k int, i int, v bigint")
    for skew in (NO_SKEW, Skew(300, 304, hot_rows=1, chunk_rows=8), Skew(300, 304, hot_rows=1, chunk_rows=31)):
        out = running(
            df, ["k"], ["i"], sums={"s": F.col("v").cast("double")}, counts={"n": F.col("v")},
            totals={"t": F.col("v")}, lows={"lo": F.col("v")}, medians={"m": F.col("v")}, skew=skew,
        )
        for r in out.collect():
            prior = sorted(v for k, i, v in data if k == r.k and i < r.i and v is not None)
            so_far = [v for k, i, v in data if k == r.k and i <= r.i and v is not None]
            half = len(prior) // 2
            median = None if not prior else prior[half] if len(prior) % 2 else (prior[half - 1] + prior[half]) / 2
            assert (r.s, r.t, r.n, r.lo, r.m) == (float(sum(prior)), sum(prior), len(prior), min(so_far, default=None), median)


def test_sums_do_not_depend_on_the_order(spark):
    rng = random.Random(4)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-3, 12) for _ in range(5_000)] + [None, float("inf")]
    found = set()
    for parts in (1, 3, 8):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
        found.add(df.agg(exact_sum(F.col("v"))).first()[0])
    assert len(found) == 1
    assert abs(found.pop() - sum(v for v in values if v is not None and abs(v) < 1e300)) < 1e-2
    assert spark.range(0).agg(exact_sum(F.col("id").cast("double"))).first()[0] is None


def test_running_median_of_a_huge_party(spark):
    """A million rows with three thousand values of one party, in both forms' seconds; a sample against sorting."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(3_000)).alias("v"))
    skew = measure_skew(df, "k")
    assert skew.heavy
    begin = time.perf_counter()
    out = running(df, ["k"], ["i"], medians={"m": F.col("v")}, skew=skew).where("i % 99991 = 7 OR i < 3").collect()
    assert time.perf_counter() - begin < 120
    values = [r[0] for r in df.orderBy("i").select("v").collect()]
    for r in out:
        prior = sorted(values[: r.i])
        half = len(prior) // 2
        assert r.m == (None if not prior else prior[half] if len(prior) % 2 else (prior[half - 1] + prior[half]) / 2)


def test_one_exchange_and_sort_for_all_history(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _plan(snapshot_features(raw, SNAPSHOT, NO_SKEW))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The rows reach the party window partitioned as the customer join left them.
    party = [line for line in plan.splitlines() if "Exchange hashpartitioning(PARTY_ID" in line]
    assert len(party) <= 3
    top = plan[plan.index("Window [sum(") :]
    between = top[: top.index("SortMergeJoin")]
    assert "Exchange" not in between and between.count("Window [") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_copies_collapse_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = _plan(keep_first(df, ["k"], ["v"]))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_hot_invoice_is_summed_before_its_shuffle(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    more = raw.receipt.limit(1).crossJoin(spark.range(5000)).drop("id")
    receipts = raw.receipt.unionByName(more)
    core = invoice_core(raw.invoice, receipts, SNAPSHOT)
    facts = payment_facts(core, base_payments(receipts, SNAPSHOT), SNAPSHOT, "AS_OF_DATE", "pre_due")
    assert facts.agg(F.max("receipt_count")).first()[0] >= 0
    plan = _plan(facts)
    assert "partial_sum(" in plan[plan.index("HashAggregate(keys=[INVOICE_ID#") :]


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    from duesight.sources.tables import invoices_in_range

    raw = raw_tables(spark, sf_dir)
    plan = _plan(invoices_in_range(raw.invoice, "3m", SNAPSHOT).select("CUSTOMER_TRX_ID"))
    assert "PushedFilters: [IsNotNull(TRX_DATE), GreaterThanOrEqual(TRX" in plan and "LessThanOrEqual(TRX" in plan
    assert "ReadSchema: struct<CUSTOMER_TRX_ID:bigint,TRX_DATE:timestamp>" in plan
