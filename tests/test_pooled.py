"""The pooled variant beside the history features, and what a large job leaves on disk."""

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from duesight.checks.fixtures import SNAPSHOT, raw_tables
from duesight.operators import skew as sk
from duesight.plans import features as pf
from duesight.session import materialise


@pytest.fixture
def raw(spark, sf_dir):
    """Long histories: nine parties, of which one is -1 itself, and invoices without a party or a date."""
    made, key = raw_tables(spark, sf_dir), F.col("CUSTOMER_TRX_ID")
    party = F.when(key % 7 != 0, F.pmod(key, F.lit(9)) - 1)
    return replace(made, invoice=made.invoice.withColumn("PARTY_ID", party).withColumn(
        "TRX_DATE", F.when(key % 50 != 0, F.col("TRX_DATE"))))


def rows(df):
    return {r["CUSTOMER_TRX_ID"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("hot_rows", [sk.HOT_ROWS, 60])
def test_only_the_pool_is_put_in_order_again(raw, monkeypatch, hot_rows):
    skew, measure, write, written = pf.party_skew(raw), sk.measure_skew, sk.materialise, {}

    def counted(df, name):
        made = write(df, name)
        written[name] = made.count()
        return made

    want = rows(pf.pooled_snapshot_features(raw, SNAPSHOT, skew))
    monkeypatch.setattr(sk, "materialise", counted)
    monkeypatch.setattr(pf, "TASK_ROWS", 0, raising=False)
    monkeypatch.setattr(pf, "measure_skew", lambda *a, **k: measure(*a, hot_rows=hot_rows, chunk_rows=50, **k))
    split = pf.pooled_snapshot_features(raw, SNAPSHOT, skew)
    got = rows(split)
    assert got.keys() == want.keys() and split.columns == list(next(iter(want.values())))
    for key, row in want.items():
        if hot_rows < sk.HOT_ROWS:
            row = {n: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for n, v in row.items()}
        assert got[key] == row
    pool = sum(r["PARTY_ID"] in (None, -1) for r in got.values())
    assert written.get("chunks", 0) == (pool if hot_rows < sk.HOT_ROWS else 0) and 0 < pool < len(got)


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size())}

    before = {f for f in files() if f.startswith("shuffle_")}
    made = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert made.count() == 7
    made.groupBy("count").agg(F.max("k")).collect()  # a later job's files stay while it may be asked again
    for _ in range(50):
        left = {f.split("_")[1] for f in files() if f.startswith("shuffle_")} - {f.split("_")[1] for f in before}
        if len(left) <= 2:
            break
        time.sleep(0.2)
    # made.count() and the last aggregate shuffle once each; the write's shuffle is gone.
    assert len(left) <= 2
