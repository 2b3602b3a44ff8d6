"""What the stored tables of a streamed run leave on disk."""

import time
from dataclasses import replace

from pyspark.sql import functions as F

from duesight.checks.fixtures import raw_tables
from duesight.session import scratch_path
from duesight.sources.by_party import PartyTables
from duesight.streaming.party_state import PartyState


def shuffles(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(k).getName() for k in range(found.size()))
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


def left_by(spark, write):
    before = shuffles(spark)
    write()
    for _ in range(50):  # files go in the background
        if not (left := shuffles(spark) - before):
            break
        time.sleep(0.2)
    return left


def test_tables_by_party_and_states_leave_no_shuffle_files(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    raw = replace(raw, invoice=raw.invoice.limit(50), receipt=raw.receipt.limit(50))
    tables = PartyTables(spark, scratch_path(spark, "by-party"), raw.customer, parts=2)
    assert left_by(spark, lambda: tables.write(raw)) == set()
    state = PartyState(spark, scratch_path(spark, "state"), parts=2)
    starts = raw.invoice.groupBy("PARTY_ID").agg(F.max("TRX_DATE").cast("date").alias("_start"))
    assert left_by(spark, lambda: state.write("replays", starts, 0)) == set()
