"""The receipt stream: repeats are dropped, late receipts are not."""

import datetime as dt

from duesight.checks.fixtures import SNAPSHOT, raw_tables
from duesight.schemas import RECEIPT, SCORES
from duesight.session import scratch_path
from duesight.sinks.publish import RunKey, read_table
from duesight.streaming.receipt_trigger import receipt_stream, rescore_batch, start_trigger

JUNE, JANUARY = dt.datetime(2000, 6, 10), dt.datetime(1990, 1, 10)
BATCHES = [
    [(1, JUNE, JUNE, 5.0, "APP"), (1, JUNE, JUNE, 5.0, "APP"), (2, JUNE, None, 5.0, None)],
    # A repeat, one that differs in its amount, and one booked ten years before.
    [(1, JUNE, JUNE, 5.0, "APP"), (1, JUNE, JUNE, 6.0, "APP"), (3, JANUARY, JANUARY, 5.0, "APP"), (None, None, None, None, None)],
    [(2, JUNE, None, 5.0, None), (None, None, None, None, None)],
]


def arrivals(spark, **options):
    """The rows of each batch that has any. Each batch is a query of its own, as between daily triggers."""
    folder, checkpoint, seen = scratch_path(spark, "in"), scratch_path(spark, "cp"), []

    def handle(batch, number):
        if rows := batch.collect():
            seen.append(sorted(map(tuple, rows), key=repr))

    for rows in BATCHES:
        spark.createDataFrame(rows, RECEIPT).coalesce(1).write.mode("append").json(folder)
        start_trigger(receipt_stream(spark, folder, **options), handle, checkpoint).awaitTermination()
    return seen


def test_repeats_are_dropped_however_late_a_receipt_is_booked(spark):
    first, second, _ = BATCHES
    assert arrivals(spark) == [sorted(set(first), key=repr), sorted(second[1:], key=repr)]


def test_every_copy_comes_if_asked_for(spark):
    assert arrivals(spark, repeats_within=None) == [sorted(rows, key=repr) for rows in BATCHES]


def test_a_batch_without_rows_publishes_nothing(spark, sf_dir):
    raw, path = raw_tables(spark, sf_dir), scratch_path(spark, "scores")
    served = RunKey("job", "stacked", SNAPSHOT, "all", "2000-07-01 00:00:00")

    def unread():
        raise AssertionError("the tables are read")

    rescore_batch(unread, SNAPSHOT, path, served)(raw.receipt.limit(0), 0)
    folder, checkpoint, numbers = scratch_path(spark, "in"), scratch_path(spark, "cp"), []
    handle = rescore_batch(lambda: raw, SNAPSHOT, path, served, lambda: numbers.append(0) or dt.datetime(2000, 7, 2))
    paid = raw.receipt.where("RECEIPT_DATE BETWEEN '2000-06-01' AND '2000-06-07'")
    for _ in range(2):  # the same receipts twice
        paid.write.mode("append").json(folder)
        start_trigger(receipt_stream(spark, folder), handle, checkpoint).awaitTermination()
    assert len(numbers) == 1
    assert read_table(spark, path, SCORES).select("job_id").distinct().count() == 1
