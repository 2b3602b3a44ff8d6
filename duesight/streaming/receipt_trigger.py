"""Re-score the parties that new receipts touch.

A file stream of receipts, however late they are booked: exact repeats that arrive
within the watermark are dropped, and each micro-batch scores the touched parties
again from the full tables and appends them to the run that is served, as a newer
publication. The watermark follows the arrival, not the dates of a receipt, so it
makes none too late. Rescoring takes the copies of a receipt as one, so a repeat
changes no score. A repeated batch appends the same rows, of which readers take one
per invoice; a batch without rows publishes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duesight.operators.invoices import clean_invoices, drop_unpaid_nonpositive
from duesight.operators.ledger import TARGET
from duesight.operators.scoring import Model, score_table
from duesight.operators.targets import history_of_parties, receipts_of
from duesight.plans.features import RawTables
from duesight.plans.jobs import score_snapshot
from duesight.schemas import RECEIPT
from duesight.session import materialise
from duesight.sinks.publish import RunKey, publish_scores


def receipt_stream(
    spark: SparkSession, folder: str, files_per_batch: int = 100, repeats_within: str | None = "7 days"
) -> DataFrame:
    """Receipts as they arrive, without those that equal, in all columns, one that arrived within the span before.

    `repeats_within` None lets every copy through, for a handler that keeps the receipts themselves.
    """
    rows = spark.readStream.schema(RECEIPT).option("maxFilesPerTrigger", files_per_batch).json(folder)
    if repeats_within is None:
        return rows
    # The time of the batch, which the query's log fixes: a batch that is run again drops the same rows.
    arrived = rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", repeats_within)
    return arrived.dropDuplicatesWithinWatermark(RECEIPT.names).drop("_arrived")


def hit_invoices(receipts: DataFrame, invoice: DataFrame) -> DataFrame:
    """CUSTOMER_TRX_ID, PARTY_ID, PREVIOUS_CUSTOMER_TRX_ID of the invoices that got a receipt, and of those whose memo did."""
    paid = receipts.select(F.col("APPLIED_CUSTOMER_TRX_ID").alias("CUSTOMER_TRX_ID")).distinct()
    narrow = invoice.select("CUSTOMER_TRX_ID", "PARTY_ID", "PREVIOUS_CUSTOMER_TRX_ID")
    hit = narrow.join(paid, "CUSTOMER_TRX_ID", "left_semi")
    originals = hit.select(F.col("PREVIOUS_CUSTOMER_TRX_ID").alias("CUSTOMER_TRX_ID")).where(
        F.col("CUSTOMER_TRX_ID").isNotNull()).distinct()
    return hit.unionByName(narrow.join(originals, "CUSTOMER_TRX_ID", "left_semi"))


def touched_invoices(receipts: DataFrame, invoice: DataFrame, hit: DataFrame | None = None) -> DataFrame:
    """All invoices of the parties whose invoices got a receipt, and those without a party themselves; TARGET is true.

    A receipt of a credit memo also touches the invoice that the memo is netted with. Memos of touched invoices that
    belong to other parties, or to none, come along for the netting only: their TARGET is false.
    """
    both = hit_invoices(receipts, invoice) if hit is None else hit
    parties = both.select("PARTY_ID").where(F.col("PARTY_ID").isNotNull()).distinct()
    alone = both.where(F.col("PARTY_ID").isNull()).select("CUSTOMER_TRX_ID").distinct()
    without = invoice.where(F.col("PARTY_ID").isNull()).join(alone, "CUSTOMER_TRX_ID", "left_semi")
    touched = history_of_parties(invoice, parties).unionByName(without.select(*invoice.columns))
    ids = touched.select(F.col("CUSTOMER_TRX_ID").alias("_id")).where(F.col("_id").isNotNull()).distinct()
    memos = invoice.where(F.col("PREVIOUS_CUSTOMER_TRX_ID").isNotNull())
    context = memos.join(ids, F.col("PREVIOUS_CUSTOMER_TRX_ID") == F.col("_id"), "left_semi").join(
        ids, F.col("CUSTOMER_TRX_ID") == F.col("_id"), "left_anti").select(*invoice.columns)
    return touched.withColumn(TARGET, F.lit(True)).unionByName(context.withColumn(TARGET, F.lit(False)))


def surviving_memos(tables: RawTables) -> bool:
    """Whether the whole table has credit memos that count; stops at the first."""
    memos = clean_invoices(tables.invoice).where(F.col("PREVIOUS_CUSTOMER_TRX_ID").isNotNull())
    return not drop_unpaid_nonpositive(memos, tables.receipt).isEmpty()


def rescore_batch(
    source: Callable[[], RawTables], snapshot: str, scores_path: str, served: RunKey,
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
    model: Model | None = None,
) -> Callable[[DataFrame, int], None]:
    """Handler for foreachBatch. The tables are read anew, as they hold the receipts by then.

    The rows are appended under the key of the run that is served, with the
    batch's own time and number, so that reports show them at once and the
    latest batch wins.
    """

    def handle(batch: DataFrame, number: int) -> None:
        # Written out: the stream's state allows one pass over a batch, the invoices are read several times.
        batch = materialise(batch.select("APPLIED_CUSTOMER_TRX_ID").distinct(), "batch")
        if batch.isEmpty():  # all repeats, or a batch that only moves the watermark
            return
        tables = source()
        invoices = materialise(touched_invoices(batch, tables.invoice), "touched")
        # What the batch nets with is part of the whole; whether amounts are cut at zero is up to the whole.
        memos = surviving_memos(tables)
        raw = RawTables(invoices, receipts_of(tables.receipt, invoices), tables.customer, has_memos=memos)
        scored = score_table(score_snapshot(raw, snapshot, model))
        # Of one moment's batches the larger number sorts last as text, too.
        run = replace(served, job_id=f"stream-{number:019d}", published_at=clock().isoformat(" "))
        publish_scores(scored, scores_path, run, replace=False)

    return handle


def start_trigger(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
