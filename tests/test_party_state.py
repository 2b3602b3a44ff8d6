"""Receipts that go on from stored party states, against full runs."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from duesight.checks.fixtures import SNAPSHOT, raw_tables
from duesight.operators import skew as sk
from duesight.operators.scoring import score_table
from duesight.plans.features import RawTables
from duesight.plans.jobs import score_snapshot
from duesight.schemas import SCORES
from duesight.session import materialise, scratch_path
from duesight.sinks.publish import RunKey, latest_per_invoice, publish_scores, read_table
from duesight.streaming import party_state as ps
from duesight.streaming.receipt_trigger import surviving_memos, touched_invoices

SERVED = RunKey("job", "stacked", SNAPSHOT, "all", "2000-07-01 00:00:00")
COLUMNS = ["CUSTOMER_TRX_ID", "TRX_AMOUNT", "prob_bad_debt", "risk_level", "expected_financial_loss"]


def few_parties(spark, sf_dir, n):
    """All invoices as those of a few parties, so that histories are long; every fiftieth without a date."""
    raw = raw_tables(spark, sf_dir)
    party = F.when(F.col("PARTY_ID").isNotNull(), F.pmod("PARTY_ID", F.lit(n)))
    day = F.when(F.col("CUSTOMER_TRX_ID") % 50 != 0, F.col("TRX_DATE"))
    invoice = raw.invoice.withColumn("PARTY_ID", party).withColumn("TRX_DATE", day)
    return RawTables(materialise(invoice, "invoice"), materialise(raw.receipt, "receipt"), raw.customer)


def rows(df):
    return sorted(map(repr, df.select(COLUMNS).collect()))


@pytest.mark.parametrize("hot_rows", [sk.HOT_ROWS, 60])
def test_batches_give_what_a_full_run_gives(spark, sf_dir, monkeypatch, hot_rows):
    """Late receipts of some invoices, batch after batch, the second one twice; in the plain form bit by bit."""
    chunked = hot_rows < sk.HOT_ROWS
    if chunked:
        monkeypatch.setattr(ps, "party_skew", lambda raw: sk.measure_skew(raw.invoice, "PARTY_ID", hot_rows=hot_rows, chunk_rows=50))
    raw, path = few_parties(spark, sf_dir, 9), scratch_path(spark, "scores")
    recent = raw.invoice.where("TRX_DATE >= DATE'1999-06-01' AND PARTY_ID IS NOT NULL").select("CUSTOMER_TRX_ID")
    ids = [r[0] for r in raw.receipt.join(recent, raw.receipt["APPLIED_CUSTOMER_TRX_ID"] == recent["CUSTOMER_TRX_ID"], "left_semi")
           .select("APPLIED_CUSTOMER_TRX_ID").distinct().orderBy("APPLIED_CUSTOMER_TRX_ID").limit(6).collect()]
    undated = raw.receipt.where("APPLIED_CUSTOMER_TRX_ID % 50 = 0").first()["APPLIED_CUSTOMER_TRX_ID"]
    batches = [ids[:2], ids[2:5], [ids[5], undated]]
    late = F.col("APPLIED_CUSTOMER_TRX_ID").isin([*ids, undated])
    held = replace(raw, receipt=raw.receipt.where(~F.coalesce(late, F.lit(False))))
    state = ps.PartyState(spark, scratch_path(spark, "state"), parts=4)
    publish_scores(ps.score_and_store(state, held, SNAPSHOT), path, SERVED)
    if not chunked:
        assert rows(read_table(spark, path, SCORES)) == rows(score_table(score_snapshot(held, SNAPSHOT)))
    for step, number in enumerate((0, 1, 1, 2)):
        arrived = raw.receipt.where(F.col("APPLIED_CUSTOMER_TRX_ID").isin(batches[number]))
        if step != 2:  # the repeated batch
            held = replace(held, receipt=held.receipt.unionByName(arrived))
        handle = ps.replay_batch(lambda: held, state, SNAPSHOT, path, SERVED, True, lambda: dt.datetime(2000, 7, 2))
        handle(arrived, number)
        replayed = read_table(spark, path, SCORES).where(F.col("job_id") == f"stream-{number:019d}").count()
        touched = touched_invoices(arrived, raw.invoice).where("_is_target").count()
        assert 0 < replayed < touched * (2 if number == 1 else 1)
    got = latest_per_invoice(read_table(spark, path, SCORES))
    want = score_table(score_snapshot(raw, SNAPSHOT))
    if not chunked:
        assert rows(got) == rows(want)
    else:
        both = got.join(want.select("CUSTOMER_TRX_ID", F.col("prob_bad_debt").alias("p")), "CUSTOMER_TRX_ID")
        assert both.count() == want.count() == got.count()
        assert both.where(F.abs(F.col("p") - F.col("prob_bad_debt")) > 1e-9).isEmpty()


def test_a_receipt_that_hits_nothing(spark, sf_dir):
    raw, path = raw_tables(spark, sf_dir), scratch_path(spark, "scores")
    state = ps.PartyState(spark, scratch_path(spark, "state"), parts=2)
    ps.score_and_store(state, replace(raw, invoice=raw.invoice.limit(0)), SNAPSHOT)
    handle = ps.replay_batch(lambda: raw, state, SNAPSHOT, path, SERVED, True, lambda: dt.datetime(2000, 7, 2))
    handle(raw.receipt.limit(1).withColumn("APPLIED_CUSTOMER_TRX_ID", F.lit(-5).cast("bigint")), 0)
    assert read_table(spark, path, SCORES).count() == 0


def test_the_first_memo_asks_for_a_full_run(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    assert surviving_memos(raw)
    handle = ps.replay_batch(lambda: raw, ps.PartyState(spark, scratch_path(spark, "s")), SNAPSHOT, "unused", SERVED, False)
    with pytest.raises(ValueError):
        handle(raw.receipt.limit(1), 0)


def test_the_stream_is_stored_without_facts_that_nothing_reads(spark, sf_dir, monkeypatch):
    stored, write = {}, ps.materialise
    monkeypatch.setattr(ps, "materialise", lambda df, name: stored.setdefault(name, df.columns) and write(df, name))
    raw = few_parties(spark, sf_dir, 40)
    ps.score_and_store(ps.PartyState(spark, scratch_path(spark, "state"), parts=4), raw, SNAPSHOT)
    assert not {"CURRENCY_CODE", "AS_OF_DATE", "total_paid", "is_late"} & set(stored["stream"])
