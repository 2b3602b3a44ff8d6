"""Counters come from the pass that a job makes anyway."""

from dataclasses import replace

from pyspark.sql import functions as F

from duesight.checks.fixtures import SNAPSHOT, raw_tables, text_invoices
from duesight.operators.quality import Quality
from duesight.plans.jobs import run_snapshot, score_snapshot
from duesight.session import scratch_path


def test_a_job_returns_its_counters(spark, sf_dir):
    raw = replace(raw_tables(spark, sf_dir), invoice=text_invoices(spark, sf_dir), quality=Quality())
    n = raw.invoice.count(), raw.receipt.count()
    bad = raw.invoice.where("CUSTOMER_TRX_ID = 'abc'").count()
    scored = score_snapshot(raw, SNAPSHOT)
    plain = score_snapshot(replace(raw, quality=None), SNAPSHOT)
    names = ["CUSTOMER_TRX_ID", "prob_bad_debt"]
    assert sorted(map(repr, scored.select(names).collect())) == sorted(map(repr, plain.select(names).collect()))
    found = raw.quality.counts()
    assert (found["invoice_rows"], found["receipt_rows"]) == n and found["bad_ids"] == bad > 0
    assert found["bad_repairs"] >= 0 and found["null_amounts"] == 0


def test_a_run_counts_what_it_works_on(spark, sf_dir):
    raw = replace(raw_tables(spark, sf_dir), quality=Quality())
    run_snapshot(spark, raw, SNAPSHOT, "all", scratch_path(spark, "q-scores"), scratch_path(spark, "q-risk"), "j", "2000-07-01 06:00:00")
    known = raw.invoice.where(F.col("TRX_DATE") <= F.lit(SNAPSHOT).cast("timestamp")).count()
    assert raw.quality.counts()["invoice_rows"] == known
