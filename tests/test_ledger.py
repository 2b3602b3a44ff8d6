"""The composed ledger against its steps, its plan, and what streams pass in."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from duesight.checks.fixtures import SNAPSHOT, raw_tables
from duesight.functions.cleaning import as_of
from duesight.operators.invoices import clean_invoices, drop_unpaid_nonpositive, net_credit_memos, one_per_id
from duesight.operators.ledger import TARGET, invoice_core, ledger, receipt_days, with_payment_facts
from duesight.operators.receipts import base_payments, payment_facts
from duesight.operators.targets import restrict_to_targets, run_inputs
from duesight.plans.features import RawTables, pooled_snapshot_features, snapshot_features


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """The tables with copies of rows, among them positive and negative ones of one id, ids and amounts that are missing,
    memos of memos and of nothing, and receipts of one day."""
    raw = raw_tables(spark, sf_dir)
    inv = raw.invoice
    copies = inv.where("CUSTOMER_TRX_ID % 5 = 0").withColumns({
        "TRX_AMOUNT": -F.col("TRX_AMOUNT") - 3, "TRX_DATE": F.col("TRX_DATE") - F.make_dt_interval(days=F.lit(2))})
    blank = inv.where("CUSTOMER_TRX_ID % 11 = 0").withColumn("CUSTOMER_TRX_ID", F.lit(None).cast("bigint"))
    unknown = inv.where("CUSTOMER_TRX_ID % 13 = 0").withColumns({
        "TRX_AMOUNT": F.lit(None).cast("double"), "TRX_DATE": F.lit(None).cast("timestamp")})
    chained = inv.where("CUSTOMER_TRX_ID % 17 = 0").withColumn("PREVIOUS_CUSTOMER_TRX_ID", F.col("CUSTOMER_TRX_ID") + 1)
    twice = raw.receipt.where("APPLIED_CUSTOMER_TRX_ID % 3 = 0")
    invoice = inv.unionByName(copies).unionByName(blank).unionByName(unknown).unionByName(chained)
    return RawTables(invoice, raw.receipt.unionByName(twice), raw.customer)


def test_ledger_is_what_its_steps_give(odd):
    surviving = drop_unpaid_nonpositive(clean_invoices(odd.invoice), odd.receipt)
    core = net_credit_memos(one_per_id(surviving), surviving, SNAPSHOT).withColumn("AS_OF_DATE", as_of(F.col("DUE_DATE"), SNAPSHOT))
    assert _rows(invoice_core(odd.invoice, odd.receipt, SNAPSHOT)) == _rows(core)
    wanted = payment_facts(core, base_payments(odd.receipt, SNAPSHOT), SNAPSHOT, "AS_OF_DATE", "pre_due")
    got = with_payment_facts(ledger(odd.invoice, odd.receipt, SNAPSHOT), SNAPSHOT, "AS_OF_DATE", "pre_due")
    cents = [c for c, t in wanted.dtypes if t == "double"]
    rounded = {c: F.round(c, 6) for c in cents}
    assert _rows(got.withColumns(rounded)) == _rows(wanted.withColumns(rounded))


def test_no_memo_leaves_amounts_uncut(odd, spark):
    alone = odd.invoice.where("PREVIOUS_CUSTOMER_TRX_ID IS NULL AND TRX_AMOUNT < 0")
    free = ledger(alone, odd.receipt, SNAPSHOT)
    assert free.where("TRX_AMOUNT < 0").count() > 0
    assert ledger(alone, odd.receipt, SNAPSHOT, has_memos=True).where("TRX_AMOUNT < 0").isEmpty()
    assert free.where("credit_memo_reduction <> 0").isEmpty()


def _ran(df):
    """The plan as it ran, with the exchanges that were used again."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = _plan(df)
    return plan[plan.index("== Final Plan ==") : plan.rindex("== Initial Plan ==")]


def test_scans_of_the_composed_plan(spark, sf_dir):
    """Two invoice scans (rows, and memos with four columns) and one receipt scan; wide rows move by id once."""
    raw = raw_tables(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _ran(snapshot_features(raw, SNAPSHOT))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    body = [line for line in plan.splitlines()]
    first = next((k for k, line in enumerate(body) if re.match(r"[ :+-]*Subquery ", line)), None)
    if first is not None:  # what the subquery for "are there memos" shows is the exchange that the rows use
        depth = len(body[first]) - len(body[first].lstrip(" :+-"))
        last = next(k for k in range(first + 1, len(body)) if len(body[k]) - len(body[k].lstrip(" :+-")) <= depth)
        assert any("ReusedExchange" in line for line in body[first:last])
        body = body[:first] + body[last:]
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", "\n".join(body))
    invoices = [s for s in scans if "TRX_AMOUNT#" in s]
    assert sorted(s.count(",") for s in invoices) == [3, 8], scans
    assert sum("AMOUNT_APPLIED#" in s for s in scans) == 1, scans
    assert any("ReusedExchange" in line for line in body)


def test_pooled_variant_reads_its_facts_once(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    scans = _plan(pooled_snapshot_features(raw, SNAPSHOT)).count("FileScan parquet")
    assert scans <= _plan(snapshot_features(raw, SNAPSHOT)).count("FileScan parquet")


def test_targets_carry_a_flag(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    got = run_inputs(raw, "6m", SNAPSHOT)
    rows = snapshot_features(got, SNAPSHOT)
    flagged = restrict_to_targets(rows, got.target_ids)
    joined = restrict_to_targets(rows.drop(TARGET), got.target_ids)
    assert _rows(flagged) == _rows(joined) and flagged.count() < rows.count()
    assert "LeftSemi" not in _plan(flagged).split("Window")[0]


def test_memos_read_lists_that_are_not_put_in_order(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    plan = ledger(raw.invoice, raw.receipt, SNAPSHOT, has_memos=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and "array_sort(" not in plan


def test_receipt_lists_are_in_order_of_days(spark):
    rows = [(1, f"2000-03-{d:02d}", None, float(a), None) for d, a in ((9, 1), (2, -3), (9, 4), (5, 0))]
    names = "APPLIED_CUSTOMER_TRX_ID bigint, APPLY_DATE string, RECEIPT_DATE string, AMOUNT_APPLIED double, RECEIPT_STATUS string"
    found = receipt_days(spark.createDataFrame([*rows, (2, None, None, 1.0, "REV")], names), SNAPSHOT)
    days = {r["_receipt_id"]: [(d["day"].day, d["n"], d["amount"], d["gap"]) for d in r["_days"]] for r in found.collect()}
    assert days == {1: [(2, 1, -3.0, None), (5, 1, 0.0, 3), (9, 2, 5.0, 4)], 2: []}
