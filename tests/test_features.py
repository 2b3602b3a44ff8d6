import datetime as dt


from duesight.operators import customer_risk as cr
from duesight.operators import receipts as rc
from duesight.operators.invoices import clean_invoices
from duesight.operators.ledger import invoice_core
from duesight.operators.targets import run_inputs
from duesight.plans.features import RawTables, snapshot_features
from duesight.schemas import CUSTOMER, INVOICE, RECEIPT

SNAP = "2026-03-15"


def day(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def invoices(spark, rows):
    """(id, party, date, due, amount, previous)"""
    made = [(i, f"N{i}", p, day(t), day(d), a, "INV", "IDR", 1, prev) for i, p, t, d, a, prev in rows]
    return spark.createDataFrame(made, INVOICE)


def receipts(spark, rows):
    """(invoice, date, amount[, status])"""
    made = [(r[0], day(r[1]), day(r[1]), r[2], r[3] if len(r) > 3 else "APP") for r in rows]
    return spark.createDataFrame(made, RECEIPT)


def customers(spark, rows):
    return spark.createDataFrame(rows, CUSTOMER)


def features(spark, inv, rcp, cust=None):
    raw = RawTables(invoices(spark, inv), receipts(spark, rcp), cust)
    return {r.CUSTOMER_TRX_ID: r for r in snapshot_features(raw, SNAP).collect()}


def test_history_of_a_party(spark):
    rows = features(
        spark,
        [
            (1, 7, "2025-01-01", "2025-01-31", 100.0, None),
            (2, 7, "2025-03-01", "2025-03-31", 50.0, None),
            (3, 7, "2025-03-01", None, 50.0, None),
            (4, None, "2025-03-01", "2025-03-31", 50.0, None),
            (5, 8, "2025-03-01", "2025-03-31", 50.0, None),
        ],
        [(1, "2025-02-10", 100.0), (2, "2025-04-01", 10.0), (3, "2025-04-01", 50.0)],
    )
    first, second, third = rows[1], rows[2], rows[3]
    assert first.party_is_new_customer == 1 and first.customer_maturity_days == 0
    assert second.party_prior_invoice_cnt == 1 and second.customer_maturity_days == 59
    assert second.historical_avg_dpd == 10.0 and second.historical_late_payment_ratio == 100.0
    assert second.prob_paid_within_30d == 1.0 and second.hazard_approx == 0.0
    # Two invoices of one day are ordered by id.
    assert third.party_prior_invoice_cnt == 2 and third.median_payment_delay == 5.5
    assert third.total_outstanding_at_trx == 40.0
    # A paid invoice without a due date has no delay and is not late.
    assert third.days_to_due is None
    assert rows[4].party_missing == 1 and rows[4].prob_paid_within_30d == 0.5 and rows[4].party_is_new_customer == 0
    assert rows[5].party_is_new_customer == 1 and rows[5].hazard_approx == 0.0


def test_events_count_strictly_before(spark):
    rows = features(
        spark,
        [
            (1, 7, "2024-01-01", "2024-02-01", 100.0, None),
            (2, 7, "2024-05-01", "2024-06-01", 10.0, None),
            (3, 7, "2024-05-02", "2024-06-01", 10.0, None),
        ],
        [(1, "2024-05-01", 1.0)],
    )
    # Unpaid 90 days past due and first paid late, both on 2024-05-01.
    assert rows[2].party_prior_bd90_cnt == 0 and rows[2].party_prior_late_firstpay90_cnt == 0
    assert rows[3].party_prior_bd90_cnt == 1 and rows[3].party_prior_late_firstpay90_cnt == 1


def test_memo_without_receipt_reduces_nothing(spark):
    inv = [
        (1, 7, "2025-01-01", "2025-01-31", 100.0, None),
        (2, 7, "2025-01-01", "2025-01-31", 100.0, None),
        (11, 7, "2025-01-05", None, -30.0, 1),
        (12, 7, "2025-01-05", None, -30.0, 2),
    ]
    raw = RawTables(invoices(spark, inv), receipts(spark, [(12, "2025-01-06", 0.0, "REV")]))
    rows = {r.CUSTOMER_TRX_ID: r for r in invoice_core(raw.invoice, raw.receipt, SNAP).collect()}
    assert set(rows) == {1, 2, 12}
    assert rows[1].TRX_AMOUNT == 100.0 and rows[1].credit_memo_reduction == 0.0
    assert rows[2].TRX_AMOUNT == 70.0 and rows[2].cm_count == 1
    assert rows[12].TRX_AMOUNT == 0.0


def test_amounts_stay_without_any_memo(spark):
    raw_inv = invoices(spark, [(1, 7, "2025-01-01", "2025-01-31", -5.0, None)])
    rows = invoice_core(raw_inv, receipts(spark, [(1, "2025-01-06", 1.0)]), SNAP).collect()
    assert rows[0].TRX_AMOUNT == -5.0


def test_missing_columns_are_typed(spark):
    bare = spark.createDataFrame([("1", "3-Sep-2017", None, None)],
                                 "CUSTOMER_TRX_ID string, TRX_DATE string, DUE_DATE string, TRX_AMOUNT string")
    row = clean_invoices(bare).first()
    assert row.CUSTOMER_TRX_ID == 1 and row.PARTY_ID is None and row.TRX_DATE == day("2017-09-03")


def test_gap_variance_with_few_payments(spark):
    pay = [(1, "2025-01-01", 1.0), (2, "2025-01-01", 1.0), (2, "2025-01-11", 1.0)]
    pay += [(3, "2025-01-01", 1.0), (3, "2025-01-11", 1.0), (3, "2025-01-11", 1.0), (3, "2025-05-01", 1.0)]
    rows = {r.CUSTOMER_TRX_ID: r for r in rc.receipt_totals(rc.base_payments(receipts(spark, pay), SNAP)).collect()}
    assert rows[1].gap_variance is None and rows[2].gap_variance is None
    gaps = [10, 0, 110]
    mean = sum(gaps) / 3
    assert abs(rows[3].gap_variance - sum((g - mean) ** 2 for g in gaps) / 2) < 1e-9
    assert rows[1].is_partial == 0 and rows[2].is_partial == 1


def test_later_invoices_change_nothing(spark):
    inv = [(i, 7, f"2025-0{i}-01", f"2025-0{i}-20", 10.0 * i, None) for i in range(1, 7)]
    pay = [(i, f"2025-0{i}-25", 5.0) for i in range(1, 7)]
    whole, part = features(spark, inv, pay), features(spark, inv[:4], pay)
    for key in part:
        assert whole[key] == part[key]


def test_customer_risk_groups_and_fallback(spark):
    cols = (
        "CUSTOMER_TRX_ID bigint, PARTY_ID bigint, ACCOUNT_NUMBER string, CUSTOMER_NAME string, prob_bad_debt double, "
        "TRX_AMOUNT double, amt_paid_pre_due double, paid_ratio_pre_due double, count_gaps_gt_90_pre_due bigint, "
        "party_prior_invoice_cnt bigint, party_prior_gap90_cnt bigint"
    )
    rows = spark.createDataFrame(
        [
            (2, 7, None, "A", 0.2, 0.0, 0.0, 0.0, 1, 5, 1),
            (1, 7, None, "A", 0.6, 0.0, 0.0, 0.0, 0, None, 0),
            (3, 7, "X", "A", 0.1, 10.0, 5.0, 50.0, 0, 6, 0),
        ],
        cols,
    )
    for quick in (True, False):
        got = {r.ACCOUNT_NUMBER: r for r in cr.customer_risk(rows, quick).collect()}
        assert set(got) == {None, "X"}
        assert abs(got[None].cust_score_wavg_amount - 0.4) < 1e-12 and got[None].paid_ratio_pre_due_total is None
        assert got[None].party_prior_invoice_cnt == 5 and got[None].party_prior_gap90_cnt == 0
        assert got[None].pct_invoices_gap_gt_90_pre_due == 50.0 and got[None].risk_cust == "HIGH"
        assert got["X"].paid_ratio_pre_due_total == 50.0 and got["X"].invoice_cnt == 1


def test_run_inputs_take_history_and_distinct_receipts(spark):
    raw = RawTables(
        invoices(
            spark,
            [
                (1, 7, "2020-01-01", "2020-01-31", 10.0, None),
                (2, 7, "2026-03-10", "2026-03-31", 10.0, None),
                (3, 8, "2020-01-01", "2020-01-31", 10.0, None),
                (4, None, "2026-03-10", "2026-03-31", 10.0, None),
                (5, 9, "2020-01-01", "2020-01-31", 10.0, None),
            ],
        ),
        receipts(spark, [(1, "2020-02-01", 1.0), (1, "2020-02-01", 1.0), (3, "2020-02-01", 1.0)]),
        customers(spark, [(9, "A", "N4", "Nine", "B")]),
    )
    got = run_inputs(raw, "1w", SNAP)
    assert sorted(r[0] for r in got.invoice.select("CUSTOMER_TRX_ID").collect()) == [1, 2, 4, 5]
    assert sorted(r[0] for r in got.target_ids.collect()) == [2, 4]
    assert got.receipt.count() == 1
    assert run_inputs(raw, "all", SNAP).receipt.count() == 3


def test_history_row_per_invoice(spark, sf_dir):
    from duesight.checks.fixtures import SNAPSHOT, raw_tables

    raw = raw_tables(spark, sf_dir)
    rows = snapshot_features(raw, SNAPSHOT).select("CUSTOMER_TRX_ID")
    core = invoice_core(raw.invoice, raw.receipt, SNAPSHOT)
    assert rows.count() == rows.distinct().count() == core.count()
    bad = snapshot_features(raw, SNAPSHOT)
    doubles = [f.name for f in bad.schema if f.dataType.typeName() == "double"]
    assert bad.where(" OR ".join(f"isnan({c})" for c in doubles)).count() == 0
