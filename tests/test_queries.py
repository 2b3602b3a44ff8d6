"""The registry against SQL. The heaviest ones are left to tools/compare.py."""

import pytest

import __spark_entry__ as entry
from duesight.checks.queries import QUERIES as own
from tools.compare import connect, difference

HEAVY = {
    "score_gbt", "score_stacked", "calibrate_isotonic", "score_files", "run_snapshot_risk", "run_snapshot_catalogue",
    "monitoring_features", "new_featured_snapshot", "hist_avg_dpd", "hist_late_ratio", "hist_partial_freq",
    "unpaid_exposure", "hist_consistency", "hist_completion", "total_outstanding", "survival_probs", "median_delay",
    "party_prior_bd90", "party_prior_late_firstpay90", "party_prior_gap90", "prior_invoice_cnt", "maturity_days",
    "business_scale", "history_features", "pre_due_agg", "pre_due_gaps", "score_linear", "score_stacked_linear",
    "first_payment", "first_gap90", "bd90_paid", "late_firstpay90_events", "customer_enrich_trx", "master_missing_flag",
}
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in SQL if n not in HEAVY])
def test_same_as_sql(spark, sf_dir, duck, name):
    note = difference(QUERIES[name](spark, sf_dir), duck.execute(SQL[name]))
    assert note is None, note


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)
    assert set(own) - set(SQL) == {"score_gbt", "score_stacked", "calibrate_isotonic"}


def test_entry_has_the_features(spark):
    assert "median_payment_delay" in entry.entry(spark).columns


def test_a_session_made_elsewhere_leaves_no_method_too_long_to_compile(spark):
    from duesight.session import prepare

    # HotSpot compiles methods of up to 8,000 bytes.
    assert prepare(spark.newSession()).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
