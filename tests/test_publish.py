from pyspark.sql import functions as F

from duesight.checks import store as st
from duesight.checks.fixtures import SNAPSHOT
from duesight.checks.store import catalogue, store
from duesight.operators.scoring import score_table
from duesight.plans import catalogue as ct
from duesight.plans import reports as rp
from duesight.plans.jobs import PUBLISHED_INPUTS
from duesight.schemas import SCORES
from duesight.session import scratch_path
from duesight.sinks import publish as pb

import pytest


def _key(job, at, **more):
    return pb.RunKey(job, "stacked", SNAPSHOT, more.pop("time_range", "3m"), at, **more)


def test_publishing_twice_is_publishing_once(spark, sf_dir):
    rows = score_table(store(spark, sf_dir).scored).limit(200)
    path = scratch_path(spark, "twice")
    for _ in range(2):
        pb.publish_scores(rows, path, _key("j", "2000-07-01 00:00:00"))
    pb.publish_scores(rows.limit(3), path, _key("k", "2000-07-01 00:00:00", time_range="6m"))
    found = pb.read_table(spark, path, SCORES)
    assert found.where("time_range = '3m'").count() == 200
    assert found.where("time_range = '6m'").count() == 3


def test_infinite_values_become_missing(spark, sf_dir):
    rows = score_table(store(spark, sf_dir).scored).limit(5)
    odd = rows.withColumn("prob_bad_debt", F.lit(float("inf"))).withColumn("TRX_AMOUNT", F.lit(float("nan")))
    path = scratch_path(spark, "odd")
    pb.publish_scores(odd, path, _key("j", "2000-07-01 00:00:00"))
    assert pb.read_table(spark, path, SCORES).where("prob_bad_debt IS NULL AND TRX_AMOUNT IS NULL").count() == 5


def test_retention_bounds(spark, sf_dir):
    scores = store(spark, sf_dir).scores
    assert pb.retain_published(scores, "2000-07-05", -1).count() == scores.count()
    assert pb.retain_published(scores, "2000-07-05", 1).count() == 0


def test_pages_join_to_the_whole_order(spark, sf_dir):
    rows = store(spark, sf_dir).scored.limit(150).select("CUSTOMER_TRX_ID", "TRX_AMOUNT")
    order = rp.sort_order("TRX_AMOUNT", "desc", rp.SCORE_SORT, ["CUSTOMER_TRX_ID"])
    whole = [r[0] for r in rows.orderBy(*order).collect()]
    paged = [r[0] for p in (1, 2, 3, 4) for r in rp.page_of(rows, order, p, 50).collect()]
    assert paged == whole


def test_sort_falls_back(spark):
    spark.range(1)
    assert [str(c) for c in rp.sort_order("nope", "sideways", rp.SCORE_SORT, [])] == [str(F.desc("prob_bad_debt"))]
    with pytest.raises(ValueError):
        rp.page_of(spark.range(1), [F.col("id")], 1, 201)
    with pytest.raises(ValueError):
        rp.alerts(spark.range(1), 1.5)


@pytest.mark.parametrize("asked, job", [("1m", "job-3m"), ("6m", "job-6m"), ("1y", "job-all"), ("all", "job-all")])
def test_covering_publication(spark, sf_dir, asked, job):
    found = ct.covering_publication(store(spark, sf_dir).scores, "stacked", SNAPSHOT, asked).collect()
    assert [r.job_id for r in found] == [job]


def test_custom_window_needs_its_dates(spark, sf_dir):
    scores = store(spark, sf_dir).scores

    def found(start, end):
        rows = ct.covering_publication(scores, "stacked", SNAPSHOT, "custom", start, end).collect()
        return [r.job_id for r in rows]

    assert found("2000-01-01", "2000-03-31") == ["job-c1"]
    assert found("2000-01-01", "2000-03-30") == []


def test_covering_run_is_never_narrower(spark, sf_dir):
    runs = catalogue(store(spark, sf_dir).risk)
    for asked, days in (("1w", 7), ("3m", 90), ("6m", 180), ("1y", 365)):
        row = ct.latest_covering_run(runs, "stacked", SNAPSHOT, asked).first()
        assert {"3m": 90, "6m": 180, "all": 99999}[row.time_range] >= days
        assert row.fallback_used == (row.time_range != asked)
    assert ct.latest_covering_run(runs, "stacked", SNAPSHOT, "custom", "1999-01-01", "1999-01-02").count() == 0
    assert ct.latest_covering_run(runs, "nobody", SNAPSHOT, "1w").count() == 0


def test_reads_only_the_partition(spark, sf_dir):
    made = store(spark, sf_dir)
    plan = pb.published_scores(spark, made.scores_path, "stacked", SNAPSHOT)._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(model_key" in plan.toString()


def test_chart_is_empty_without_a_run(spark, sf_dir):
    assert rp.chart_rows(store(spark, sf_dir).scores, "nobody", SNAPSHOT, "1m").count() == 0


def test_an_empty_rerun_serves_no_rows(spark, sf_dir):
    from duesight.checks.store import store
    from duesight.operators.scoring import score_table
    from duesight.schemas import SCORES
    from duesight.session import scratch_path
    from duesight.sinks.publish import RunKey, publish_scores, read_table

    rows, path = score_table(store(spark, sf_dir).scored), scratch_path(spark, "rerun")
    run, other = (RunKey("j", "stacked", "2000-06-30", span, "2000-07-02 06:00:00") for span in ("3m", "6m"))
    publish_scores(rows, path, run)
    publish_scores(rows, path, other)
    publish_scores(rows.limit(0), path, run)
    assert [r["time_range"] for r in read_table(spark, path, SCORES).select("time_range").distinct().collect()] == ["6m"]


def test_thresholds_and_ranges_are_checked(spark, sf_dir):
    from duesight.functions.risk import checked
    from duesight.checks.fixtures import raw_tables
    from duesight.operators.invoices import clean_invoices
    from duesight.sources.tables import invoices_in_range

    invoice = raw_tables(spark, sf_dir).invoice
    for low, high in ((0.6, 0.3), (0.3, 0.3), (-0.1, 0.5)):
        with pytest.raises(ValueError):
            checked(low, high)
    for name in ("unknown", "year", "custom"):
        with pytest.raises(ValueError):
            invoices_in_range(invoice, name)
    with pytest.raises(ValueError):
        clean_invoices(invoice.drop("DUE_DATE"))


def test_many_late_batches_are_scored_in_order(spark, sf_dir):
    """Twelve batches of a moment, each scoring one invoice's party: the last one counts."""
    import datetime as dt

    from duesight.checks.fixtures import SNAPSHOT, raw_tables
    from duesight.schemas import SCORES
    from duesight.session import scratch_path
    from duesight.sinks.publish import RunKey, latest_per_invoice, read_table
    from duesight.streaming.receipt_trigger import rescore_batch

    raw, path = raw_tables(spark, sf_dir), scratch_path(spark, "batches")
    paid = raw.receipt.where("APPLIED_CUSTOMER_TRX_ID IS NOT NULL").orderBy("RECEIPT_DATE", "APPLIED_CUSTOMER_TRX_ID").limit(1)
    served = RunKey("job", "stacked", SNAPSHOT, "all", "2000-07-01 00:00:00")
    handle = rescore_batch(lambda: raw, SNAPSHOT, path, served, lambda: dt.datetime(2000, 7, 2))
    for number in (9, 10, 11, 10):
        handle(paid, number)
    rows = latest_per_invoice(read_table(spark, path, SCORES)).select("job_id", "time_range").distinct().collect()
    assert [(int(r["job_id"].split("-")[1]), r["time_range"]) for r in rows] == [(11, "all")]


def test_the_index_answers_as_counting_does(spark, sf_dir):
    made = store(spark, sf_dir)
    names = ["job_id", "time_range", "date_window", "published_at", "total_invoices"]
    assert sorted(ct.publications(made.scores).select(names).collect()) == sorted(made.index.select(names).collect())
    for asked in (("1m",), ("6m",), ("1y",), ("all",), ("custom", "2000-01-01", "2000-03-31"), ("custom", "1999-01-01", "1999-01-02")):
        counted = rp.answering_rows(made.scores, "stacked", SNAPSHOT, *asked)
        looked_up = rp.answering_rows(made.scores, "stacked", SNAPSHOT, *asked, index=made.index)
        assert sorted(map(repr, counted.collect())) == sorted(map(repr, looked_up.collect())), asked
    assert rp.chart_rows(made.scores, "nobody", SNAPSHOT, "1m", index=made.index).count() == 0


def test_a_report_reads_its_partition_only(spark, sf_dir):
    """With the index the run is known before the plan: literal partition filters, no aggregate over scores, no join."""
    made = store(spark, sf_dir)
    page = rp.score_report(made.scores, "stacked", SNAPSHOT, "6m", index=made.index)["page"]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2_000)
    try:
        plan = page._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan[plan.index("PartitionFilters:") :].split("PushedFilters")[0]
    assert all(x in filters for x in ("time_range", "= 6m", "date_window", "= -", "= stacked"))
    assert "Aggregate" not in plan and "Join" not in plan and plan.count("FileScan") == 1


def test_report_pages_follow_a_row(spark, sf_dir):
    made = store(spark, sf_dir)

    def page(**more):
        return rp.score_report(made.scores, "stacked", SNAPSHOT, "1y", sort_by="TRX_AMOUNT", size=40, index=made.index, **more)["page"].collect()

    first, second = page(), page(page=2)
    assert page(after=first[-1].asDict()) == second and len(second) == 40


def test_the_write_counts(spark, sf_dir):
    rows, path = score_table(store(spark, sf_dir).scored), scratch_path(spark, "counted")
    assert pb.publish_scores(rows.limit(7), path, _key("j", "2000-07-01 00:00:00")) == 7
    assert pb.publish_scores(rows.limit(0), path, _key("j", "2000-07-01 00:00:00")) == 0


def test_jobs_go_in_place(spark, sf_dir):
    """Of a partition that two jobs share only one job's rows go; a job's own partition goes as a whole; others stay."""
    rows, path = score_table(store(spark, sf_dir).scored).limit(30), scratch_path(spark, "jobs")
    pb.publish_scores(rows, path, _key("old", "2000-07-01 00:00:00"))
    pb.publish_scores(rows.limit(4), path, _key("new", "2000-07-02 00:00:00"), replace=False)
    pb.publish_scores(rows.limit(5), path, _key("old", "2000-07-01 00:00:00", time_range="6m"))
    pb.publish_scores(rows.limit(6), path, _key("other", "2000-07-01 00:00:00", time_range="1y"))
    pb.drop_jobs(spark, path, SCORES, spark.createDataFrame([("old",), ("none",)], "job_id string"))
    left = pb.read_table(spark, path, SCORES).groupBy("job_id", "time_range").count().collect()
    assert sorted(map(tuple, left)) == [("new", "3m", 4), ("other", "1y", 6)]


def test_a_run_lets_old_runs_go(spark, sf_dir):
    from duesight.checks.fixtures import raw_tables
    from duesight.plans.jobs import run_snapshot, stored_runs
    from duesight.schemas import CUSTOMER_RISK

    raw, paths = raw_tables(spark, sf_dir), [scratch_path(spark, n) for n in ("s", "r", "runs", "index")]
    for job, span, at in (("a", "3m", "2000-07-01 06:00:00"), ("b", "1m", "2000-08-10 06:00:00")):
        run_snapshot(spark, raw, SNAPSHOT, span, *paths[:2], job, at, runs_path=paths[2], index_path=paths[3], keep_run_days=30)
    assert [r["job_id"] for r in stored_runs(spark, paths[2]).collect()] == ["b"]
    for path, schema in ((paths[0], SCORES), (paths[1], CUSTOMER_RISK)):
        assert [r["job_id"] for r in pb.read_table(spark, path, schema).select("job_id").distinct().collect()] == ["b"]
    assert [r["job_id"] for r in pb.read_index(spark, paths[3]).collect()] == ["b"]


def test_the_index_follows_reruns(spark, sf_dir):
    rows, path, index = score_table(store(spark, sf_dir).scored).limit(9), scratch_path(spark, "p"), scratch_path(spark, "i")

    def publish(job, day, n, **more):
        pb.publish_scores(rows.limit(n), path, _key(job, f"2000-07-0{day} 00:00:00", **more), index_path=index)

    publish("a", 1, 5)
    publish("b", 2, 4)  # replaces a
    pb.publish_scores(rows.limit(3), path, _key("c", "2000-07-03 00:00:00"), replace=False, index_path=index)
    publish("d", 1, 6, time_range="6m")
    publish("e", 4, 0, time_range="6m")  # a rerun without rows
    names = ["job_id", "time_range", "total_invoices"]
    counted = ct.publications(pb.read_table(spark, path, SCORES)).select(names).collect()
    assert sorted(map(tuple, pb.read_index(spark, index).select(names).collect())) == sorted(map(tuple, counted)) == [
        ("b", "3m", 4), ("c", "3m", 3)]


def test_the_store_publishes_only_what_is_read(spark, sf_dir):
    store = st.Store(spark, sf_dir)
    assert store.scored.count() > 0 and set(vars(store)) == {"spark", "sf_dir", "scored"}
    jobs = {run.job_id for run in st.run_keys()}
    assert {r[0] for r in store.risk.select("job_id").distinct().collect()} <= jobs and "_published" not in vars(store)
    assert store.scores.where("job_id = 'job-3m'").select("published_at").distinct().count() == 2
    assert store.index.count() > 0


def test_publications_are_made_of_narrow_rows(spark, sf_dir):
    store = st.Store(spark, sf_dir)
    assert store.published_rows.columns == PUBLISHED_INPUTS and "scored" not in vars(store)
    store.risk, store.scores
    assert "scored" not in vars(store)
    again = st.Store(spark, sf_dir)
    wide = again.scored.select(*PUBLISHED_INPUTS)
    # The rows that are there already.
    assert "Window" not in again.published_rows._jdf.queryExecution().executedPlan().toString()
    assert wide.exceptAll(store.published_rows).isEmpty() and store.published_rows.exceptAll(wide).isEmpty()
