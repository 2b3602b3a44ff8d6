"""The stack learns from what its base models say about rows they have not seen."""

import math
import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from duesight.operators import models as md
from duesight.settings import FEATURES


def _table(spark, n, seed, signal):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        values = [rng.gauss(signal * label if k == 0 else 0, 1) for k in range(len(FEATURES))]
        rows.append((seed * 10_000 + i, i // 3 if i % 10 else None, label, *values))
    names = ", ".join(f"`{c}` double" for c in FEATURES)
    return spark.createDataFrame(rows, f"CUSTOMER_TRX_ID bigint, PARTY_ID bigint, label int, {names}").coalesce(2)


def _loss(scored, labels):
    rows = scored.join(labels.select("CUSTOMER_TRX_ID", "label"), "CUSTOMER_TRX_ID").collect()
    return -sum(math.log(r.prob_bad_debt if r.label else 1 - r.prob_bad_debt) for r in rows) / len(rows)


def test_noise_brings_no_gain(spark):
    train, held = _table(spark, 600, 1, 0), _table(spark, 600, 2, 0)
    share = train.agg(F.avg("label")).first()[0]
    model = md.fit_stack(train, trees=5, depth=4, by="PARTY_ID")
    constant = _loss(held.select("CUSTOMER_TRX_ID", F.lit(share).alias("prob_bad_debt")), held)
    assert abs(_loss(md.predict_stack(model, held), held) - constant) < 0.02
    # Nor does it believe its trees about the rows they have learnt by heart.
    assert abs(_loss(md.predict_stack(model, train), train) - constant) < 0.05


def test_signal_is_used(spark):
    train, held = _table(spark, 600, 3, 3), _table(spark, 600, 4, 3)
    constant = _loss(held.select("CUSTOMER_TRX_ID", F.lit(0.4).alias("prob_bad_debt")), held)
    assert _loss(md.predict_stack(md.fit_stack(train, trees=3, depth=3, by="PARTY_ID"), held), held) < constant - 0.3


def test_rows_of_a_party_share_a_fold(spark):
    dealt = _table(spark, 300, 5, 0).withColumn("f", md.fold_of("PARTY_ID"))
    assert dealt.where("PARTY_ID IS NOT NULL").groupBy("PARTY_ID").agg(F.count_distinct("f").alias("n")).where("n > 1").isEmpty()
    assert dealt.select("f").distinct().count() == 3 == dealt.where("PARTY_ID IS NULL").select("f").distinct().count()


def test_stack_in_a_session_that_observed_rows(spark):
    train, seen = _table(spark, 300, 6, 3), Observation()
    train.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 300
    scored = md.predict_stack(md.fit_stack(train, trees=2, depth=2, by="PARTY_ID"), train)
    assert scored.where("prob_bad_debt BETWEEN 0 AND 1").count() == 300


def test_a_fit_holds_parts_of_bounded_rows(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "id % 2 AS label")
    dealt = md.in_parts(rows, 20)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 50 and max(sizes) <= 25 and sum(sizes) == 1000
    assert md.in_parts(rows, 1000) is rows
    train = _table(spark, 600, 7, 3)
    asked, deal = [], md.in_parts
    monkeypatch.setattr(md, "in_parts", lambda points: asked.append(points.columns) or deal(points, 20))
    scored = md.predict(md.fit_boosted(train, trees=2, depth=2), train)
    assert asked == [["label", "features"]] and scored.count() == 600


def test_a_fit_makes_its_rows_once(spark):
    made, table = spark.sparkContext.accumulator(0), _table(spark, 300, 8, 3)

    def counted(row):
        made.add(1)
        return row

    train = spark.createDataFrame(table.rdd.map(counted), table.schema)
    # Once for the means, once to count, once for the points; the trees, the scaler and the logistic read these.
    md.fit_bases(train, trees=2, depth=2)
    assert made.value <= 3 * 300
