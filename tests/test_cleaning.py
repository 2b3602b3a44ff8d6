import datetime as dt

import pytest
from pyspark.sql import functions as F

from duesight.functions import cleaning as cl
from duesight.functions.risk import action, expected_loss, risk_level
from duesight.sources.files import infer_format

SNAP = "2026-03-15"


def _one(spark, column, **values):
    row = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def _ts(text):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("2224-01-10", "2024-01-10"),
        ("2230-05-05", "2020-05-05"),
        ("2036-02-29", None),
        ("2026-03-31", "2026-02-28"),
        ("2026-04-29", "2026-03-29"),
        ("2026-04-30", "2026-04-30"),
        ("2026-03-15", "2026-03-15"),
        ("2047-01-01", "2047-01-01"),
        ("2263-01-01", "2063-01-01"),
        ("2025-07-01", "2025-07-01"),
    ],
)
def test_year_repair(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "raw string").select(F.col("raw").cast("timestamp").alias("d"), F.lit(1).alias("k"))
    got = cl.repair_dates(df, ["d"], SNAP).first()["d"]
    assert (got and got.date().isoformat()) == wanted


def test_year_repair_drops_time_of_day(spark):
    df = spark.createDataFrame([("2025-07-01 13:45:00",)], "raw string").select(F.col("raw").cast("timestamp").alias("d"))
    assert cl.repair_dates(df, ["d"], SNAP).first()["d"] == dt.datetime(2025, 7, 1)


def test_days_round_down(spark):
    df = spark.createDataFrame([("2000-01-01 18:00:00", "2000-01-02")], "a string, b string")
    df = df.select(*[F.col(c).cast("timestamp").alias(c) for c in "ab"])
    assert df.select(cl.days_between(F.col("a"), F.col("b"))).first()[0] == -1


def test_as_of(spark):
    df = spark.createDataFrame([(None,), ("2026-03-15",), ("2026-03-16",), ("2026-03-01",)], "d string")
    rows = df.select(cl.as_of(F.col("d").cast("timestamp"), SNAP).cast("date").cast("string").alias("x")).collect()
    assert [r.x for r in rows] == [None, "2026-03-15", "2026-03-15", "2026-03-01"]


def test_dates_of_mixed_formats(spark):
    texts = ["3-Sep-2017", "03-Sep-2017", "2017-09-03T00:00:00.000+00:00", "20170903", "09/03/2017", "3 Sep 2017",
             "2017-09-03", "junk", None, "12:30", "T12:30", "2400-01-01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = [r[0] for r in df.select(cl.parse_timestamp(F.col("t")).cast("date").cast("string")).collect()]
    assert rows == ["2017-09-03"] * 7 + [None] * 4 + ["2400-01-01"]


def test_a_text_is_tried_against_the_formats_it_looks_like_only(spark):
    odd = ["1-Jan-2000", "007-JAN-2000", "-5-Jan-2000", "31-FEB-2000", " 1-Jan-2000", "1 Jan 2000", "1  Jan 2000", "20000601",
           "+20000601", "-20000601", "20001301", "20000601\n", "1/2/2000", "13/2/2000", "01/02/+20000", "1-Jan-+12000", "2000",
           "2000-06", "2000-06-01T00:00:00.000+00:00", "12:00", "junk", "", None]
    text = F.col("t")
    every = [F.try_to_timestamp(text, F.lit(p)) for p in cl.DATE_PATTERNS]
    plain = F.coalesce(*every, F.when(text.rlike(cl.STARTS_WITH_YEAR), text.try_cast("timestamp")))
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert df.where(~plain.eqNullSafe(cl.parse_timestamp(text))).count() == 0
    tried = F.array(*[text.rlike(shape) for shape in cl.DATE_PATTERNS.values()])
    iso = df.where(text.like("2000-%")).select(F.array_contains(tried, True)).collect()
    assert [r[0] for r in iso] == [False, False]


def test_ids_and_numbers(spark):
    df = spark.createDataFrame([("12",), ("12.0",), ("abc",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in df.select(cl.to_id(df, "v")).collect()] == [12, 12, None, None, None]
    assert [r[0] for r in df.select(cl.to_number(df, "v")).collect()] == [12.0, 12.0, None, None, None]


@pytest.mark.parametrize(
    "name, key",
    [(None, ""), ("", ""), ("7", ""), ("42", ""), ("123", "123"), ("PT. Abc, (X)", "PTABCX"), ("  a b ", "AB")],
)
def test_names(spark, name, key):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(cl.normalise_name(F.col("n"))).first()[0] == key


@pytest.mark.parametrize(
    "p, level", [(0.3, "MEDIUM"), (0.6, "HIGH"), (0.29999, "LOW"), (None, "LOW"), (float("nan"), "LOW")]
)
def test_levels(spark, p, level):
    df = spark.createDataFrame([(p,)], "p double")
    assert df.select(risk_level(F.col("p"))).first()[0] == level


def test_action_and_loss(spark):
    df = spark.createDataFrame([("other", None, 0.5), ("HIGH", -10.0, 0.5)], "l string, a double, p double")
    rows = df.select(action(F.col("l")).alias("x"), expected_loss(F.col("a"), F.col("p")).alias("y")).collect()
    assert rows[0].x == "Unknown" and rows[0].y == 0.0
    assert rows[1].x.startswith("ESKALASI") and rows[1].y == 5.0


def test_clip_and_finite_keep_missing(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,), (float("inf"),), (float("nan"),)], "v double")
    assert [r[0] for r in df.limit(3).select(cl.clip(F.col("v"), 0, 1)).collect()] == [None, 0.0, 1.0]
    assert [r[0] for r in df.select(cl.finite(F.col("v"))).collect()] == [None, -1.0, 2.0, None, None]


def test_keep_first_puts_missing_last(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 3), (2, None)], "k int, v int")
    rows = sorted(cl.keep_first(df, ["k"], ["v"]).collect())
    assert [(r.k, r.v) for r in rows] == [(1, 3), (2, None)]


def test_file_formats():
    assert infer_format("A.PQ") == "parquet" and infer_format("x.jsonl") == "jsonl"
    assert infer_format("x.csv") == "csv" and infer_format("csv") is None and infer_format("x.txt") is None
