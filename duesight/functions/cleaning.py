"""Column expressions that clean raw values. All are built-in, none is a UDF.

Timestamps are instants in a UTC session, missing values are NULL and never NaN.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MICROS = 86_400_000_000
#: Each format with what a text of it must look like: a format tried in vain costs an exception a row.
DATE_PATTERNS = {
    "d-MMM-yyyy": r"^[+-]?[0-9]+-[^0-9]",
    "d MMM yyyy": r"^[+-]?[0-9]+ [^0-9]",
    "yyyyMMdd": r"^[+-]?[0-9]{8,}$",
    "M/d/yyyy": r"^[+-]?[0-9]+/",
}
# A cast to timestamp also takes a time alone, and means today by it.
STARTS_WITH_YEAR = r"^\s*[0-9]{4}(?:[^0-9]|\s*$)"


def midnight(day: str | dt.date) -> Column:
    return F.lit(str(day)).cast("timestamp")


def plus_days(col: Column, days: int) -> Column:
    """Exact 24-hour days, also for a NULL (stays NULL)."""
    return col + F.make_dt_interval(days=F.lit(days))


def parse_timestamp(text: Column) -> Column:
    """Each row is tried against every known format that it looks like; what fits none is NULL."""
    tries = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(p))) for p, shape in DATE_PATTERNS.items()]
    return F.coalesce(*tries, F.when(text.rlike(STARTS_WITH_YEAR), text.try_cast("timestamp")))


def to_timestamp(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return parse_timestamp(F.col(name))
    if isinstance(kind, T.TimestampType):
        return F.col(name)
    return F.col(name).cast("timestamp")


def to_id(df: DataFrame, name: str) -> Column:
    """Integer id; text such as '12.0' counts, anything unreadable is NULL."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.LongType):
        return col
    if isinstance(kind, T.StringType):
        return F.coalesce(col.try_cast("bigint"), col.try_cast("double").try_cast("bigint"))
    return col.try_cast("bigint")


def to_number(df: DataFrame, name: str) -> Column:
    """Double; unreadable text and NaN are NULL."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.StringType):
        col = col.try_cast("double")
    elif not isinstance(kind, (T.DoubleType, T.FloatType)):
        return col.cast("double")
    return F.when(~F.isnan(col), col.cast("double"))


def finite(col: Column) -> Column:
    """NULL instead of NaN and of either infinity."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days of the duration, rounded down (minus six hours is minus one day)."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(DAY_MICROS)).cast("bigint")


def repair_dates(df: DataFrame, names: Iterable[str], snapshot: str | dt.date) -> DataFrame:
    """Undo known typing errors in receipt dates; the time of day is dropped.

    1. years 2200-2299 lose 200 years;
    2. then years up to 20 past the snapshot's year lose 10;
    3. a day that does not exist in the new year is NULL;
    4. dates within 45 days after the snapshot move back one month.

    Each step is a projection of its own, so that a date is worked out once and
    not per use. Years are told apart by comparing dates, ordinary ones first.
    """
    snap = dt.date.fromisoformat(str(snapshot))
    names = list(names)
    rest = [c for c in df.columns if c not in names]

    def step(frame: DataFrame, change) -> DataFrame:
        return frame.select(*rest, *[change(F.col(c)).alias(c) for c in names])

    def years_back(year: int) -> int:
        once = 200 if 2200 <= year < 2300 else 0
        return once + (10 if snap.year < year - once <= snap.year + 20 else 0)

    # The shift is constant between these years.
    edges = sorted({2200, 2300, *[snap.year + 1 + n for n in (0, 20, 200, 220)]})

    def moved(day: Column) -> Column:
        out = F.when(day < _new_year(edges[0]), day)
        for low, high in zip(edges, edges[1:]):
            back = years_back(low)
            now = F.add_months(day, -12 * back)
            value = F.when(F.dayofmonth(now) == F.dayofmonth(day), now) if back else day
            out = out.when(day < _new_year(high), value)
        return out.otherwise(day)

    def pulled_back(day: Column) -> Column:
        ahead = (day > F.lit(snap)) & (day <= F.lit(snap + dt.timedelta(days=45)))
        return F.when(ahead, F.add_months(day, -1)).otherwise(day).cast("timestamp")

    return step(step(step(df, F.to_date), moved), pulled_back)


def _new_year(year: int) -> Column:
    return F.lit(dt.date(year, 1, 1))


def normalise_name(name: Column) -> Column:
    """Upper-case letters and digits only; missing and one- or two-digit names are ''."""
    key = F.regexp_replace(F.upper(F.trim(F.coalesce(name, F.lit("")))), "[^A-Z0-9]+", "")
    return F.when(key.rlike("^[0-9]{1,2}$"), "").otherwise(key)


def holds(cond: Column) -> Column:
    """A comparison with a missing operand counts as false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    return holds(cond).cast("int")


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that leave NULL alone (least and greatest would skip it)."""
    out = col
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def ratio(top: Column, bottom: Column, default: float | None = None) -> Column:
    """Quotient, or `default` where it has no finite value."""
    value = F.try_divide(top, bottom)
    return value if default is None else F.coalesce(value, F.lit(default))


def log1p_floor0(col: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(col, F.lit(0.0)), F.lit(0.0)))


def as_of(due: Column, snapshot: str | dt.date) -> Column:
    """The earlier of due date and snapshot; a missing due date stays missing."""
    snap = midnight(snapshot)
    return F.when(due > snap, snap).otherwise(due)


def require(df: DataFrame, names: Iterable[str], what: str) -> DataFrame:
    """`df`, if it has the columns; a misspelt one would else be a column of missing values."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"{what} table lacks columns: {lacking}")
    return df


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of `schema` that the input lacks as typed NULLs."""
    have = set(df.columns)
    return df.select(
        *df.columns,
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in have],
    )


def keep_first(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """The first row per key by `order`, missing values last.

    Spark cuts each group to its first row before the shuffle as well as after
    it, so copies of one key never travel together to a single task.
    """
    first = W.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])
    ranked = df.withColumn("_rank", F.row_number().over(first))
    return ranked.where(F.col("_rank") == 1).drop("_rank")
