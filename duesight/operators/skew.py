"""Party-ordered running aggregates and lookups that hold up when one key is huge.

Two physical forms of the running aggregates give the same values:

* plain: one exchange and one sort on the party, every aggregate in one window
  operator. Right while no party exceeds what a running median bears, as that
  costs a party's rows times its distinct values.
* chunked: the rows are range-partitioned on (party, order), so a huge party
  spreads over many tasks, and the sorted rows of a task are cut into chunks of
  a few thousand. Each chunk runs the same window on its own rows and adds what
  the party had accumulated in earlier chunks; its medians start from a histogram
  of the earlier values, cut to where the median can lie. Only a party that
  crosses a chunk border needs that carry, at most one party per border.

Sums of integers, counts, minima and medians agree bit by bit, sums of doubles up to
the order of adding. `measure_skew` decides between the forms from a count per party, and
gives the keys whose rows a lookup join has to deal to several lanes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesight.session import materialise

#: Rows of one party that the plain form takes.
HOT_ROWS = 4_000
#: Rows of a chunk, of a task that holds chunks, and of a lane.
CHUNK_ROWS = 2_048
TASK_ROWS = 1_000_000
LANE_ROWS = 1_000_000
#: Lane tables of no more rows are broadcast (16 bytes a row).
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Lanes:
    """Keys with more than LANE_ROWS rows, as a table (key, _lanes) with about LANE_ROWS rows a lane, and how many."""

    table: DataFrame
    keys: int

    def beside(self, df: DataFrame, key: str) -> DataFrame:
        """`df` with the number of lanes of its key; missing for a key that needs no more than one."""
        table = F.broadcast(self.table) if self.keys <= BROADCAST_KEYS else self.table
        return df.join(table, key, "left")


@dataclass(frozen=True)
class Skew:
    """What the counts say: rows of the largest window key, all rows, and the lanes by key column."""

    top_rows: int = 0
    total_rows: int = 0
    lanes: Mapping[str, Lanes] = field(default_factory=dict)
    hot_rows: int = HOT_ROWS
    chunk_rows: int = CHUNK_ROWS

    @property
    def heavy(self) -> bool:
        return self.top_rows > self.hot_rows

    def tasks(self, df: DataFrame) -> int:
        floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(floor, -(-self.total_rows // TASK_ROWS))


NO_SKEW = Skew()


def measure_skew(
    df: DataFrame, key: str, *others: str, hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS,
    lane_rows: int = LANE_ROWS,
) -> Skew:
    """Count rows per key; runs a job over that one column, and over the `others` where one lane may not do.

    The numbers come to the driver, the keys stay in tables.
    """

    def counted(name: str) -> tuple[DataFrame, dict]:
        counts = df.groupBy(name).agg(F.count("*").alias("n"))
        known = F.col(name).isNotNull()
        found = counts.agg(
            F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("top"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.count_if(known & (F.col("n") > lane_rows)).alias("many"))
        return counts.where(known), found.first().asDict()

    lanes = {}
    counts, found = counted(key)
    top, total = found["top"], found["total"]
    for name in (key, *others):
        if total <= lane_rows:  # no key can have more
            break
        if name != key:
            counts, found = counted(name)
        if found["many"]:
            many = counts.where(F.col("n") > lane_rows).select(name, F.ceil(F.col("n") / lane_rows).alias("_lanes"))
            lanes[name] = Lanes(materialise(many, "lanes"), found["many"])
    return Skew(top, total, lanes, hot_rows, chunk_rows)


def with_lane(df: DataFrame, key: str, row_id: str, skew: Skew = NO_SKEW) -> DataFrame:
    """Add `_lane`, the second join key: spreads missing keys by row and hot keys over their lanes, others stay in lane 0."""
    spread = F.when(F.col(key).isNull(), F.coalesce(F.col(row_id), F.lit(0)).cast("bigint"))
    names = df.columns
    if key in skew.lanes:
        df = skew.lanes[key].beside(df, key)
        spread = spread.when(F.col("_lanes").isNotNull(), F.pmod(F.xxhash64(row_id), F.col("_lanes")))
    return df.select(*names, spread.otherwise(F.lit(0)).cast("bigint").alias("_lane"))


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, row_id: str, skew: Skew = NO_SKEW
) -> DataFrame:
    """Left join to a lookup that has one row per key. Leaves the `_lane` column in place."""
    names, lane = lookup.columns, F.lit(0).cast("bigint")
    if key in skew.lanes:
        lookup = skew.lanes[key].beside(lookup, key)
        lane = F.explode(F.sequence(lane, F.coalesce("_lanes", F.lit(1)).cast("bigint") - 1))
    return with_lane(rows, key, row_id, skew).join(lookup.select(*names, lane.alias("_lane")), [key, "_lane"], "left")


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of rows. Missing if there is no value.

    Decimals of 18 places are added; a value with more than 20 digits before them is missing.
    """
    return F.sum(value.try_cast("decimal(38,18)")).cast("double")


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    counts: Mapping[str, Column] | None = None,
    lows: Mapping[str, Column] | None = None,
    medians: Mapping[str, Column] | None = None,
    weight: Column | None = None,
    skew: Skew = NO_SKEW,
) -> DataFrame:
    """Add aggregates over the rows of the same key that come earlier in `order`.

    `order` names columns that are total within a key; missing values sort last.
    sums: of doubles; totals: of integers; both 0 when there is no earlier
    value. counts: earlier non-missing values. lows: minimum so far, the row
    itself included. medians: exact, of integers; a row counts `weight` times there.
    """
    spec = (dict(sums or {}), dict(totals or {}), dict(counts or {}), dict(lows or {}), dict(medians or {}))
    if skew.heavy:
        return _running_chunked(rows, list(keys), list(order), *spec, weight, skew)
    sums, totals, counts, lows, medians = spec
    here = W.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])
    prior = here.rowsBetween(W.unboundedPreceding, -1)
    so_far = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    often = () if weight is None else (weight,)

    return rows.select(
        "*",
        *[F.coalesce(F.sum(c).over(prior), F.lit(0.0)).alias(n) for n, c in sums.items()],
        *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(n) for n, c in totals.items()],
        *[F.count(c).over(prior).alias(n) for n, c in counts.items()],
        *[F.min(c).over(so_far).alias(n) for n, c in lows.items()],
        *[F.percentile(c, F.lit(0.5), *often).over(prior).alias(n) for n, c in medians.items()],
    )


def _running_chunked(rows, keys, order, sums, totals, counts, lows, medians, weight, skew) -> DataFrame:
    added = {**sums, **totals}
    values = {**added, **counts, **lows, **medians}
    often = F.lit(1) if weight is None else weight
    wide = rows.select("*", *[c.alias(f"_v_{n}") for n, c in values.items()], often.cast("bigint").alias("_freq"))
    along = [*[F.col(k) for k in keys], *[F.asc_nulls_last(c) for c in order]]
    spread = wide.repartitionByRange(skew.tasks(rows), *along).sortWithinPartitions(*along)
    # The id counts the rows of a task in their order, from a number that grows with the task's.
    number, task = F.monotonically_increasing_id(), F.spark_partition_id().cast("bigint")
    within = F.floor((number - F.shiftleft(task, 33)) / skew.chunk_rows)
    # Written out, because the chunk number must not change between its uses.
    chunked = materialise(spread.withColumn("_chunk", F.shiftleft(task, 33) + within), "chunks")

    v = {n: F.col(f"_v_{n}") for n in values}
    sizes = chunked.groupBy(*keys, "_chunk").agg(
        *[F.coalesce(F.sum(v[n]), F.lit(0)).alias(n) for n in added],
        *[F.count(v[n]).alias(n) for n in counts],
        *[F.min(v[n]).alias(n) for n in lows],
        *[F.coalesce(F.sum(F.when(v[n].isNotNull(), F.col("_freq"))), F.lit(0)).alias(f"_m_{n}") for n in medians],
    )
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = sizes.select(
        *keys,
        "_chunk",
        F.count("_chunk").over(earlier).alias("_pos"),
        F.count("_chunk").over(W.partitionBy(*keys)).alias("_chunks"),
        *[F.sum(n).over(earlier).alias(f"_c_{n}") for n in [*added, *counts]],
        *[F.min(n).over(earlier).alias(f"_c_{n}") for n in lows],
        *[f"_m_{n}" for n in medians],
    ).where(F.col("_chunks") > 1)
    # A row for each chunk of a party with several; written so that its uses below do not recount.
    carry = materialise(carry.drop("_chunks"), "carry")

    body = chunked.select("*", F.lit(1).alias("_seed"))
    for n in medians:
        body = _with_seed(body, materialise(_histogram_seed(chunked, carry, keys, n), "seed"), carry, keys, n)

    here = W.partitionBy("_chunk", *keys).orderBy("_seed", *[F.asc_nulls_last(c) for c in order])
    prior = here.rowsBetween(W.unboundedPreceding, -1)
    so_far = here.rowsBetween(W.unboundedPreceding, W.currentRow)

    def with_carry(c: Column, n: str) -> Column:
        return F.coalesce(c.over(prior), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))

    out = body.join(carry, [*keys, "_chunk"], "left").select(
        *rows.columns,
        "_seed",
        *[with_carry(F.sum(v[n]), n).alias(n) for n in added],
        *[with_carry(F.count(v[n]), n).alias(n) for n in counts],
        *[F.least(F.min(v[n]).over(so_far), F.col(f"_c_{n}")).alias(n) for n in lows],
        *[F.percentile(v[n], F.lit(0.5), F.col("_freq")).over(prior).alias(n) for n in medians],
    )
    return out.where(F.col("_seed") == 1).drop("_seed")


def _histogram_seed(chunked: DataFrame, carry: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows (value, how often in earlier chunks) that a chunk's median starts from."""
    value = f"_v_{name}"
    places = carry.select(*keys, "_chunk", "_pos")
    last = carry.groupBy(*keys).agg(F.max("_pos").alias("_to"))
    seen = (
        chunked.where(F.col(value).isNotNull())
        .join(places, [*keys, "_chunk"])
        .groupBy(*keys, "_pos", value)
        .agg(F.sum("_freq").alias("n"))
    )
    by_value = W.partitionBy(*keys, value).orderBy("_pos")
    grown = seen.join(last, keys).select(
        *keys,
        value,
        F.sum("n").over(by_value.rowsBetween(W.unboundedPreceding, 0)).alias("_freq"),
        (F.col("_pos") + 1).alias("_first"),
        F.coalesce(F.lead("_pos").over(by_value), F.col("_to")).alias("_last"),
    ).where(F.col("_first") <= F.col("_last"))
    spread = grown.select(*keys, value, "_freq", F.lit(0).alias("_seed"), F.explode(F.sequence("_first", "_last")).alias("_pos"))
    return spread.join(places, [*keys, "_pos"]).drop("_pos")


def _with_seed(body: DataFrame, seed: DataFrame, carry: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add the seed rows of a median, with all values cut to where it can lie.

    With w earlier and m own values, the median of any row of the chunk lies
    between the earlier values of rank (w - m) / 2 and (w + m) / 2. Cutting every
    value to that span keeps the median and leaves few distinct values, which is
    what the running percentile costs by.
    """
    value = f"_v_{name}"
    at = [*keys, "_chunk"]
    grown = W.partitionBy(*at).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = seed.join(carry.select(*at, f"_m_{name}"), at).select(
        *at,
        value,
        "_freq",
        F.sum("_freq").over(grown).alias("_upto"),
        F.sum("_freq").over(W.partitionBy(*at)).alias("_w"),
        F.col(f"_m_{name}").alias("_m"),
    )
    low, high = F.floor((F.col("_w") - F.col("_m")) / 2) - 1, F.ceil((F.col("_w") + F.col("_m")) / 2) + 1
    # One row per carry row at most.
    span = ranked.groupBy(*at).agg(
        F.max(F.when(F.col("_upto") - F.col("_freq") <= low, F.col(value))).alias("_low"),
        F.min(F.when(F.col("_upto") > high, F.col(value))).alias("_high"),
    )
    span = materialise(span, "span")

    def cut(rows: DataFrame) -> DataFrame:
        # least and greatest skip a missing bound.
        inside = F.greatest(F.least(F.col(value), F.col("_high")), F.col("_low"))
        joined = rows.join(span, at, "left")
        return joined.withColumn(value, F.when(F.col(value).isNotNull(), inside)).drop("_low", "_high")

    few = cut(seed).groupBy(*at, "_seed", value).agg(F.sum("_freq").alias("_freq"))
    return cut(body).unionByName(few, allowMissingColumns=True)
