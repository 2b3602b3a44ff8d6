"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesight.session import materialise

#: Rows that one task may take: a table of no more is read as one partition, so that joins and sums need no exchange.
ALONE = 1_000_000


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table, in one partition if it is small."""
    out = materialise(df, name)
    return out.coalesce(1) if out.count() <= ALONE else out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that can be reached, for every node with an edge to another.

    Each round hangs the larger neighbours of a node below its smallest one, then the smaller ones. Minima are
    aggregated before they move, and the joins can be split by Spark, so a node of very many edges does no harm. A
    round that changes nothing ends it. Every round is a written table.
    """
    rows = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    rows = settled(rows, "edges")
    last = None
    while True:
        state = rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
        both = rows.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias(
            "e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settled(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .where("u > v").distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rows = settled(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return rows.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        rows.select("v", "v").distinct())
