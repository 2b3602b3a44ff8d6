"""Leaving out affiliated customers by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesight.functions.cleaning import normalise_name


def exclude_affiliates(rows: DataFrame, keys: DataFrame, name_col: str = "CUSTOMER_NAME") -> DataFrame:
    """Rows whose normalised name is not among the keys; blank names always stay.

    Spark broadcasts the key list when it is small, which it decides by size.
    """
    keyed = rows.withColumn("_name_key", normalise_name(F.col(name_col)))
    # Blank names match nothing; they are spread by row, so that they are no hot key.
    spread = F.when(F.col("_name_key") == "", F.xxhash64(*rows.columns)).otherwise(F.lit(0))
    named = keys.select("name_key", F.lit(0).cast("bigint").alias("_spread_key"))
    matched = (F.col("_name_key") == F.col("name_key")) & (F.col("_spread") == F.col("_spread_key"))
    return keyed.withColumn("_spread", spread).join(named, matched, "left_anti").select(*rows.columns)
