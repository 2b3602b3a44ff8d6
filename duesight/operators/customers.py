"""Customer master: one row per key, and the join to invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesight.functions.cleaning import keep_first, to_id, with_missing_columns
from duesight.operators.skew import NO_SKEW, Skew, lookup_join
from duesight.schemas import CUSTOMER


def clean_customers(customer: DataFrame) -> DataFrame:
    df = with_missing_columns(customer, CUSTOMER)
    return df.select(
        to_id(df, "PARTY_ID").alias("PARTY_ID"),
        *[F.col(c).cast("string").alias(c) for c in ("ACCOUNT_NUMBER", "TRX_NUMBER", "CUSTOMER_NAME", "BU_NAME")],
    )


def customer_per_party(customer: DataFrame) -> DataFrame:
    """First row per party, ordered by every column."""
    keep = ["ACCOUNT_NUMBER", "CUSTOMER_NAME", "BU_NAME"]
    rows = customer.where(F.col("PARTY_ID").isNotNull())
    return keep_first(rows, ["PARTY_ID"], ["TRX_NUMBER", *keep]).select("PARTY_ID", *keep)


def customer_per_number(customer: DataFrame) -> DataFrame:
    """First row per transaction number; a missing number never matches."""
    keep = ["PARTY_ID", "ACCOUNT_NUMBER"]
    rows = customer.where(F.col("TRX_NUMBER").isNotNull()).select("TRX_NUMBER", *keep)
    return keep_first(rows, ["TRX_NUMBER"], keep)


def attach_customers(invoice: DataFrame, customer: DataFrame | None, skew: Skew = NO_SKEW) -> DataFrame:
    """Add ACCOUNT_NUMBER, CUSTOMER_NAME, SBU and cust_master_missing.

    The party's row gives all three, the row of the transaction number is a
    second chance for the account. The party join comes last, so that the
    windows that follow find the rows already partitioned by party.
    """
    if customer is None:
        null = F.lit(None).cast("string")
        return invoice.select(
            "*", null.alias("ACCOUNT_NUMBER"), null.alias("CUSTOMER_NAME"), null.alias("SBU"),
            F.lit(1).alias("cust_master_missing"),
        )
    clean = clean_customers(customer)
    by_number = customer_per_number(clean).select(
        "TRX_NUMBER", F.col("ACCOUNT_NUMBER").alias("_account_by_number"), F.lit(1).alias("_in_numbers")
    )
    by_party = customer_per_party(clean).withColumn("_in_parties", F.lit(1))
    rows = lookup_join(invoice, by_number, "TRX_NUMBER", "CUSTOMER_TRX_ID", skew).drop("_lane")
    rows = lookup_join(rows, by_party, "PARTY_ID", "CUSTOMER_TRX_ID", skew)
    return rows.select(
        *invoice.columns,
        F.coalesce("ACCOUNT_NUMBER", "_account_by_number").alias("ACCOUNT_NUMBER"),
        "CUSTOMER_NAME",
        F.col("BU_NAME").alias("SBU"),
        F.when(F.coalesce("_in_parties", "_in_numbers").isNull(), 1).otherwise(0).alias("cust_master_missing"),
        "_lane",
    )


def base_invoices(core: DataFrame, customer: DataFrame | None, skew: Skew = NO_SKEW) -> DataFrame:
    return attach_customers(core, customer, skew).drop("_lane")
