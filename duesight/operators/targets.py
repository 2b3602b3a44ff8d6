"""Inputs of a run: target invoices, the history of their parties, their receipts.

Id lists are joins, nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesight.functions.cleaning import keep_first, midnight
from duesight.operators.ledger import TARGET
from duesight.operators.skew import NO_SKEW, Skew, lookup_join
from duesight.plans.features import RawTables
from duesight.sources.tables import invoice_range_predicate, invoices_in_range, receipts_in_range


def target_ids(targets: DataFrame) -> DataFrame:
    return targets.select("CUSTOMER_TRX_ID").where(F.col("CUSTOMER_TRX_ID").isNotNull()).distinct()


def party_by_number(customer: DataFrame) -> DataFrame:
    """Party of a transaction number; the largest when there are several."""
    rows = customer.where(F.col("TRX_NUMBER").isNotNull())
    return rows.groupBy("TRX_NUMBER").agg(F.max("PARTY_ID").alias("_party_by_number"))


def fill_missing_party(targets: DataFrame, customer: DataFrame, skew: Skew = NO_SKEW) -> DataFrame:
    """Targets with PARTY_ID filled from the customer master where it is missing."""
    joined = lookup_join(targets, party_by_number(customer), "TRX_NUMBER", "CUSTOMER_TRX_ID", skew).drop("_lane")
    others = [c for c in targets.columns if c != "PARTY_ID"]
    return joined.select(*others, F.coalesce("PARTY_ID", "_party_by_number").alias("PARTY_ID"))


def target_parties(targets: DataFrame, customer: DataFrame, skew: Skew = NO_SKEW) -> DataFrame:
    filled = fill_missing_party(targets.select("CUSTOMER_TRX_ID", "TRX_NUMBER", "PARTY_ID"), customer, skew)
    return filled.select("PARTY_ID").where(F.col("PARTY_ID").isNotNull()).distinct()


def history_of_parties(invoice: DataFrame, parties: DataFrame, snapshot=None) -> DataFrame:
    """Invoices of the parties, up to the snapshot."""
    known = invoice if snapshot is None else invoice.where(F.col("TRX_DATE") <= midnight(snapshot))
    return known.join(parties, "PARTY_ID", "left_semi").select(*invoice.columns)


def union_history(targets: DataFrame, history: DataFrame) -> DataFrame:
    """Both, one row per id; a target row wins over a history row."""
    names = targets.columns
    order = ["_source", "TRX_DATE", *[c for c in names if c not in ("CUSTOMER_TRX_ID", "TRX_DATE")]]
    both = targets.withColumn("_source", F.lit(0)).unionByName(history.withColumn("_source", F.lit(1)))
    return keep_first(both, ["CUSTOMER_TRX_ID"], order).select(*names)


def targets_with_history(
    invoice: DataFrame, customer: DataFrame, time_range: str, snapshot=None, start=None, end=None,
    year: int | None = None, skew: Skew = NO_SKEW,
) -> DataFrame:
    """Targets and history in one pass over the invoices, instead of a union of two; TARGET tells them apart."""
    wanted = invoice_range_predicate(invoice, time_range, snapshot, start, end, year)
    parties = target_parties(invoice.where(wanted), customer, skew).withColumn("_wanted_party", F.lit(True))
    history = F.col("_wanted_party").isNotNull()
    if snapshot is not None:
        history = history & (F.col("TRX_DATE") <= midnight(snapshot))
    marked = lookup_join(invoice, parties, "PARTY_ID", "CUSTOMER_TRX_ID", skew)
    rows = marked.select(*invoice.columns, F.when(wanted, 0).when(history, 1).alias("_source"))
    names = invoice.columns
    order = ["_source", "TRX_DATE", *[c for c in names if c not in ("CUSTOMER_TRX_ID", "TRX_DATE")]]
    kept = keep_first(rows.where(F.col("_source").isNotNull()), ["CUSTOMER_TRX_ID"], order)
    return kept.select(*names, (F.col("_source") == 0).alias(TARGET))


def receipts_of(receipt: DataFrame, invoices: DataFrame, snapshot=None) -> DataFrame:
    """Distinct receipts of the invoices, with either date up to the snapshot."""
    rows = receipt
    if snapshot is not None:
        snap = midnight(snapshot)
        rows = rows.where((F.col("APPLY_DATE") <= snap) | (F.col("RECEIPT_DATE") <= snap))
    ids = target_ids(invoices).withColumnRenamed("CUSTOMER_TRX_ID", "_id")
    # The copies of a row share its id, so they collapse where the join has put them.
    return rows.join(ids, F.col("APPLIED_CUSTOMER_TRX_ID") == F.col("_id"), "left_semi").dropDuplicates()


def run_inputs(
    source: RawTables, time_range: str, snapshot=None, start=None, end=None, year: int | None = None,
    skew: Skew = NO_SKEW,
) -> RawTables:
    """The tables a run works on, and the ids it reports.

    The range `all` is a plain scan that keeps duplicate receipts; every other
    range adds the history of the target parties and removes exact copies.
    """
    targets = invoices_in_range(source.invoice, time_range, snapshot, start, end, year)
    ids = target_ids(targets)
    if time_range == "all":
        receipts = receipts_in_range(source.receipt, "all", snapshot)
        return RawTables(targets, receipts, source.customer, ids, quality=source.quality)
    invoices = targets_with_history(
        source.invoice, source.customer, time_range, snapshot, start, end, year, skew
    )
    return RawTables(invoices, receipts_of(source.receipt, invoices, snapshot), source.customer, ids, quality=source.quality)


def restrict_to_targets(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows of the ids. Rows that carry the flag of their run need no join."""
    if TARGET in rows.columns:
        return rows.where(TARGET).drop(TARGET)
    if ids is None:
        return rows
    return rows.join(ids.select("CUSTOMER_TRX_ID"), "CUSTOMER_TRX_ID", "left_semi").select(*rows.columns)
