"""Feature tables for a snapshot date, from raw invoices, receipts and customers."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesight.functions.cleaning import holds, midnight, plus_days
from duesight.operators.customers import attach_customers, base_invoices
from duesight.operators.features import asof_columns, pre_due_columns
from duesight.operators.history import in_pool, invoice_history, party_history, pooled_history
from duesight.operators.invoices import clean_invoices
from duesight.operators.ledger import invoice_core, ledger, with_payment_facts
from duesight.operators.quality import Quality
from duesight.operators.receipts import PAYMENT_FACTS, base_payments
from duesight.operators.skew import TASK_ROWS, Skew, measure_skew
from duesight.settings import OBSERVE_MIN_DAYS


@dataclass(frozen=True)
class RawTables:
    """The three input tables; `target_ids` restricts what a run returns.

    `has_memos` says whether there are credit memos at all where the invoices are part of a larger table;
    `quality` gathers the counters of the cleaning.
    """

    invoice: DataFrame
    receipt: DataFrame
    customer: DataFrame | None = None
    target_ids: DataFrame | None = None
    has_memos: bool | None = None
    quality: Quality | None = None


def base_tables(raw: RawTables, snapshot, repair_years: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clean invoices (unique, netted, with customer columns) and payments."""
    core = invoice_core(raw.invoice, raw.receipt, snapshot)
    return base_invoices(core, raw.customer), base_payments(raw.receipt, snapshot, repair_years)


def _facts(raw: RawTables, core: DataFrame, snapshot, as_of_col: str, prefix: str, skew: Skew) -> DataFrame:
    """Payment facts first, by invoice id as the core is; customers next, ending by party."""
    return attach_customers(with_payment_facts(core, snapshot, as_of_col, prefix), raw.customer, skew)


def _ledger(raw: RawTables, snapshot) -> DataFrame:
    return ledger(raw.invoice, raw.receipt, snapshot, has_memos=raw.has_memos, quality=raw.quality)


def party_skew(raw: RawTables) -> Skew:
    """Rows per party of the raw invoices, an upper bound of what is windowed, and per transaction number."""
    return measure_skew(clean_invoices(raw.invoice), "PARTY_ID", "TRX_NUMBER")


def snapshot_facts(raw: RawTables, snapshot, skew: Skew) -> DataFrame:
    """Invoices with customer columns and payment facts, before any history."""
    return _facts(raw, _ledger(raw, snapshot), snapshot, "AS_OF_DATE", "pre_due", skew)


def snapshot_features(
    raw: RawTables, snapshot, skew: Skew | None = None, keep_facts: bool = False
) -> DataFrame:
    """The production feature table: one row per invoice."""
    skew = party_skew(raw) if skew is None else skew
    facts = snapshot_facts(raw, snapshot, skew)
    hist = party_history(facts, snapshot, skew=skew)
    rows = hist.select("*", *pre_due_columns())
    return rows if keep_facts else rows.drop(*PAYMENT_FACTS)


def monitoring_features(
    raw: RawTables,
    snapshot,
    observe_min_days: int = OBSERVE_MIN_DAYS,
    asof_to_snapshot: bool = True,
    skew: Skew | None = None,
) -> DataFrame:
    """Features as of the snapshot, or as of a fixed age capped by the snapshot."""
    skew = party_skew(raw) if skew is None else skew
    snap = midnight(snapshot)
    core = _ledger(raw, snapshot).drop("AS_OF_DATE")
    aged = plus_days(F.col("TRX_DATE"), observe_min_days)
    as_of = snap if asof_to_snapshot else F.when(aged > snap, snap).otherwise(aged)
    core = core.withColumn("AS_OF_DATE_MON", as_of)
    facts = _facts(raw, core, snapshot, "AS_OF_DATE_MON", "mon", skew)
    hist = party_history(facts, snapshot, skew=skew)
    oldest = midnight(dt.date.fromisoformat(str(snapshot)) - dt.timedelta(days=observe_min_days))
    return hist.select(
        "*",
        *asof_columns("AS_OF_DATE_MON", "mon"),
        holds(F.col("TRX_DATE") <= oldest).alias("mon_observable"),
    ).drop(*PAYMENT_FACTS)


def pooled_snapshot_features(raw: RawTables, snapshot, skew: Skew | None = None) -> DataFrame:
    """Snapshot features plus the pooled variant under the prefix `pooled_`, from the same rows.

    A party outside the pool has the same earlier invoices in both, so one window gives both. Up to TASK_ROWS invoices
    all rows are put in order once more; beyond, only those of the pool, and both parts read the exchanges by id.
    """
    skew = party_skew(raw) if skew is None else skew
    if skew.total_rows <= TASK_ROWS:
        base = snapshot_features(raw, snapshot, skew, keep_facts=True)
        return pooled_history(invoice_history(base), pooled_skew(raw), [c for c in base.columns if c not in PAYMENT_FACTS])
    hist = party_history(snapshot_facts(raw, snapshot, skew), snapshot, skew=skew, pooled=True)
    rows = hist.select("*", *pre_due_columns())
    pooled = [c for c in rows.columns if c.startswith("pooled_")]
    names = [c for c in rows.columns if c not in (*PAYMENT_FACTS, *pooled)]
    pool = pooled_history(invoice_history(rows.where(in_pool()).drop(*pooled)), pooled_skew(raw, True), names)
    return rows.where(~in_pool()).select(*names, *pooled).unionByName(pool)


def pooled_skew(raw: RawTables, pool_only: bool = False) -> Skew:
    """As party_skew, with the invoices without a party counted as one party; or of that party alone."""
    rows = clean_invoices(raw.invoice)
    pooled = (rows.where(in_pool()) if pool_only else rows).select(F.coalesce("PARTY_ID", F.lit(-1)).alias("PARTY_ID"))
    return measure_skew(pooled, "PARTY_ID")
