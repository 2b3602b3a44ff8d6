"""Quality counters of the cleaning steps, gathered by the pass that cleans.

A `Quality` on the raw tables is filled by the first action that runs their ledger; no row is read for it alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from duesight.functions.cleaning import to_id, to_number, to_timestamp


class Quality:
    """Counts of what the cleaning could not read, once an action has run."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def _watch(self, rows: DataFrame, **counts: Column) -> DataFrame:
        seen = Observation()
        self._seen.append(seen)
        return rows.observe(seen, *[c.alias(n) for n, c in counts.items()])

    def watch_invoices(self, invoice: DataFrame) -> DataFrame:
        """Rows, ids and dates that are no such, and missing amounts of invoices as they are delivered."""

        def lost(read, name: str) -> Column:
            return F.count_if(F.col(name).isNotNull() & read(invoice, name).isNull())

        return self._watch(
            invoice, invoice_rows=F.count("*"), bad_ids=lost(to_id, "CUSTOMER_TRX_ID"), bad_dates=lost(to_timestamp, "TRX_DATE"),
            null_amounts=F.count_if(to_number(invoice, "TRX_AMOUNT").isNull()))

    def watch_repairs(self, receipt: DataFrame, was: str, now: str) -> DataFrame:
        """Rows, and dates for which there is no repair, of receipts with a date before and after."""
        return self._watch(
            receipt, receipt_rows=F.count("*"), bad_repairs=F.count_if(F.col(was).isNotNull() & F.col(now).isNull()))

    def counts(self) -> dict[str, int]:
        return {name: n for seen in self._seen for name, n in seen.get.items()}
