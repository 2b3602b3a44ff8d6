"""The raw tables laid out by party, so that a batch of receipts reads the parties it touches and little else.

Every invoice row lives in the part of its party's hash; without a party, in that of its id. Receipts live with their
invoice. An id whose rows live in several parts has its receipts in SHARED, which every batch reads; receipts of ids that
aren't known lie in UNKNOWN, which none reads. Credit memos and their receipts stand a second time beside the original
invoice, for netting across parties. `ids` says by a hash of the id where things are.

Batches name parts in literal partition filters: what reaches the driver are part numbers, `parts` of them at most.
Appended receipts stand under their batch's number, so a repeated append replaces itself. Invoices are fixed once
written; nulls, repeated rows and copies of receipts are kept as they are. All customers are read by every batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duesight.operators.invoices import clean_invoices
from duesight.operators.targets import target_ids
from duesight.plans.features import RawTables
from duesight.schemas import INVOICE, RECEIPT
from duesight.session import CODEC, shuffles_cleared

SHARED, UNKNOWN = -1, -2
#: The number under which the first receipts stand.
FIRST = -1
NARROW = ["CUSTOMER_TRX_ID", "PARTY_ID", "PREVIOUS_CUSTOMER_TRX_ID"]
APPLIED = "APPLIED_CUSTOMER_TRX_ID"


@dataclass(frozen=True)
class PartyTables:
    spark: SparkSession
    path: str
    customer: DataFrame | None = None
    parts: int = 256

    def part(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(*keys)), F.lit(self.parts)).cast("int")

    def _home(self) -> Column:
        return self.part("PARTY_ID", "CUSTOMER_TRX_ID")

    def _save(self, name: str, rows: DataFrame, *by: str) -> None:
        with shuffles_cleared(self.spark):
            rows.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").option("compression", CODEC).parquet(f"{self.path}/{name}")

    def _scan(self, name: str, columns: StructType | str, keys: str) -> DataFrame:
        text = columns if isinstance(columns, str) else _ddl(columns)
        return self.spark.read.schema(f"{text}, {keys}").parquet(f"{self.path}/{name}")

    def write(self, raw: RawTables) -> None:
        rows = clean_invoices(raw.invoice).withColumn("_part", self._home())
        self._save("invoices", rows, "_part")

        def one(part: str) -> Column:
            return F.when(F.min(part) == F.max(part), F.min(part)).otherwise(SHARED)

        known = rows.where(F.col("CUSTOMER_TRX_ID").isNotNull())
        homes = known.groupBy("CUSTOMER_TRX_ID").agg(one("_part").alias("_home"))
        original = homes.select(F.col("CUSTOMER_TRX_ID").alias("PREVIOUS_CUSTOMER_TRX_ID"), F.col("_home").alias("_beside"))
        memos = rows.where(F.col("PREVIOUS_CUSTOMER_TRX_ID").isNotNull()).join(original, "PREVIOUS_CUSTOMER_TRX_ID")
        self._save("memos", memos.select(*INVOICE.names, F.col("_part").alias("_own"), F.col("_beside").alias("_part")), "_part")
        beside = memos.where(F.col("CUSTOMER_TRX_ID").isNotNull()).groupBy("CUSTOMER_TRX_ID").agg(one("_beside").alias("_beside"))
        places = homes.join(beside, "CUSTOMER_TRX_ID", "left")
        ids = known.select(*NARROW).distinct().join(places, "CUSTOMER_TRX_ID").withColumn("_id_part", self.part("CUSTOMER_TRX_ID"))
        self._save("ids", ids, "_id_part")
        self._save_receipts(raw.receipt, places, FIRST)

    def _save_receipts(self, receipt: DataFrame, places: DataFrame, number: int) -> None:
        at = F.lit(number).cast("bigint").alias("_batch")
        rows = receipt.select(*[F.col(f.name).cast(f.dataType) for f in RECEIPT])
        placed = rows.where(F.col(APPLIED).isNotNull()).join(places.withColumnRenamed("CUSTOMER_TRX_ID", APPLIED), APPLIED, "left")
        names = RECEIPT.names
        nowhere = rows.where(F.col(APPLIED).isNull()).select(*names, at, F.lit(UNKNOWN).alias("_part"))
        own = placed.select(*names, at, F.coalesce("_home", F.lit(UNKNOWN)).alias("_part"))
        self._save("receipts", own.unionByName(nowhere), "_batch", "_part")
        memos = placed.where(F.col("_beside").isNotNull())
        self._save("memo_receipts", memos.select(*names, F.col("_home").alias("_own"), at, F.col("_beside").alias("_part")), "_batch", "_part")

    def _ids(self, wanted: DataFrame) -> DataFrame:
        """The rows of `ids` of the wanted ids, from the parts they lie in."""
        parts = _numbers(wanted.select(self.part("CUSTOMER_TRX_ID")))
        rows = self._scan("ids", "CUSTOMER_TRX_ID bigint, PARTY_ID bigint, PREVIOUS_CUSTOMER_TRX_ID bigint, _home int, _beside int", "_id_part int")
        return rows.where(F.col("_id_part").isin(parts)).join(target_ids(wanted), "CUSTOMER_TRX_ID", "left_semi")

    def append(self, receipts: DataFrame, number: int) -> None:
        wanted = receipts.select(F.col(APPLIED).alias("CUSTOMER_TRX_ID")).where(F.col(APPLIED).isNotNull())
        self._save_receipts(receipts, self._ids(wanted).select("CUSTOMER_TRX_ID", "_home", "_beside").distinct(), number)

    def hit(self, receipts: DataFrame) -> DataFrame:
        """`hit_invoices` of the receipts."""
        wanted = receipts.select(F.col(APPLIED).alias("CUSTOMER_TRX_ID")).where(F.col(APPLIED).isNotNull())
        paid = self._ids(wanted).select(*NARROW)
        originals = paid.select(F.col("PREVIOUS_CUSTOMER_TRX_ID").alias("CUSTOMER_TRX_ID")).where(F.col("CUSTOMER_TRX_ID").isNotNull())
        return paid.unionByName(self._ids(originals).select(*NARROW))

    def around(self, hit: DataFrame) -> RawTables:
        """The tables as far as the parties of the hit invoices need them: their parts, with all receipts appended so far."""
        parts = _numbers(hit.select(self._home()))
        also = [*parts, SHARED]
        here = F.col("_part").isin(also)
        invoices = self._scan("invoices", INVOICE, "_part int").where(F.col("_part").isin(parts)).select(*INVOICE.names)
        memos = self._scan("memos", f"{_ddl(INVOICE)}, _own int", "_part int").where(here & ~F.col("_own").isin(parts))
        receipts = self._scan("receipts", RECEIPT, "_batch bigint, _part int").where(here).select(*RECEIPT.names)
        theirs = self._scan("memo_receipts", f"{_ddl(RECEIPT)}, _own int", "_batch bigint, _part int").where(here & ~F.col("_own").isin(also))
        return RawTables(
            invoices.unionByName(memos.select(*INVOICE.names)), receipts.unionByName(theirs.select(*RECEIPT.names)), self.customer)

    def everything(self) -> RawTables:
        """All invoices and receipts."""
        invoices = self._scan("invoices", INVOICE, "_part int").select(*INVOICE.names)
        receipts = self._scan("receipts", RECEIPT, "_batch bigint, _part int").select(*RECEIPT.names)
        return RawTables(invoices, receipts, self.customer)


def _ddl(columns: StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)


def _numbers(parts: DataFrame) -> list[int]:
    """Distinct part numbers, a few hundred at most."""
    return sorted(r[0] for r in parts.distinct().collect() if r[0] is not None)
