"""Tables laid out by party against scans of the whole ones."""

from dataclasses import replace

from pyspark.sql import functions as F

from duesight.checks.fixtures import raw_tables
from duesight.plans.features import RawTables
from duesight.session import materialise, scratch_path
from duesight.sources.by_party import PartyTables
from duesight.streaming.receipt_trigger import hit_invoices, touched_invoices


def mixed_up(spark, sf_dir):
    """Memos of other parties and of none, ids with rows of two parties, repeated and empty rows."""
    raw = raw_tables(spark, sf_dir)
    memo, key = F.col("PREVIOUS_CUSTOMER_TRX_ID").isNotNull(), F.col("CUSTOMER_TRX_ID")
    moved = F.when(memo & (key % 3 == 0), F.col("PARTY_ID") + 1).when(~memo | (key % 3 == 1), F.col("PARTY_ID"))
    invoice = raw.invoice.withColumn("PARTY_ID", moved)
    twice = invoice.where(key % 40 == 0).withColumn("PARTY_ID", F.col("PARTY_ID") + 7)
    other_original = invoice.where(memo & (key % 11 == 0)).withColumn("PREVIOUS_CUSTOMER_TRX_ID", F.col("PREVIOUS_CUSTOMER_TRX_ID") + 32)
    copies = invoice.where(key % 50 == 0)
    nothing = invoice.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in invoice.schema])
    rows = invoice.unionByName(twice).unionByName(other_original).unionByName(copies).unionByName(nothing)
    unknown = raw.receipt.limit(3).withColumn("APPLIED_CUSTOMER_TRX_ID", F.lit(-9).cast("bigint"))
    missing = raw.receipt.limit(2).withColumn("APPLIED_CUSTOMER_TRX_ID", F.lit(None).cast("bigint"))
    receipts = raw.receipt.unionByName(raw.receipt.limit(20)).unionByName(unknown).unionByName(missing)
    return RawTables(materialise(rows, "invoice"), materialise(receipts, "receipt"), raw.customer)


def same(a, b):
    names = sorted(a.columns)
    return sorted(map(repr, a.select(names).collect())) == sorted(map(repr, b.select(names).collect()))


def of_ids(receipts, invoices):
    ids = invoices.select(F.col("CUSTOMER_TRX_ID").alias("APPLIED_CUSTOMER_TRX_ID")).distinct()
    return receipts.join(ids, "APPLIED_CUSTOMER_TRX_ID", "left_semi")


def test_parts_hold_what_a_batch_needs(spark, sf_dir):
    raw = mixed_up(spark, sf_dir)
    late = F.col("APPLIED_CUSTOMER_TRX_ID") % 9 == 0
    tables = PartyTables(spark, scratch_path(spark, "tables"), parts=32)
    tables.write(replace(raw, receipt=raw.receipt.where(~F.coalesce(late, F.lit(False)))))
    for _ in range(2):  # a repeated batch changes nothing
        tables.append(raw.receipt.where(late), 3)
    everything = tables.everything()
    assert same(everything.invoice, raw.invoice) and same(everything.receipt, raw.receipt.select(everything.receipt.columns))
    applied = F.col("APPLIED_CUSTOMER_TRX_ID")
    memos = raw.receipt.where(applied > 1_000_000_000).orderBy(applied).limit(4)
    shared = raw.receipt.where(applied % 40 == 0).orderBy(applied).limit(2)
    for batch in (raw.receipt.orderBy(applied.desc_nulls_last()).limit(1), memos, shared, raw.receipt.limit(0),
                  raw.receipt.where((applied == -9) | applied.isNull())):
        batch = materialise(batch, "batch")
        hit = tables.hit(batch)
        assert same(hit.distinct(), hit_invoices(batch, raw.invoice).distinct())
        near = tables.around(materialise(hit, "hit"))
        want = touched_invoices(batch, raw.invoice)
        got = touched_invoices(batch, near.invoice, hit)
        assert same(got, want)
        assert same(of_ids(near.receipt, got), of_ids(raw.receipt.select(near.receipt.columns), want))


def test_a_batch_names_its_parts(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    tables = PartyTables(spark, scratch_path(spark, "tables"), parts=32)
    tables.write(raw)
    batch = materialise(raw.receipt.where("APPLIED_CUSTOMER_TRX_ID IS NOT NULL").limit(1), "batch")
    near = tables.around(materialise(tables.hit(batch), "hit"))
    for rows in (near.invoice, near.receipt):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        scans = plan.split("FileScan")[1:]
        assert len(scans) == 2 and all("_part" in s[s.index("PartitionFilters") :].split("PushedFilters")[0] for s in scans)
    assert 0 < near.invoice.count() < raw.invoice.count() / 4 and near.receipt.count() < raw.receipt.count() / 4


def test_empty_tables(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    tables = PartyTables(spark, scratch_path(spark, "tables"), parts=4)
    tables.write(RawTables(raw.invoice.limit(0), raw.receipt.limit(0)))
    tables.append(raw.receipt.limit(2), 0)
    assert tables.everything().invoice.count() == 0 and tables.everything().receipt.count() == 2
    assert tables.hit(raw.receipt.limit(2)).count() == 0
