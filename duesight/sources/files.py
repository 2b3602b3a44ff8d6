"""Readers for delivered files. Everything arrives as text and is typed later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duesight.functions.cleaning import normalise_name
from duesight.plans.features import RawTables
from duesight.schemas import BRONZE_CUSTOMER, BRONZE_INVOICE, BRONZE_RECEIPT

# File endings and the reader they stand for.
FORMATS = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "json": "json", "jsonl": "jsonl"}


# A quote inside a quoted field is doubled.
CSV = {"header": True, "escape": '"'}


def _csv(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = False) -> DataFrame:
    """By header name: columns may be in any order, more or fewer than the schema's.

    Files of one folder must have the same header; another one is an error. Large
    files are split, so a line must be a record: one with more or fewer fields than
    the header is an error, as the parts of a record with a line break are. With
    `line_breaks` fields may hold them, and a file is read by one task.
    """
    header = spark.read.options(**CSV).csv(path).schema
    # Fields are counted only where all columns are parsed.
    reader = spark.read.options(**CSV, multiLine=line_breaks, columnPruning=line_breaks,
                                mode="PERMISSIVE" if line_breaks else "FAILFAST")
    found = reader.schema(header).option("enforceSchema", False).csv(path)
    return found.select(
        *[(F.col(f.name) if f.name in found.columns else F.lit(None).cast("string")).alias(f.name) for f in schema]
    )


def read_invoices(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    return _csv(spark, path, BRONZE_INVOICE, line_breaks)


def read_receipts(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    return _csv(spark, path, BRONZE_RECEIPT, line_breaks)


def infer_format(name: str | None) -> str | None:
    ending = (name or "").lower().rpartition(".")
    return FORMATS.get(ending[2]) if ending[1] else None


def read_customers(
    spark: SparkSession, path: str, name: str | None = None, file_format: str | None = None, line_breaks: bool = False
) -> DataFrame:
    """A given format wins over the file ending; without either it is a JSON array."""
    kind = file_format or infer_format(name or path)
    if kind == "csv":
        return _csv(spark, path, BRONZE_CUSTOMER, line_breaks)
    if kind == "parquet":
        found = spark.read.parquet(path)
        have = [c for c in BRONZE_CUSTOMER.names if c in found.columns]
        return found.select(*[F.col(c).cast("string").alias(c) for c in have])
    if kind == "jsonl":
        return spark.read.schema(BRONZE_CUSTOMER).json(path)
    return _json_objects(spark, path, BRONZE_CUSTOMER)


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _json_objects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of JSON arrays (or single objects), one row each, large files split at any closing brace.

    A brace within a string or a nested object ends no record, so the pieces of a file say how many quotes and braces
    stand before each: within a part of a file by windows, for both cases of its start (`_0`: outside a string, `_1`:
    inside), and over the parts by a row for each. A record of several pieces is put together by its first piece.
    """
    part, before = ["_file", "_part"], W.unboundedPreceding
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"),
        F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    along = W.partitionBy(*part).orderBy("_id")
    # No escape reaches over a brace.
    plain = pieces.withColumn("_plain", F.regexp_replace("value", r"(?s)\\.", "")).withColumn("_quotes", _count(F.col("_plain"), '"'))
    rows = plain.withColumn("_odd", F.coalesce(F.sum("_quotes").over(along.rowsBetween(before, -1)), F.lit(0)) % 2)
    for k in (0, 1):
        inside = (F.col("_odd") + k) % 2 == 1
        outside = F.when(inside, F.regexp_replace("_plain", r'(?s)^[^"]*("|$)', "")).otherwise(F.col("_plain"))
        outside = F.regexp_replace(outside, r'(?s)"[^"]*("|$)', "")
        shut = (F.col("_odd") + k + F.col("_quotes")) % 2 == 0
        rows = rows.withColumns({f"_open_{k}": _count(outside, "{"), f"_shut_{k}": shut.cast("int")})
    rows = rows.drop("_plain").withColumns(
        {f"_depth_{k}": F.sum(F.col(f"_open_{k}") - F.col(f"_shut_{k}")).over(along.rowsBetween(before, 0)) for k in (0, 1)})
    # A row for each part of a file from here on.
    ends = rows.groupBy(*part).agg(
        (F.sum("_quotes") % 2).alias("_odd"), *[F.sum(F.col(f"_open_{k}") - F.col(f"_shut_{k}")).alias(f"_sum_{k}") for k in (0, 1)])
    parts = W.partitionBy("_file").orderBy("_part").rowsBetween(before, -1)
    ends = ends.withColumn("_start", F.coalesce(F.sum("_odd").over(parts), F.lit(0)) % 2)
    deep = F.when(F.col("_start") == 0, F.col("_sum_0")).otherwise(F.col("_sum_1"))
    ends = ends.select(*part, "_start", F.coalesce(F.sum(deep).over(parts), F.lit(0)).alias("_deep"))

    def of_start(name: str) -> Column:
        return F.when(F.col("_start") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))

    after = F.col("_deep") + of_start("_depth")
    known = rows.join(ends, part).select(
        *part, "_id", "value", of_start("_open").alias("_open"), after.alias("_after"),
        (after - of_start("_open") + of_start("_shut")).alias("_before"))
    known = known.where((F.col("_before") > 0) | (F.col("_open") > 0))
    whole = (F.col("_before") == 0) & (F.col("_after") == 0)
    some = known.where(~whole)
    first = F.when(F.col("_before") == 0, F.col("_id"))
    carried = some.groupBy(*part).agg(F.max(first).alias("_first")).select(
        *part, F.last("_first", True).over(parts).alias("_carried"))
    key = F.coalesce(F.last(first, True).over(along.rowsBetween(before, 0)), F.col("_carried"))
    joined = some.join(carried, part).withColumn("_key", key).groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("_part", "_id", "value"))).alias("_all"))
    texts = known.where(whole).select("value").unionByName(
        joined.select(F.array_join(F.transform("_all", lambda p: p["value"]), "}").alias("value")))
    # What stands before a record is the array's bracket or a comma.
    record = F.concat(F.regexp_replace("value", r"^[^{]*", ""), F.lit("}"))
    return texts.select(F.from_json(record, schema).alias("_record")).select("_record.*")


def load_raw_tables(
    spark: SparkSession,
    invoice_path: str,
    receipt_path: str,
    customer_path: str | None = None,
    customer_name: str | None = None,
    customer_format: str | None = None,
    line_breaks: bool = False,
) -> RawTables:
    customer = None
    if customer_path is not None:
        customer = read_customers(spark, customer_path, customer_name, customer_format, line_breaks)
    return RawTables(read_invoices(spark, invoice_path, line_breaks), read_receipts(spark, receipt_path, line_breaks), customer)


def read_excluded_names(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of names in any number of columns."""
    return spark.read.options(**{**CSV, "header": False}).csv(path)


def excluded_keys(names: DataFrame) -> DataFrame:
    """All cells of all columns as one set of normalised names, blanks dropped."""
    cells = names.select(F.explode(F.array(*[F.col(c).cast("string") for c in names.columns])).alias("cell"))
    keys = cells.select(normalise_name(F.col("cell")).alias("name_key"))
    return keys.where(F.col("name_key") != "").distinct()
