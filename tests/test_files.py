"""Delivered CSV files: split when large, whole records only."""

import json

import pytest

from duesight.schemas import BRONZE_CUSTOMER
from duesight.session import scratch_path
from duesight.sources.files import read_customers, read_invoices

HEAD = "TRX_NUMBER,CUSTOMER_TRX_ID,TRX_AMOUNT,EXTRA"


def _file(spark, name, lines):
    path = scratch_path(spark, name)
    spark.createDataFrame([("\n".join([HEAD, *lines]),)], "value string").coalesce(1).write.text(path)
    return path


def test_one_large_file_is_read_by_several_tasks(spark):
    path = _file(spark, "large", [f'"N ""{i}"", x",{i},{i}.5,more' for i in range(20_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = read_invoices(spark, path)
        assert rows.rdd.getNumPartitions() >= 5 and rows.count() == 20_000
        assert rows.where('CUSTOMER_TRX_ID = "19999"').first()["TRX_NUMBER"] == 'N "19999", x'
        assert read_invoices(spark, path, line_breaks=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_with_line_breaks_need_the_argument(spark):
    path = _file(spark, "breaks", ['"two', 'lines",1,2.0,more', "N2,2,3.0,more"])
    assert {r["TRX_NUMBER"] for r in read_invoices(spark, path, line_breaks=True).collect()} == {"two\nlines", "N2"}
    with pytest.raises(Exception, match="MALFORMED"):
        read_invoices(spark, path).collect()


def test_a_json_array_is_read_in_parts(spark, tmp_path):
    """Braces and quotes in strings, nested objects and escapes, wherever the file is cut."""
    names = ['a}b{', 'q\\"}{"', "tail\\\\", "", "{[}],", "line\\n}", "plain"]
    records = []
    for i in range(60):
        more = {"x": {"y": [{"z": names[i % 7]}]}} if i % 3 == 0 else {}
        records.append({"PARTY_ID": str(i), "CUSTOMER_NAME": names[(i * 5) % 7], "ACCOUNT_NUMBER": None} | more)
    texts = {"flat": json.dumps(records), "lines": json.dumps(records, indent=1), "one": json.dumps(records[0]), "none": "[]"}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for name, text in texts.items():
            path = tmp_path / f"{name}.json"
            path.write_text(text)
            want = spark.read.schema(BRONZE_CUSTOMER).option("multiLine", True).json(str(path)).collect()
            for size in ("97b", "1k", was):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                spark.conf.set("spark.sql.files.openCostInBytes", "64")
                frame = read_customers(spark, str(path))
                assert sorted(map(repr, frame.collect())) == sorted(map(repr, want)), (name, size)
            if name == "flat":
                spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
                assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
