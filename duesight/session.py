"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Skips recording the Python call site of every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The JVM never compiles a longer method: such a stage goes through its operators one by one, which it does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "duesight", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that results, or their cost, depend on to a session made elsewhere, and name a folder to a local one
    without."""
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(key, SQL_CONF[key])
    unset = not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir()
    if unset and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Of intermediate tables and stored states; denser than the default.
CODEC = "zstd"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Each write in the block removes its own shuffle files at its end. Else they stay until the driver collects garbage,
    which a large heap puts off while the files of all steps of a job pile up."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends, values are fixed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_cleared(spark):
        df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
