"""Tables that survive lost executors: written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: A write's shuffles are of no use after it; without this they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whole texts and sets go to Python some 4 MB at a time instead of 10,000 rows: a batch stands in the JVM's buffers and in the worker at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, one of our own on a single machine (tests); a cluster
    must name one that all of its machines share.
    """
    own = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} is unset: name a folder that all machines of the cluster share")
        own = tempfile.mkdtemp(prefix="openings-")
        spark.conf.set(SETTING, own)
    return own.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, also: dict[str, str] | None = None) -> Iterator[None]:
    """What Spark runs within gives Python its rows in batches of BATCH_BYTES; other settings may be held for that time, too."""
    held = {BATCH: str(BATCH_BYTES)} | (also or {})
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def durable(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet under the shared folder and read again: it cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that durable() made, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
