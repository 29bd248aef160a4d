"""What is written: queue exports, report tables, versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import formula_guard


def export_queue(queue: DataFrame, path: str, kind: str = "json") -> None:
    """The queue as JSON lines or CSV; CSV cells that a spreadsheet would run get an apostrophe, null and empty stay apart."""
    if kind == "csv":
        guarded = queue.select(*[formula_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in queue.dtypes if not t.startswith(("array", "map", "struct"))])
        guarded.write.mode("overwrite").option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)
    elif kind == "json":
        queue.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def write_snapshot(df: DataFrame, path: str, run_id: int) -> None:
    """One run's snapshot beside the others; writing a run again replaces only its own."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot of the largest run (partition pruning: only its files are read)."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("run_id")).first()[0]
    return every.filter(F.col("run_id") == last).drop("run_id")


def report_tables(queue: DataFrame, strong: int = 55) -> dict[str, DataFrame]:
    """report_groups (one row an opening group, strongest first) and report_tail (what lies under the strong score)."""
    groups = queue.groupBy("group_key").agg(F.max("score").alias("score"), F.max_by("title", F.struct("score", "uid")).alias("title"), F.count(F.lit(1)).alias("sightings"))
    ranked = groups.orderBy(F.desc("score"), "group_key")
    return {"report_groups": ranked.filter(F.col("score") >= strong), "report_tail": ranked.filter(F.col("score") < strong)}


def newly_discovered(found: DataFrame, announced: DataFrame) -> DataFrame:
    """Boards that haven't been announced yet, once each (case doesn't tell boards apart)."""
    key = lambda df: df.select(F.lower("board").alias("key"), "board")
    return key(found).groupBy("key").agg(F.min("board").alias("board")).join(key(announced).select("key").distinct(), "key", "left_anti").select("board")
