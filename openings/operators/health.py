"""Health of sources: a fold of their runs, verdicts, and which of them may retire openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
STALE_DAYS, COLLAPSE_LEAST, COLLAPSE_SHARE, ERROR_CHARS, BROKEN_AFTER = 7, 10, 0.5, 300, 2


def fold_health(runs: DataFrame) -> DataFrame:
    """One row a source: last_ok, last_count, last_error, consecutive_failures, prev_count (the count of the last complete run before the latest).

    runs: source, at, run_id, count, error (null: complete).
    """
    w = Window.partitionBy("source").orderBy("at", "run_id")
    ok = F.col("error").isNull()
    marked = runs.select(
        "*",
        F.last(F.when(ok, F.col("count")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_count"),
        F.sum(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"),
        F.row_number().over(Window.partitionBy("source").orderBy(F.desc("at"), F.desc("run_id"))).alias("back"),
    )
    failures = F.sum((~ok).cast("int")).over(Window.partitionBy("source", "island"))
    last_ok = F.max(F.when(ok, F.col("at"))).over(Window.partitionBy("source"))
    latest = marked.select("*", failures.alias("consecutive_failures"), last_ok.alias("last_ok")).filter("back = 1")
    return latest.select("source", "last_ok", F.col("count").alias("last_count"), F.substring("error", 1, ERROR_CHARS).alias("last_error"), "consecutive_failures", "prev_count")


def health_state(last_ok: Column, last_error: Column, as_of: Column) -> Column:
    """unpolled, partial, capped, failed, stale or healthy."""
    return (
        F.when(last_ok.isNull() & last_error.isNull(), "unpolled")
        .when(F.lower(last_error).startswith("partial"), "partial")
        .when(F.lower(last_error).startswith("capped"), "capped")
        .when(last_error.isNotNull(), "failed")
        .when(F.datediff(as_of, last_ok) >= STALE_DAYS, "stale")
        .otherwise("healthy")
    )


def may_retire(health: DataFrame) -> DataFrame:
    """Sources whose latest run is complete and hasn't collapsed (under half of a baseline of ten or more)."""
    collapsed = (F.col("prev_count") >= COLLAPSE_LEAST) & (F.col("last_count") < COLLAPSE_SHARE * F.col("prev_count"))
    return health.filter(F.col("last_error").isNull() & ~F.coalesce(collapsed, F.lit(False)))


def dropped_to_zero(health: DataFrame) -> DataFrame:
    """Sources that were complete and empty now, and weren't empty before, the largest loss first."""
    return health.filter("last_count = 0 AND coalesce(prev_count, 0) > 0 AND last_error IS NULL").orderBy(F.desc("prev_count"), "source")


def broken(health: DataFrame, active: DataFrame) -> DataFrame:
    """Active sources that failed twice or more in a row."""
    return health.filter(F.col("consecutive_failures") >= BROKEN_AFTER).join(active.select("source").distinct(), "source", "left_semi")
