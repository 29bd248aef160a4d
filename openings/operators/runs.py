"""Runs: their rows and scopes, newness of openings, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_rows(marks: DataFrame) -> DataFrame:
    """(run_id, started, finished, state) of marks (run_id, kind start or finish, at): unfinished runs have null and "running".

    Of several starts the first counts, of several finishes the last.  A finish without a start is no run.
    """
    out = marks.groupBy("run_id").agg(F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started"), F.max(F.when(F.col("kind") == "finish", F.col("at"))).alias("finished")).filter("started IS NOT NULL")
    return out.withColumn("state", F.when(F.col("finished").isNull(), "running").otherwise("done"))


def run_scopes(attempts: DataFrame) -> DataFrame:
    """(run_id, attempted, failed, complete) of attempts (run_id, source, ok, ord): distinct sources; a run is complete if none failed in its last attempt.

    Of attempts that tie as the last one, a failure counts; a null ok is one.
    """
    bad = ~F.coalesce("ok", F.lit(False))
    last = attempts.groupBy("run_id", "source").agg((~F.max(F.struct("ord", bad.alias("bad"))).getField("bad")).alias("ok"))
    return last.groupBy("run_id").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed")).withColumn("complete", F.col("failed") == 0)


def recover_newness(sighted: DataFrame, runs: DataFrame, run_id: Column) -> DataFrame:
    """sighted (uid, first_seen_run) with the first sighting moved to this run where the run that had it never finished."""
    open_ = runs.filter(F.col("finished").isNull()).select(F.col("run_id").alias("first_seen_run"), F.lit(True).alias("open_"))
    moved = F.coalesce(F.col("open_"), F.lit(False)) & (F.col("first_seen_run") != run_id)
    return sighted.join(open_, "first_seen_run", "left").select(*[F.when(moved, run_id).otherwise(F.col(c)).alias(c) if c == "first_seen_run" else F.col(c) for c in sighted.columns], moved.alias("recovered"))


def newness(openings: DataFrame, run_id: Column, run_day: Column) -> DataFrame:
    """openings with is_new: first seen in this run; by the day where no run is known."""
    return openings.withColumn("is_new", F.coalesce(F.col("first_seen_run") == run_id, F.col("first_seen") == run_day, F.lit(False)))


def corrupt_history(openings: DataFrame) -> DataFrame:
    """Openings that were acted on though their gate doesn't surface them."""
    return openings.filter(F.col("status").isin("applied", "rejected") & ~F.col("gate").isin("QUALIFIED", "VERIFY")).select("uid", "status", "gate")


def freshness(runs: DataFrame, today: Column, stale_days: int = 7) -> DataFrame:
    """One row: last_run, age in days of the last start, stale, unfinished (runs without an end); nulls and stale without any run."""
    one = runs.agg(F.max("run_id").alias("last_run"), F.datediff(today, F.max("started")).alias("age"), F.count_if(F.col("finished").isNull()).alias("unfinished"))
    return one.withColumn("stale", F.coalesce(F.col("age") >= stale_days, F.lit(True)))
