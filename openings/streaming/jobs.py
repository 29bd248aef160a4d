"""The incremental jobs as Structured Streaming.

Each agrees with its batch counterpart once its input is drained.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replayed_events(events: DataFrame) -> DataFrame:
    """events without repeats of (uid, kind, day, detail); no watermark, since late events are never dropped."""
    return events.dropDuplicates(["uid", "kind", "day", "detail"])


def weekly_applications(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Applications a week, weeks starting on Mondays (the epoch began on a Thursday)."""
    week = F.window("ts", "7 days", startTime="4 days")
    return events.filter("stage = 'applied'").withWatermark("ts", late).groupBy(week).agg(F.count(F.lit(1)).alias("applications")).select(F.to_date("window.start").alias("week"), "applications")


def latest_stage(events: DataFrame) -> DataFrame:
    """Each application's stage by event time: a late event is kept but doesn't set the stage back.  events: uid, ts, stage, event_id."""
    return events.filter("stage IS NOT NULL").groupBy("uid").agg(F.max(F.struct("ts", "event_id", "stage")).alias("m"), F.count(F.lit(1)).alias("n")).select("uid", F.col("m.stage").alias("stage"), F.col("m.ts").alias("at"), "n")


_LIVE = "uid long, day date, misses int, delisted boolean"


def liveness(days: DataFrame) -> DataFrame:
    """(uid, day, misses, delisted) for every day of an opening: misses since it was last seen, delisted from the second on.

    days: uid, day, seen - one row an opening and day of a healthy poll, in
    order of days across micro-batches.  State a uid: its last day and misses;
    a day that was counted already isn't counted again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, misses = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("day")
        out = []
        for day, seen in zip(rows["day"], rows["seen"], strict=True):
            if last is not None and str(day) <= last:
                continue
            misses = 0 if seen else misses + 1
            last = str(day)
            out.append((key[0], day, misses, misses >= 2))
        state.update((last, misses))
        yield pd.DataFrame(out, columns=["uid", "day", "misses", "delisted"])

    return days.groupBy("uid").applyInPandasWithState(step, _LIVE, "last string, misses int", "append", GroupStateTimeout.NoTimeout)


_HEALTH = "source string, run_id long, consecutive_failures int, prev_count long, last_count long"


def source_health(runs: DataFrame) -> DataFrame:
    """One row a run with its source's failures in a row and the count of the last complete run before it.

    runs: source, run_id, count, error (null: complete), in order of run_id
    across micro-batches; a run that was folded already isn't again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, failures, baseline = state.get if state.exists else (-1, 0, None)
        rows = pd.concat(list(batches)).sort_values("run_id")
        out = []
        for run, count, error in zip(rows["run_id"], rows["count"], rows["error"], strict=True):
            if run <= last:
                continue
            failures = 0 if error is None else failures + 1
            out.append((key[0], int(run), failures, baseline, int(count)))
            last, baseline = int(run), int(count) if error is None else baseline
        state.update((last, failures, baseline))
        frame = pd.DataFrame(out, columns=["source", "run_id", "consecutive_failures", "prev_count", "last_count"])
        yield frame.astype({"prev_count": "Int64"})

    return runs.groupBy("source").applyInPandasWithState(step, _HEALTH, "last long, failures int, baseline long", "append", GroupStateTimeout.NoTimeout)


def silent_applications(folded: DataFrame, as_of: Any, days: int = 14) -> DataFrame:
    """Applications (from latest_stage) that wait for an answer and have been silent for `days` or more."""
    silent = F.datediff(as_of, F.to_date("at"))
    return folded.filter(F.col("stage").isin("applied", "interviewing") & (silent >= days)).select("uid", "stage", silent.alias("days_silent"))
