"""Streams that act when time passes, not only when rows come: silences and expiring caches.

Rows may come out of order.  A key's rows wait in its state until the watermark
has passed them and are then handled in order of event time, so the outcome
doesn't depend on how rows are cut into micro-batches; rows later than the
watermark allows are left out, and rows beyond the watermark still wait when
the input ends.  An event-time timer wakes a key whose next row or deadline has
come, even if nothing arrives for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR, DAY = 3_600_000, 86_400_000
#: Stages that wait for an answer.
WAITING = ("applied", "interviewing")

#: (at, note) of the last row that counts, the row (at, order, note) that comes now -> what is put out, the new last one.
Row = Callable[[tuple | None, tuple], tuple[list, tuple | None]]
#: The last row that counts and the watermark -> what is put out, the new last one.
Tick = Callable[[tuple | None, int], tuple[list, tuple | None]]


def in_event_order(rows: DataFrame, late: str, on_row: Row, on_time: Tick, deadline: Callable[[tuple | None], int | None]) -> DataFrame:
    """(key, at, note) that on_row and on_time put out.

    rows: key long, ts timestamp, ord long, note string.  Rows of one key and
    time come in the order of ord.  deadline(last) is the time (ms) at which
    on_time is due, null for never.
    """
    timed = rows.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("at"), "ord", "note")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = None, []
        if state.exists:
            last_at, last_note, ats, ords, notes = state.get
            last = None if last_at is None else (last_at, last_note)
            waiting = list(zip(ats, ords, notes, strict=True))
        if not state.hasTimedOut:
            for batch in batches:
                waiting += zip(batch["at"].tolist(), batch["ord"].tolist(), [n if isinstance(n, str) else None for n in batch["note"].tolist()], strict=True)
        waiting.sort(key=lambda r: (r[0], r[1], r[2] or ""))
        now, out = state.getCurrentWatermarkMs(), []
        while waiting and waiting[0][0] < now:
            made, last = on_row(last, waiting.pop(0))
            out += made
        made, last = on_time(last, now)
        out += made
        ats, ords, notes = (list(c) for c in zip(*waiting, strict=True)) if waiting else ([], [], [])
        if last is None and not waiting:
            state.remove()
        else:
            state.update((*(last or (None, None)), ats, ords, notes))
            due = [t for t in (waiting[0][0] if waiting else None, deadline(last)) if t is not None]
            if due:
                state.setTimeoutTimestamp(max(min(due), now) + 1)
        if out:  # most calls have none, and a frame costs more than all the rest
            yield pd.DataFrame({"key": [key[0]] * len(out), "at": [at for at, _ in out], "note": [note for _, note in out]})

    return timed.groupBy("key").applyInPandasWithState(
        step, "key long, at long, note string", "at long, note string, ats array<long>, ords array<long>, notes array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def silences(events: DataFrame, days: int = 14, late: str = "1 day") -> DataFrame:
    """(uid, at, stage): every time that an application waited for an answer more than `days` after its last stage, once each, as soon as it did.

    events: uid, ts, event_id, stage.  at is the silent stage's time in
    milliseconds.  A row that belongs into the silence, and comes no later than
    `late`, is heard.
    """
    limit = days * DAY
    waits = lambda last: last is not None and last[1] in WAITING

    def on_row(last: tuple | None, row: tuple) -> tuple[list, tuple]:
        return ([last] if waits(last) and row[0] > last[0] + limit else []), (row[0], row[2])

    def on_time(last: tuple | None, now: int) -> tuple[list, tuple | None]:
        # once told, a silence isn't told again; what comes next starts anew
        return ([last], None) if waits(last) and now > last[0] + limit else ([], last)

    rows = events.filter("stage IS NOT NULL").select(F.col("uid").alias("key"), "ts", F.col("event_id").alias("ord"), F.col("stage").alias("note"))
    made = in_event_order(rows, late, on_row, on_time, lambda last: last[0] + limit if waits(last) else None)
    return made.select(F.col("key").alias("uid"), "at", F.col("note").alias("stage"))


def fetches(asked: DataFrame, hours: int = 6, late: str = "1 day") -> DataFrame:
    """(key, at): requests that a cache of so many hours can't answer, and which fetch therefore.

    asked: key, ts, ord.  A fetch answers what is asked before its `hours` are
    over, the next request fetches again.  A key's state goes when its fetch
    has expired.
    """
    limit = hours * HOUR

    def on_row(last: tuple | None, row: tuple) -> tuple[list, tuple]:
        fresh = last is None or row[0] >= last[0] + limit
        return ([(row[0], None)], (row[0], None)) if fresh else ([], last)

    def on_time(last: tuple | None, now: int) -> tuple[list, tuple | None]:
        return [], None if last is not None and now > last[0] + limit else last

    rows = asked.select("key", "ts", "ord", F.lit(None).cast("string").alias("note"))
    return in_event_order(rows, late, on_row, on_time, lambda last: None if last is None else last[0] + limit).select("key", "at")
