"""The history table: merging a batch, retiring what vanished, judging again.

Snapshots are joined and projected, never updated in place: the caller writes
the result as the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import base_source, is_ats

# Fixed values.
ACTED = ("applied", "rejected", "ignored")
HISTORY = ("applied", "rejected")
STATUS_RANK = {"new": 0, "reviewed": 1, "ignored": 2, "applied": 3, "rejected": 4}
MISSES_TO_DELIST = 2
#: Columns that a blank sighting never erases.
HEALED = ("description", "board", "registry_lane", "tier", "department")


def merge_remote(stored: Column, flag: Column, source: Column, board: Column) -> Column:
    """Null keeps; true sets; false clears only from an employer's own board, else it only fills a null."""
    own = is_ats(base_source(source)) & (F.trim(F.coalesce(board, F.lit(""))) != "")
    return F.when(flag.isNull(), stored).when(flag, F.lit(True)).when(own | stored.isNull(), F.lit(False)).otherwise(stored)


def merge_evidence(stored: Column, seen: Column) -> Column:
    """Null: never looked; empty: looked and found nothing.  A url stays; null may become empty."""
    return F.when(seen.isNull(), stored).when(seen != "", seen).when(stored.isNull(), F.lit("")).otherwise(stored)


def merge_snapshot(stored: DataFrame, batch: DataFrame, today: Column, run_id: Column) -> DataFrame:
    """The next snapshot: stored openings refreshed by the batch (one row a uid on either side), new ones added.

    The verdict of openings the user acted on is frozen; a pay band is replaced
    as one claim; a blank never erases; being seen makes an opening live again.
    """
    s, b = stored.alias("s"), batch.alias("b")
    both = s.join(b, F.col("s.uid") == F.col("b.uid"), "full_outer")
    seen, known = F.col("b.uid").isNotNull(), F.col("s.uid").isNotNull()
    acted = F.col("s.status").isin(*ACTED)
    resolved = F.coalesce(F.col("b.comp_source").isin("board", "body", "unknown") & (F.col("b.comp_min").isNotNull() | F.col("b.comp_max").isNotNull()), F.lit(False))
    fresh = lambda c: F.when(seen, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}"))
    frozen = lambda c: F.when(~seen | (known & F.coalesce(acted, F.lit(False))), F.col(f"s.{c}")).otherwise(F.col(f"b.{c}"))
    healed = lambda c: F.coalesce(F.when(F.col(f"b.{c}") != "", F.col(f"b.{c}")), F.col(f"s.{c}"))
    claim = lambda c: F.when(seen & (resolved | ~known), F.col(f"b.{c}")).otherwise(F.col(f"s.{c}"))
    first = lambda c: F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}"))
    absent = seen & known & ~resolved & F.col("s.comp_min").isNull() & F.col("s.comp_max").isNull() & (F.col("b.comp_source") == "absent")
    discovered = seen & known & F.lower(F.trim("b.source")).startswith("freehire:") & is_ats(F.col("s.source"))
    made = {
        "uid": F.coalesce("b.uid", "s.uid"),
        "company": first("company"), "posted_at": first("posted_at"), "lane": first("lane"),
        "title": fresh("title"), "url": fresh("url"), "location": fresh("location"),
        "source": F.when(discovered, F.col("s.source")).otherwise(fresh("source")),
        **{c: healed(c) for c in HEALED},
        "score": frozen("score"), "gate": frozen("gate"), "reasons": frozen("reasons"),
        "comp_min": claim("comp_min"), "comp_max": claim("comp_max"),
        "comp_source": F.when(seen & (resolved | ~known), F.col("b.comp_source")).when(absent, F.lit("absent")).otherwise(F.col("s.comp_source")),
        "remote_flag": merge_remote(F.col("s.remote_flag"), F.col("b.remote_flag"), F.col("b.source"), F.col("b.board")),
        "url_direct": merge_evidence(F.col("s.url_direct"), F.col("b.url_direct")),
        "company_site": merge_evidence(F.col("s.company_site"), F.col("b.company_site")),
        "status": F.coalesce("s.status", F.lit("new")),
        "first_seen": F.coalesce("s.first_seen", today), "last_seen": F.when(seen, today).otherwise(F.col("s.last_seen")),
        "seen_count": F.when(known & seen, F.col("s.seen_count") + 1).otherwise(F.coalesce("s.seen_count", F.lit(1))),
        "first_seen_run": F.coalesce("s.first_seen_run", run_id), "last_seen_run": F.when(seen, run_id).otherwise(F.col("s.last_seen_run")),
        "delisted_on": F.when(~seen, F.col("s.delisted_on")),
        "misses": F.when(seen, F.lit(0)).otherwise(F.col("s.misses")), "miss_on": F.when(~seen, F.col("s.miss_on")),
    }
    return both.select(*[c.alias(n) for n, c in made.items()])


def retire(openings: DataFrame, healthy: DataFrame, today: Column) -> DataFrame:
    """openings with misses, miss_on and delisted_on moved on by one day.

    An opening that its healthy board or feed didn't show today gets a miss, at
    most one a day; the second in a row delists it.  Openings the user applied
    to or was rejected for are history and stay.  healthy: source (one row each).
    """
    live = F.col("delisted_on").isNull() & ~F.col("status").isin(*HISTORY)
    marked = openings.join(F.broadcast(healthy.select("source", F.lit(True).alias("healthy_"))), "source", "left")
    miss = live & F.coalesce("healthy_", F.lit(False)) & (F.col("last_seen") < today) & (F.col("miss_on").isNull() | (F.col("miss_on") != today))
    misses = F.col("misses") + F.when(miss, 1).otherwise(0)
    gone = live & (misses >= MISSES_TO_DELIST)
    return marked.select(
        *[
            misses.alias(c) if c == "misses" else F.when(miss, today).otherwise(F.col(c)).alias(c) if c == "miss_on" else F.when(gone, today).otherwise(F.col(c)).alias(c) if c == "delisted_on" else F.col(c)
            for c in openings.columns
        ]
    )


def miss_history(days: DataFrame) -> DataFrame:
    """(uid, day, misses, delisted) from a daily log (uid, day, seen): misses since the last sighting, delisted from the second on."""
    w = Window.partitionBy("uid").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    island = days.withColumn("island", F.sum(F.col("seen").cast("int")).over(w))
    misses = F.sum((~F.col("seen")).cast("int")).over(Window.partitionBy("uid", "island").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return island.withColumn("misses", misses).select("uid", "day", F.col("misses"), (F.col("misses") >= MISSES_TO_DELIST).alias("delisted"))


def merge_duplicates(openings: DataFrame, canonical: str) -> DataFrame:
    """Rows of one canonical uid as one: strongest status, earliest and latest days, counts summed, notes once each, gaps filled from the smallest uid on."""
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(r)) for s, r in STATUS_RANK.items()])
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("uid"))).alias(c)
    return openings.groupBy(F.col(canonical).alias("canonical_uid")).agg(
        F.max_by("status", rank).alias("status"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("notes") != "", F.col("notes")))), "; ").alias("notes"), filled("comp_min"), filled("comp_max"), F.count(F.lit(1)).alias("merged"),
    )


def rescored(before: DataFrame, after: DataFrame) -> DataFrame:
    """What judging again changes: uid, old and new gate and score, dropped (it surfaced and no longer does); unacted rows only."""
    a, b = before.filter(~F.col("status").isin(*ACTED)).alias("a"), after.alias("b")
    surfaced = lambda c: F.col(c).isin("QUALIFIED", "VERIFY")
    changed = ~F.col("a.gate").eqNullSafe(F.col("b.gate")) | ~F.col("a.score").eqNullSafe(F.col("b.score"))
    return a.join(b, "uid").filter(changed).select(
        "uid", F.col("a.gate").alias("old_gate"), F.col("b.gate").alias("new_gate"), F.col("a.score").alias("old_score"), F.col("b.score").alias("new_score"),
        (surfaced("a.gate") & ~surfaced("b.gate")).alias("dropped"),
    )
