"""Application funnels: one row an application from its events, and summaries of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent

# Fixed values.
STAGES = ("applied", "interviewing", "offer", "rejected", "withdrawn")
FOLLOW_UP_DAYS, WEEKS = 14, 8


def stage_number(stage: Column) -> Column:
    return F.coalesce(*[F.when(stage == s, F.lit(i)) for i, s in enumerate(STAGES)])


def fold_applications(events: DataFrame, as_of: Column, follow_up_days: int = FOLLOW_UP_DAYS) -> DataFrame:
    """One row a uid with any stage: first day of each stage, latest stage, last activity, silence, durations.

    events: uid, day, stage (null: other activity, which only moves the last
    activity), event_id.  The latest stage is that of the last day, then the
    later stage, then the later event; undated stages come first.  Activity
    after as_of leaves the silence unknown.
    """
    first = lambda *names: F.min(F.when(F.col("stage").isin(*names), F.col("day")))
    seen = lambda *names: F.coalesce(F.bool_or(F.col("stage").isin(*names)), F.lit(False))
    order = F.struct(F.coalesce("day", F.lit("0001-01-01").cast("date")), stage_number(F.col("stage")), "event_id")
    apps = (
        events.groupBy("uid")
        .agg(
            F.max_by("stage", F.when(F.col("stage").isNotNull(), order)).alias("current_stage"), F.max("day").alias("last_activity"),
            first("applied").alias("applied_on"), first("interviewing", "offer").alias("interview_on"), first("offer", "rejected", "withdrawn").alias("outcome_on"),
            seen("interviewing", "offer").alias("interviewed"), seen("offer").alias("offered"), F.count("stage").alias("stages"),
        )
        .filter("stages > 0")
    )
    silent = F.when(F.col("last_activity") <= as_of, F.datediff(as_of, F.col("last_activity")))
    gap = lambda c: F.when(F.col(c) >= F.col("applied_on"), F.datediff(c, "applied_on"))
    return apps.select(
        "uid", "current_stage", "applied_on", "last_activity", "interviewed", "offered", silent.alias("days_silent"),
        F.coalesce(F.col("current_stage").isin("applied", "interviewing") & (silent >= follow_up_days), F.lit(False)).alias("follow_up_due"),
        gap("interview_on").alias("days_to_interview"), gap("outcome_on").alias("days_to_outcome"),
    )


def summary(apps: DataFrame) -> DataFrame:
    """One row: counts, rates (one decimal; null without applications) and median days."""
    stage = lambda *s: F.coalesce(F.sum(F.col("current_stage").isin(*s).cast("int")), F.lit(0))
    n, i, o = F.count(F.lit(1)), F.coalesce(F.sum(F.col("interviewed").cast("int")), F.lit(0)), F.coalesce(F.sum(F.col("offered").cast("int")), F.lit(0))
    return apps.agg(
        n.alias("submitted"), stage("applied", "interviewing", "offer").alias("active"), i.alias("interviewed"), o.alias("offers"), stage("rejected").alias("rejected"),
        stage("withdrawn").alias("withdrawn"), percent(i, n).alias("interview_rate"), percent(o, n).alias("offer_rate"),
        F.median("days_to_interview").alias("median_days_to_interview"), F.median("days_to_outcome").alias("median_days_to_outcome"),
    )


def by_lane(apps: DataFrame) -> DataFrame:
    """Conversion of each lane, the largest first."""
    n, i = F.count(F.lit(1)), F.sum(F.col("interviewed").cast("int"))
    return apps.groupBy("lane").agg(n.alias("submitted"), i.alias("interviewed"), percent(i, n).alias("interview_rate"), F.sum(F.col("offered").cast("int")).alias("offers")).orderBy(F.desc("submitted"), "lane")


def weekly(apps: DataFrame, as_of: Column, weeks: int = WEEKS) -> DataFrame:
    """Applications of each of the last weeks (Mondays), weeks without any included."""
    monday = F.date_trunc("week", as_of).cast("date")
    calendar = apps.sparkSession.range(weeks).select(F.date_sub(monday, (F.col("id") * 7).cast("int")).alias("week"))
    counted = apps.filter("applied_on IS NOT NULL").groupBy(F.date_trunc("week", "applied_on").cast("date").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counted, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("applications"))


def timelines(events: DataFrame) -> DataFrame:
    """Each application's stages in order of day, stage and event, as one array (an application's own events only)."""
    steps = events.filter("stage IS NOT NULL").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("day", stage_number(F.col("stage")).alias("no"), "event_id", "stage"))).alias("steps"))
    return steps.select("uid", F.transform("steps", lambda s: F.concat_ws(":", s["day"].cast("string"), s["stage"])).alias("timeline"))
