"""Queries over the streaming jobs, each drained and held against batch SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..streaming import jobs, snapshots, timers
from .history_queries import AS_OF, snapshot_inputs
from .registry import ORACLES, query, table
from .views import EVENTS, SOURCE_RUNS, cte, view


def _instant() -> Column:
    """Events carry wall-clock times; watermarks want instants, those of the same clock in UTC."""
    return F.expr("CAST(convert_timezone('UTC', current_timezone(), CAST(ts AS TIMESTAMP_NTZ)) AS TIMESTAMP)")


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own, but on a single machine only."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines of the cluster share")
    return own or tempfile.mkdtemp(prefix="openings-stream-")


def _drain(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """A stream's result once its input is drained, read from a table that this run alone writes."""
    base = _shared(spark)
    run = f"{base.rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{id(stream)}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{run}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{run}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(f"{run}/out")
    last = every.agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == last).drop("batch")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream (the pattern fits a file as well as a folder)."""
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


@query(cte("app_events") + " SELECT uid, arg_max(stage, (ts, event_id)) AS stage, count(*) AS n FROM app_events WHERE stage IS NOT NULL GROUP BY uid")
def streamed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir).selectExpr(*EVENTS)
    return _drain(spark, jobs.latest_stage(events), "stages", "complete").select("uid", "stage", "n")


@query(r"""
WITH d AS (SELECT user_id AS uid, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS seen FROM events GROUP BY ALL),
i AS (SELECT *, sum(CASE WHEN seen THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY day) AS island FROM d)
SELECT uid, day, CAST(m AS INTEGER) AS misses, m >= 2 AS delisted FROM (SELECT *, sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (PARTITION BY uid, island ORDER BY day) AS m FROM i)""")
def streamed_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The miss counter as a stateful stream over daily polls; it must give what merge.miss_history gives."""
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("uid"), F.to_date("ts").alias("day")).agg((F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)) == 1).alias("seen"))
    base = _shared(spark)
    path = f"{base.rstrip('/')}/days-{spark.sparkContext.applicationId}-{id(days)}"
    days.write.parquet(path)
    stream = spark.readStream.schema(days.schema).parquet(path)
    return _drain(spark, jobs.liveness(stream), "liveness", "append")


def _folder(spark: SparkSession, name: str, of: DataFrame) -> str:
    return f"{_shared(spark).rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{id(of)}"


@query(cte("app_events") + " SELECT uid, kind, day, min(ts) AS first_at FROM app_events GROUP BY ALL")
def streamed_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are landed twice, as a stream in which the second landing changes nothing."""
    events = view(spark, sf_dir, "app_events").select("uid", "kind", "day", "ts", F.lit("").alias("detail"))
    once = events.groupBy("uid", "kind", "day", "detail").agg(F.min("ts").alias("ts"))
    path = _folder(spark, "landed", events)
    for n in range(2):
        once.write.parquet(f"{path}/{n}")
    stream = spark.readStream.schema(once.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/*")
    return _drain(spark, jobs.replayed_events(stream), "replays", "append").select("uid", "kind", "day", F.col("ts").alias("first_at"))


@query(cte("app_events") + " SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS applications FROM app_events WHERE stage = 'applied' GROUP BY 1")
def streamed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir).selectExpr(*EVENTS).withColumn("ts", _instant())
    return _drain(spark, jobs.weekly_applications(events), "weeks", "complete")


@query(cte("source_runs") + """, g AS (SELECT *, count(*) FILTER (error IS NULL) OVER (PARTITION BY source ORDER BY run_id) AS done FROM source_runs)
SELECT source, run_id, CAST(CASE WHEN error IS NULL THEN 0 ELSE count(*) FILTER (error IS NOT NULL) OVER (PARTITION BY source, done ORDER BY run_id) END AS INTEGER) AS consecutive_failures,
 last_value(CASE WHEN error IS NULL THEN count END IGNORE NULLS) OVER (PARTITION BY source ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_count, count AS last_count FROM g""")
def streamed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row and the last complete count before each run, folded as runs come."""
    runs = _stream(spark, sf_dir).selectExpr(*SOURCE_RUNS)
    return _drain(spark, jobs.source_health(runs.select("source", "run_id", "count", "error")), "health", "append")


_LATE = 86_400_000  # a day, in milliseconds
_HEARD = cte("app_events") + f", w AS (SELECT epoch_us(max(ts)) // 1000 - {_LATE} AS wm FROM app_events), e AS (SELECT *, epoch_us(ts) // 1000 AS at_ms FROM app_events, w WHERE epoch_us(ts) // 1000 < wm)"


@query(_HEARD + """, n AS (SELECT uid, at_ms, stage, coalesce(lead(at_ms) OVER (PARTITION BY uid ORDER BY at_ms, event_id), wm) AS until FROM e WHERE stage IS NOT NULL)
SELECT uid, at_ms, stage FROM n WHERE stage IN ('applied', 'interviewing') AND until > at_ms + 2 * 86400000""")
def streamed_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every follow-up that came due after two days, from timers of a stream in several micro-batches."""
    events = view(spark, sf_dir, "app_events").filter("stage IS NOT NULL").select("uid", _instant().alias("ts"), "event_id", "stage")
    return _drain(spark, timers.silences(_in_batches(spark, events, 3), days=2), "silences", "append").withColumnRenamed("at", "at_ms")


@query(_HEARD.replace("WITH", "WITH RECURSIVE", 1) + """, f AS (SELECT uid, min(at_ms) AS at_ms FROM e GROUP BY uid
 UNION ALL SELECT f.uid, (SELECT min(e.at_ms) FROM e WHERE e.uid = f.uid AND e.at_ms >= f.at_ms + 6 * 3600000) FROM f WHERE f.at_ms IS NOT NULL)
SELECT uid AS key, at_ms FROM f WHERE at_ms IS NOT NULL""")
def streamed_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a six-hour cache leaves to the network, events standing for requests of a user's page."""
    asked = view(spark, sf_dir, "app_events").select(F.col("uid").alias("key"), _instant().alias("ts"), F.col("event_id").alias("ord"))
    return _drain(spark, timers.fetches(_in_batches(spark, asked, 3)), "fetches", "append").withColumnRenamed("at", "at_ms")


def _in_batches(spark: SparkSession, rows: DataFrame, batches: int) -> DataFrame:
    """rows as a file stream of so many micro-batches, whole days in each, in order of days but for one in ten that comes up to a day later."""
    day = F.unix_date(F.to_date("ts"))
    span = rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    path = _folder(spark, "timed", rows)
    step = max(1, ((span["b"] or 0) - (span["a"] or 0) + 1) // batches + 1)
    late = F.pmod(F.hash("ts"), F.lit(10)) == 0
    place = F.floor((day + F.when(late, F.lit(1)).otherwise(0) - (span["a"] or 0)) / step)

    def land(under: str, deal: Callable[[DataFrame], DataFrame]) -> list[int]:
        for n in range(batches):
            deal(rows.filter(place.between(n, n if n < batches - 1 else batches))).write.parquet(f"{under}/{n:03d}")
        return [len(spark.read.schema(rows.schema).parquet(f"{under}/{n:03d}").inputFiles()) for n in range(batches)]

    # a micro-batch is one folder: its rows are landed and read by all tasks if every folder gets as many files, else (few rows) each is one file
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    files = land(f"{path}/dealt", lambda df: df.repartition(tasks))
    under = f"{path}/dealt"
    if files != [files[0]] * batches:
        under, files = f"{path}/whole", [1]
        land(under, lambda df: df.coalesce(1))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files[0]).option("latestFirst", False).parquet(f"{under}/*")


def _landed(spark: SparkSession, batch: DataFrame, path: str) -> int:
    """The batch in three folders, written by all its partitions; gives the files of a micro-batch, so that there are at least three (a uid is in one of them, whichever)."""
    for n in range(3):
        batch.filter(F.pmod(F.xxhash64("uid"), F.lit(3)) == n).write.parquet(f"{path}/{n}")
    return len(spark.read.schema(batch.schema).parquet(f"{path}/*").inputFiles()) // 3


@query(ORACLES["merged_snapshot"])
def streamed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merged_snapshot from a stream that dies twice: once between a version and its marker, once after the marker."""
    stored, batch = snapshot_inputs(spark, sf_dir)
    path = _folder(spark, "history", batch)
    files = _landed(spark, batch, f"{path}/in")
    table, died = snapshots.Snapshots(spark, f"{path}/table"), set()
    table.write(stored, 0)
    table.commit(0)

    class Dying(snapshots.Snapshots):
        def commit(self, number: int) -> None:
            if number == 2 and "before" not in died:
                died.add("before")
                raise RuntimeError("dies between version and marker")
            super().commit(number)
            if number == 3 and "after" not in died:
                died.add("after")
                raise RuntimeError("dies after the marker")

    merged = lambda before, rows, number: merge.merge_snapshot(before, rows, F.lit(AS_OF).cast("date"), F.lit(3).cast("long"))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in/*")
    for _ in range(3):
        try:
            snapshots.merged_stream(source, Dying(spark, f"{path}/table"), merged, f"{path}/state").awaitTermination()
        except StreamingQueryException:
            continue
        break
    if died != {"before", "after"}:
        raise RuntimeError(f"the stream was to die twice, it died {died}")
    return table.read().select("uid", "status", "score", "comp_min", "comp_max", "comp_source", "remote_flag", "source", "url_direct", "seen_count", "last_seen", "misses")
