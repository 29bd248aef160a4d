"""Streams with timers and versions: the same rows however they are cut, and after deaths."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from openings.plans import stream_queries
from openings.streaming import snapshots, timers

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
MS = lambda t: round(t.timestamp() * 1000)


def drained(spark, tmp_path, batches, schema, stream):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n:03d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def events():
    rng, rows = random.Random(6), []
    for uid in range(6):
        t = BEGIN
        for i in range(25):
            t += timedelta(hours=rng.choice([1, 1, 5, 6, 7, 24, 24 * 13, 24 * 15, 24 * 40]))
            rows.append((uid, t, uid * 100 + i, rng.choice(["applied", "interviewing", "offer", "rejected"])))
    return [*rows, *rows[:3]]


@pytest.mark.parametrize("cuts", [1, 5])
def test_silences_and_fetches_do_not_depend_on_batches(spark, tmp_path, cuts):
    rows = events()
    last = max(MS(r[1]) for r in rows)
    mark = last - timers.DAY
    rng = random.Random(cuts)
    # out of order by less than the lateness that is allowed
    landed = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.uniform(0, 23)))
    size = -(-len(landed) // cuts)
    batches = [landed[i : i + size] for i in range(0, len(landed), size)]
    schema = "uid long, ts timestamp, event_id long, stage string"
    want, asked = set(), set()
    for uid in range(6):
        own = sorted({(MS(r[1]), r[2], r[3]) for r in rows if r[0] == uid and MS(r[1]) < mark})
        for (at, _, stage), until in zip(own, [o[0] for o in own[1:]] + [mark], strict=True):
            if stage in timers.WAITING and until > at + 14 * timers.DAY:
                want.add((uid, at, stage))
        fetched = None
        for at, *_ in own:
            if fetched is None or at >= fetched + 6 * timers.HOUR:
                asked.add((uid, at))
                fetched = at
    assert want and drained(spark, tmp_path / "s", batches, schema, timers.silences) == sorted(want)
    as_requests = lambda df: timers.fetches(df.select(F.col("uid").alias("key"), "ts", F.col("event_id").alias("ord")))
    assert drained(spark, tmp_path / "f", batches, schema, as_requests) == sorted(asked)


def test_a_version_counts_once_its_marker_stands(spark, tmp_path):
    table = snapshots.Snapshots(spark, str(tmp_path))
    assert table.read() is None and table.committed() == []
    add = lambda before, batch, number: before.unionByName(batch)
    one = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        table.apply(one, 1, add)
    table.write(one, 0)
    assert table.read() is None
    table.commit(0)
    assert table.apply(one, 1, add) and not table.apply(one, 1, add)
    assert table.read().count() == 2
    table.write(spark.createDataFrame([(9,)], "x int"), 2)  # died before its marker
    assert table.read().count() == 2 and table.apply(one, 2, add) and table.read().count() == 3
    assert table.apply(one, 3, add) and table.committed() == [2, 3] and table.read(before=3).count() == 3


def test_a_stream_that_dies_applies_each_batch_once(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(n,)], "x int").write.parquet(str(tmp_path / f"in/{n}"))
    table = snapshots.Snapshots(spark, str(tmp_path / "table"))
    table.write(spark.createDataFrame([], "x int"), 0)
    table.commit(0)
    left = [1, 2]

    def add(before, batch, number):
        if number in left:
            left.remove(number)
            raise RuntimeError("dies")
        return before.unionByName(batch)

    source = spark.readStream.schema("x int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            snapshots.merged_stream(source, table, add, str(tmp_path / "state")).awaitTermination()
    snapshots.merged_stream(source, table, add, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.x for r in table.read().collect()) == [0, 1, 2]


def test_snapshot_input_is_landed_by_all_partitions(spark, tmp_path):
    files = stream_queries._landed(spark, spark.range(0, 400, 1, 8).withColumnRenamed("id", "uid"), str(tmp_path / "in"))
    landed = [f for f in (tmp_path / "in").glob("*/*.parquet")]
    assert files == 8 and len(landed) == 24 and spark.read.parquet(str(tmp_path / "in" / "*")).distinct().count() == 400
    assert stream_queries._landed(spark, spark.range(1).withColumnRenamed("id", "uid"), str(tmp_path / "one")) >= 1


def test_batches_are_landed_by_all_tasks_and_stay_whole(spark):
    import datetime

    from openings.plans.stream_queries import _in_batches

    start = datetime.datetime(2024, 1, 1)
    for rows, dealt in ((900, True), (3, False)):
        df = spark.createDataFrame([(i, start + datetime.timedelta(hours=i)) for i in range(rows)], "key long, ts timestamp").coalesce(1)
        stream = _in_batches(spark, df, 3)
        seen = []
        query = stream.writeStream.foreachBatch(lambda b, n: seen.append([(r.key, r.ts) for r in b.collect()])).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sum(map(len, seen)) == rows and len({k for batch in seen for k, _ in batch}) == rows
        if dealt:
            files = stream.select("key")._jdf.queryExecution().logical().toString()
            assert len(seen) == 3 and "dealt" in files
            # a day's rows come in their batch or, one in ten, up to a day later
            for earlier, later in zip(seen, seen[1:], strict=False):
                assert min(t for _, t in later) > max(t for _, t in earlier) - datetime.timedelta(days=2)
