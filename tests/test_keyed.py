"""Typed keyed state: streams equal batch after a restart, the state is a table, configurations change in epochs."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewarden.operators import checks, freshness, topology
from tidewarden.operators.throttle import session_throttle
from tidewarden.plans import views
from tidewarden.streaming import jobs, keyed

SF = "/root/testdata/sf0.001"


def as_stream(spark, df, path, low, high, parts=2):
    """Adds the rows of a share of the instants as files and reads the folder."""
    bounds = df.approxQuantile("at", [low + (high - low) * i / parts for i in range(parts + 1)], 0.0)
    bounds[0] = float("-inf") if low == 0 else bounds[0]
    for i in range(parts):
        piece = df.filter((F.col("at") > bounds[i]) & (F.col("at") <= bounds[i + 1]))
        piece.coalesce(1).write.mode("append").parquet(f"{path}/{low}-{i}")
        time.sleep(0.05)
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    )


def run(df, out, checkpoint):
    query = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).start(out)
    try:
        query.processAllAvailable()  # ends as there is no time to live here
    finally:
        query.stop()


def twice(spark, rows, build, tmp_path):
    """The rows that a stream gives over two runs, the second of which goes on from the first one's state."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for low, high in ((0, 0.5), (0.5, 1)):
        run(build(as_stream(spark, rows, source, low, high)), out, checkpoint)
    return spark.read.parquet(out), checkpoint


def same(a, b):
    x, y = (sorted(map(tuple, d.collect()), key=str) for d in (a, b))
    assert x == y and x


def test_streaks(spark, tmp_path):
    rows = views.checks(spark, SF).withColumn("at", F.unix_micros("ts"))
    want = checks.streaks(rows, ["name"], ["ts", "event_id"]).select("name", "event_id", "verdict")
    small = rows.select(F.lit("g").alias("group"), "name", F.col("event_id").alias("id"), "at", "ok", "fail_count", "resolve_count")
    found, checkpoint = twice(spark, small, lambda s: jobs.verdict_stream(s, None), tmp_path)
    same(found.select("name", "id", "verdict"), want)
    state = spark.read.format("statestore").option("stateVarName", "value").load(checkpoint)
    assert state.select("value.ok", "value.run", "value.failed").distinct().count() > 1
    assert state.select("key.name").distinct().count() == small.select("name").distinct().count()


def test_verdict_job_writes_incidents(spark, tmp_path):
    rows = [("g", "n", i, i, ok, 2, 1, "failed" if i == 1 else "resolved" if i == 2 else "other") for i, ok in enumerate([False, False, True, True])]
    batch = spark.createDataFrame(rows, '`group` string, name string, at long, id long, ok boolean, fail_count int, resolve_count int, verdict string')
    for _ in range(2):  # a repeat writes nothing twice
        jobs.verdict_job(str(tmp_path))(batch, 0)
    found = spark.read.parquet(str(tmp_path / "incidents"))
    assert sorted((r["incident_key"], r["action"]) for r in found.collect()) == [("g/n", "resolve"), ("g/n", "trigger")]


def test_partitions(spark, tmp_path):
    rows = views.changes(spark, SF).withColumn("at", F.unix_micros("ts"))
    want = topology.partition_history(rows).filter("present")
    want = want.select("seq", F.unix_micros("offline_since"), F.unix_micros("under_replicated_since"))
    rows = rows.drop("ts").withColumn("partition", F.col("partition").cast("int"))
    found, checkpoint = twice(spark, rows, lambda s: jobs.topology_stream(s, None), tmp_path)
    same(found.select("seq", "offline", "under"), want)
    state = spark.read.format("statestore").option("stateVarName", "partitions").load(checkpoint)
    assert state.count() > state.select("key.topic").distinct().count()  # an entry per partition


def test_load_grace_and_counters(spark, tmp_path):
    events = views.events(spark, SF)
    rows = events.select(
        "user_id", F.col("event_id").alias("id"), "ts", F.unix_micros("ts").alias("at"),
        F.when(F.col("value") < 30, 0).otherwise(F.floor("value")).alias("load"), (F.col("event_id") % 2).alias("broker"),
        F.floor("value").alias("reading"),
    )
    want = freshness.load_grace(rows, ["user_id"], ["ts", "id"]).select("id", F.unix_micros("started_at"))
    found, _ = twice(spark, rows.drop("ts"), lambda s: jobs.load_stream(s, ["user_id"], 900_000_000, None), tmp_path / "load")
    same(found.select("id", "since"), want)
    want = topology.counter_increase(rows, ["user_id"], ["ts", "id"]).select("id", "increase")
    found, _ = twice(spark, rows.drop("ts"), lambda s: jobs.counter_stream(s, ["user_id"], None), tmp_path / "counter")
    same(found.select("id", "increase"), want)
    gap = 6 * 3_600_000_000
    want = session_throttle(rows, ["user_id"], ["ts", "id"], gap).select("id")
    build = lambda s: keyed.keyed(s, keyed.Sightings(gap, ["user_id"], ["at", "id"], ["id"], None))
    found, _ = twice(spark, rows.drop("ts"), build, tmp_path / "seen")
    same(found.select("id"), want)


class State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return State()

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Driver:
    """One agent's watchdog with a clock of ours."""

    def __init__(self, period=100):
        self.dog, self.handle, self.told = keyed.Watchdog(period), Handle(), []
        self.dog.init(self.handle)

    def batch(self, now, *rows):
        """Rows (kind, epoch, seq) in one micro-batch."""
        for due in sorted(t for t in self.handle.timers if t <= now):
            self.handle.timers.discard(due)
            self.told += [r for out in self.dog.handleExpiredTimer(("a",), Clock(due), None) for r in out["action"]]
        if rows:
            frame = pd.DataFrame(rows, columns=["kind", "epoch", "seq"]).astype({"epoch": "float", "seq": "float"})
            self.told += [r for out in self.dog.handleInputRows(("a",), iter([frame]), Clock(now)) for r in out["action"]]
        return self.told


def test_a_changed_configuration_starts_all_clocks_anew():
    dog = Driver()
    dog.batch(0, ("config", 1, 0))
    assert dog.batch(90, ("config", 2, 1)) == []
    assert dog.batch(150) == []  # without the new epoch the clock would have run out at 101
    assert dog.batch(200) == ["trigger"]


def test_the_same_configuration_again_does_nothing():
    dog = Driver()
    dog.batch(0, ("config", 1, 0))
    dog.batch(90, ("config", 1, 1), ("config", None, 2))
    assert dog.batch(110) == ["trigger"]


def test_a_down_flag_outlives_changes_and_removals():
    dog = Driver()
    dog.batch(0, ("config", 1, 0))
    assert dog.batch(101) == ["trigger"]
    dog.batch(150, ("config", 2, 1))
    assert dog.batch(400) == ["trigger"]  # still down: not paged again
    dog.batch(410, ("removed", 3, 2))
    assert dog.batch(420, ("heartbeat", None, 3)) == ["trigger"]  # not expected now
    dog.batch(430, ("config", 4, 4))
    assert dog.batch(440, ("heartbeat", None, 5)) == ["trigger", "resolve"]
    assert dog.batch(1000) == ["trigger", "resolve", "trigger"]


def test_order_within_a_batch():
    dog = Driver()
    dog.batch(0, ("config", 1, 0))
    dog.batch(50, ("config", 3, 9), ("removed", 2, 8))  # removed, then added again
    assert dog.handle.timers == {151}
    dog.batch(60, ("config", 4, 10), ("removed", 5, 11))
    assert not dog.handle.timers and not dog.dog.value.exists()
    other = Driver()
    other.batch(0, ("removed", None, None), ("config", None, None))  # without seq removals come last
    assert not other.handle.timers
    late = Driver()
    late.batch(0, ("config", 5, 0))
    late.batch(10, ("removed", 4, 1))  # of an older configuration
    assert late.handle.timers == {101}


def test_heartbeats_between_changes():
    dog = Driver()
    dog.batch(0, ("config", 1, 0))
    assert dog.batch(101) == ["trigger"]
    assert dog.batch(110, ("heartbeat", None, 1), ("removed", 2, 2)) == ["trigger", "resolve"]
    assert not dog.dog.value.exists()


def test_configuration_epochs(spark):
    a, b, none = (spark.createDataFrame([(x,) for x in xs], "agent string") for xs in ("ab", "bc", ""))
    rows = sorted(tuple(r) for r in keyed.configuration_epoch(a, b, 7).collect())
    assert rows == [("a", "removed", 7), ("b", "config", 7), ("c", "config", 7)]
    assert keyed.configuration_epoch(a, a, 8).count() == 0
    assert {r["kind"] for r in keyed.configuration_epoch(a, none, 9).collect()} == {"removed"}


@pytest.mark.parametrize("period", [1500])
def test_watchdog_stream(spark, tmp_path, period):
    source, schema = str(tmp_path / "in"), "agent string, kind string, epoch long, seq long"

    def add(name, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{source}/{name}")

    add(1, ("a", "config", 1, 1), ("b", "heartbeat", None, 2))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    query = (
        keyed.watchdog(stream, period).writeStream.format("memory").queryName("dog")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        for n, wanted in enumerate((["trigger"], ["trigger", "resolve"])):
            deadline = time.time() + 60
            while time.time() < deadline:
                got = [r["action"] for r in spark.table("dog").orderBy("at_ms").collect()]
                if got[: len(wanted)] == wanted:
                    break
                time.sleep(0.5)
            assert got[: len(wanted)] == wanted
            if n == 0:
                add(2, ("a", "config", 2, 3), ("a", "heartbeat", None, 4))
        assert {r["agent"] for r in spark.table("dog").collect()} == {"a"}
    finally:
        query.stop()
