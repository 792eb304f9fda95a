"""Event-time windows of a stream: those of rows in time equal the windows of the whole table, late rows are kept apart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewarden.operators import events
from tidewarden.plans import views
from tidewarden.streaming import jobs, windows

SCHEMA = "ts timestamp, arrival long, description string, exception string, sample string"
START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def _row(minute, arrival, kind="a"):
    stamp = None if minute is None else START + dt.timedelta(minutes=minute)
    return (stamp, arrival, f"d-{kind}", None if kind == "b" else f"e-{kind}", f"s{arrival}")


def _batches():
    """Rows whose instants waver by less than the delay, a few that are far too late, and one without an instant."""
    rng = random.Random(5)
    batches, arrival = [], 0
    for step in range(6):
        rows = []
        for _ in range(40):
            rows.append(_row(step * 12 + rng.randrange(12) - rng.randrange(8), arrival, rng.choice("ab")))
            arrival += 1
        batches.append(rows)
    batches[4] += [_row(2, 900), _row(3, 901, "b"), _row(None, 902)]
    batches.append([_row(500, 990)])
    return batches


def _same(a, b):
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def _read(spark, path):
    return spark.read.parquet(path).drop("batch")


def _check(spark, root, all_rows):
    late = _read(spark, f"{root}/late").collect()
    assert {r["arrival"] for r in late} == {900, 901, 902}
    in_time = spark.createDataFrame([r for r in all_rows if r[1] not in {900, 901, 902}], SCHEMA)
    given = _read(spark, f"{root}/windows").select("window_start", "description", "exception", "n", "first_sample").collect()
    want = events.alert_aggregate(in_time, "5 minutes").filter(F.col("window_start") < F.lit(START + dt.timedelta(minutes=490)))
    _same(given, want.collect())
    assert given


def test_windows_of_batches_and_repeated_batches(spark, tmp_path):
    handle = windows.alert_windows(delay="10 minutes").handler(str(tmp_path))
    batches = _batches()
    for i, rows in enumerate(batches):
        for _ in range(1 + i % 2):  # every second batch runs twice
            handle(spark.createDataFrame(rows, SCHEMA), i)
    _check(spark, tmp_path, [r for b in batches for r in b])
    assert _read(spark, f"{tmp_path}/open/batch=6").count() == 1  # only the last window is still open


def test_windows_of_a_stream_that_is_restarted(spark, tmp_path):
    batches = _batches()
    source = str(tmp_path / "in")

    def run(from_batch, to_batch):
        for i in range(from_batch, to_batch):
            spark.createDataFrame(batches[i], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            handle = windows.alert_windows(delay="10 minutes").handler(str(tmp_path / "out"))
            query = jobs.start(stream, handle, str(tmp_path / "checkpoint"), {"availableNow": True})
            query.awaitTermination(120)

    run(0, 3)
    run(3, len(batches))
    _check(spark, tmp_path / "out", [r for b in batches for r in b])


def test_empty_batches(spark, tmp_path):
    handle = windows.alert_windows().handler(str(tmp_path))
    for i in range(2):
        handle(spark.createDataFrame([], SCHEMA), i)
    assert _read(spark, f"{tmp_path}/windows").count() == 0
    assert _read(spark, f"{tmp_path}/watermark/batch=1").first()["at"] is None


def test_rates_of_windows_equal_the_batch_form(spark, tmp_path):
    metrics = events.alert_metrics(views.alerts(spark, "/root/testdata/sf0.001"))
    dims = ["service", "severity"]
    shape = windows.rate_windows(dims, "1 hour", "400 days")
    rows = windows.rate_rows(metrics, dims)
    _same(shape.over(rows).collect(), events.event_rate(metrics, dims).collect())
    handle = shape.handler(str(tmp_path))
    lots = F.pmod(F.xxhash64("ts"), F.lit(2))
    for i in range(2):
        handle(rows.filter(lots == i), i)
    handle(rows.limit(1).withColumn("ts", F.lit(dt.datetime(2100, 1, 1, tzinfo=dt.timezone.utc))), 2)
    _same(_read(spark, f"{tmp_path}/windows").collect(), events.event_rate(metrics, dims).collect())
