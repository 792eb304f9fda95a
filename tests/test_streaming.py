"""Streams give what the batch forms give over the whole history."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import (
    checks, events, freshness, incidents, lag, silence, status, throttle, topology,
)
from tidewarden.plans import views
from tidewarden.sinks import outbox
from tidewarden.sinks.status_store import StatusStore, create_status_tables
from tidewarden.sources import feeds
from tidewarden.streaming import jobs, processors, rules

SF = "/root/testdata/sf0.001"
HOUR = views.HOUR_US


def _as_stream(spark, df, path, parts=3):
    """Rows written as files in time order, read one file per micro-batch."""
    cuts = df.approxQuantile("at", [i / parts for i in range(1, parts)], 0.0)
    bounds = [float("-inf"), *cuts, float("inf")]
    for i in range(parts):
        piece = df.filter((F.col("at") > bounds[i]) & (F.col("at") <= bounds[i + 1]))
        piece.coalesce(1).write.parquet(f"{path}/part{i}")
        time.sleep(0.05)
    return (
        spark.readStream.schema(df.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def _run(df, name, tmp_path):
    query = (
        df.writeStream.format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .outputMode("append")
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return df.sparkSession.table(name)


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def _observed(spark):
    at = F.unix_micros("ts").alias("at")
    return views.events(spark, SF).select("*", at, (F.col("event_type") == "error").alias("failing"))


def test_greedy_throttle(spark, tmp_path):
    rows = _observed(spark).select("user_id", "event_id", "ts", "at")
    want = throttle.greedy_throttle(rows, ["user_id"], ["ts", "event_id"], F.lit(6 * HOUR))
    stream = processors.apply_rule(
        _as_stream(spark, rows.drop("ts"), str(tmp_path / "in")),
        rules.greedy(6 * HOUR),
        ["user_id"],
        ["at", "event_id"],
        "user_id bigint, event_id bigint",
    )
    _same(_run(stream, "greedy", tmp_path), want.select("user_id", "event_id"))


def test_streak_verdicts(spark, tmp_path):
    rows = views.checks(spark, SF).withColumn("at", F.unix_micros("ts"))
    want = checks.streaks(rows, ["name"], ["ts", "event_id"]).select("name", "event_id", "verdict")
    small = rows.select("name", "event_id", "at", "ok", "fail_count", "resolve_count")
    stream = processors.apply_rule(
        _as_stream(spark, small, str(tmp_path / "in")),
        rules.streak,
        ["name"],
        ["at", "event_id"],
        "name string, event_id bigint, action string",
    )
    _same(_run(stream, "streak", tmp_path), want)


def test_stale_and_edge(spark, tmp_path):
    rows = _observed(spark).select("user_id", "event_id", "ts", "at", "failing")
    keyed = rows.withColumn("pager_key", F.lit("pk"))
    order = ["ts", "event_id"]
    source = str(tmp_path / "in")
    stream = _as_stream(spark, rows.drop("ts"), source)
    output = "user_id bigint, event_id bigint, action string"
    for name, rule, want in (
        ("stale", rules.stale(12 * HOUR), incidents.throttled(keyed, ["user_id"], order, 12 * HOUR)),
        ("edge", rules.edge, incidents.rising_edge(keyed, ["user_id"], order)),
        ("every", rules.every, incidents.every_failing(keyed, ["user_id"], order)),
    ):
        out = processors.apply_rule(stream, rule, ["user_id"], ["at", "event_id"], output)
        _same(_run(out, name, tmp_path / name), want.select("user_id", "event_id", "action"))


def test_partition_state(spark, tmp_path):
    rows = views.changes(spark, SF).withColumn("at", F.unix_micros("ts"))
    history = topology.partition_history(rows).filter("present")
    want = history.select(
        "seq", F.unix_micros("offline_since"), F.unix_micros("under_replicated_since")
    )
    stream = processors.apply_rule(
        _as_stream(spark, rows.drop("ts"), str(tmp_path / "in")),
        rules.partitions,
        ["topic"],
        ["at", "seq"],
        "seq bigint, offline bigint, under bigint",
    )
    _same(_run(stream, "parts", tmp_path), want)


def test_load_grace_and_counter(spark, tmp_path):
    rows = _observed(spark).select(
        "user_id", "event_id", "ts", "at",
        F.when(F.col("value") < 30, 0).otherwise(F.floor("value")).alias("load"),
        (F.col("event_id") % 2).alias("broker"),
        F.floor("value").alias("reading"),
    )
    source = _as_stream(spark, rows.drop("ts"), str(tmp_path / "in"))
    order = ["ts", "event_id"]
    grace = freshness.load_grace(rows, ["user_id"], order).select("event_id", F.unix_micros("started_at"))
    out = processors.apply_rule(
        source, rules.load_grace(900_000_000), ["user_id"], ["at", "event_id"], "event_id bigint, since bigint"
    )
    _same(_run(out, "grace", tmp_path / "grace"), grace)
    rises = topology.counter_increase(rows, ["user_id"], order).select("event_id", "increase")
    out = processors.apply_rule(
        source, rules.counter, ["user_id"], ["at", "event_id"], "event_id bigint, increase bigint"
    )
    _same(_run(out, "counter", tmp_path / "counter"), rises)


def test_session_damped_and_backlog(spark, tmp_path):
    rows = _observed(spark).select(
        "user_id", "event_id", "ts", "at", F.lit("pk").alias("pager_key"),
        ((F.col("user_id") % 3) * 1_800_000).alias("period_ms"),
        (F.unix_micros("ts") - F.floor("value") * 60_000_000).alias("oldest"),
    ).withColumns({"min_time": F.timestamp_micros("oldest"), "period": F.col("period_ms") * 1000})
    source = _as_stream(spark, rows.drop("ts", "min_time"), str(tmp_path / "in"))
    order, start = ["ts", "event_id"], views.START_US
    for name, rule, want in (
        ("session", rules.session(HOUR), throttle.session_throttle(rows, ["user_id"], order, HOUR)),
        (
            "damped",
            rules.greedy(HOUR, strict=False, start=start),
            silence.damped_heartbeats(rows, ["user_id"], order, HOUR // 1000, views.start()),
        ),
    ):
        out = processors.apply_rule(source, rule, ["user_id"], ["at", "event_id"], "user_id bigint, event_id bigint")
        _same(_run(out, name, tmp_path / name), want.select("user_id", "event_id"))
    pages = incidents.backlog_pager(rows, ["user_id"], order, 2 * HOUR)
    out = processors.apply_rule(
        source, rules.backlog(2 * HOUR), ["user_id"], ["at", "event_id"], "event_id bigint, action string"
    )
    _same(_run(out, "backlog", tmp_path / "backlog"), pages.select("event_id", "action"))


def test_failed_jobs(spark, tmp_path):
    rows = views.events(spark, SF).select(
        F.col("event_type").alias("env"), F.date_trunc("day", "ts").alias("ts"),
        F.concat(F.lit("job"), (F.col("user_id") % 4).cast("string")).alias("job"),
        ((F.col("user_id") % 4) * 86_400_000).alias("throttle_ms"), "value",
    )
    failed = rows.filter(F.col("value") > 90).select("env", "job", "ts", "throttle_ms", F.lit("pk").alias("pager_key")).distinct()
    probes = rows.select("env", "ts").distinct()
    want = incidents.failed_job_pager(probes, failed).select("env", "job", F.unix_micros("ts"), "action")
    pair = F.struct("job", (F.col("throttle_ms") * 1000).alias("gap"))
    listed = failed.groupBy("env", "ts").agg(F.to_json(F.collect_list(pair)).alias("failing"))
    whole = probes.join(listed, ["env", "ts"], "left").select("env", F.unix_micros("ts").alias("at"), "failing")

    def rule(state, row):
        found = json.loads(row["failing"] or "[]")
        return rules.failed_jobs(state, {**row, "jobs": [[f["job"], f["gap"]] for f in found]})

    stream = processors.apply_rule(
        _as_stream(spark, whole, str(tmp_path / "in")), rule, ["env"], ["at"],
        "env string, job string, at bigint, action string",
    )
    _same(_run(stream, "jobs", tmp_path), want)


def test_status_tables_are_made_once(spark, tmp_path):
    for _ in range(2):
        create_status_tables(spark, "default", str(tmp_path))
    columns = spark.table("default.status_current").columns
    assert columns[:2] == ["ts", "service"] and spark.table("default.status_history").count() == 0
    for name in ("current", "history"):
        spark.sql(f"DROP TABLE default.status_{name}")


def test_log_stream_reads_on(spark, tmp_path):
    schema = "system string, stream string, partition int, offset bigint, log_offset bigint"
    rows = [("s", "t", 0, 5, 1), ("s", "t", 0, 7, 2), ("s", "t", 1, 1, 3)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = feeds.read_log(spark, str(tmp_path / "in"), schema)
    out = _run(stream, "log", tmp_path)
    assert sorted(r["offset"] for r in lag.latest_checkpoints(out).collect()) == [1, 7]
    assert feeds.read_log(spark, str(tmp_path / "in"), schema, streaming=False).count() == 3


def test_status_job_equals_batch_and_survives_a_repeat(spark, tmp_path):
    rows = views.statuses(spark, SF)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    body = F.struct(stamp, "service", "host", "agent", "track", "tags", "value", "message")
    lines = rows.select("arrival", F.to_json(body).alias("payload")).withColumn("at", F.col("arrival"))
    broken = spark.range(3).select(F.col("id").alias("arrival"), F.lit("{oops").alias("payload"), F.col("id").alias("at"))
    source = _as_stream(spark, lines.unionByName(broken), str(tmp_path / "in"))
    root = str(tmp_path / "out")
    handler = jobs.status_job(spark, source, root)
    query = jobs.start(source.drop("at"), handler, str(tmp_path / "cp"), {"availableNow": True})
    query.awaitTermination(120)
    store = StatusStore(spark, f"{root}/status")
    key = ["track", "ts", "arrival"]
    _same(store.read("current").select(*key), status.latest_status(rows).select(*key))
    _same(store.read("history").select(*key), status.status_history(rows).select(*key))
    assert spark.read.parquet(f"{root}/dead_letters/statuses").count() == 3
    before = store.read("current").collect()
    store.upsert(rows.limit(5), 0)
    assert store.read("current").collect() == before


def test_status_store_compacts(spark, tmp_path):
    rows = views.statuses(spark, SF)
    store = StatusStore(spark, str(tmp_path), history_size=3, compact_every=2)
    assert store.read("current").count() == 0
    for i in range(5):
        store.upsert(rows.filter(F.col("arrival") % 5 == i), i)
    key = ["track", "ts", "arrival"]
    _same(store.read("current").select(*key), status.latest_status(rows).select(*key))
    _same(store.read("history").select(*key), status.status_history(rows, 3).select(*key))
    assert store._committed() == (3, [4])
    before = store.read("history").collect()
    for i in (2, 4):
        store.upsert(rows.limit(9), i)
    assert store.read("history").collect() == before


def test_feed_jobs_write_outboxes(spark, tmp_path):
    root = str(tmp_path)
    pager = {
        "timestamp": "2024-01-01T00:00:00Z", "service": "s", "host": "h", "page": True,
        "data": {"type": "trigger", "incidentKey": "i", "serviceKey": "k", "description": "d", "details": {"a": {"x": 1}}},
    }
    batch = spark.createDataFrame([(json.dumps(pager),), (json.dumps({**pager, "page": False}),)], "payload string")
    jobs.pager_job(root)(batch, 0)
    page = spark.read.parquet(f"{root}/pages").collect()
    assert len(page) == 1
    assert json.loads(page[0]["payload"])["event_type"] == "trigger"
    alert = {"timestamp": "2024", "service": "s", "host": "h", "severity": "service-failure", "description": "d", "data": {"b": 1, "a": None}}
    batch = spark.createDataFrame([(json.dumps(alert),), (json.dumps({**alert, "timestamp": "hey"}),)], "payload string")
    jobs.alert_job(root)(batch, 0)
    mail = spark.read.parquet(f"{root}/mails").collect()
    assert [m["subject"] for m in mail] == ["[SERVICE_FAILURE] s: d"]
    beat = {"timestamp": "2024", "service": "s", "host": "h", "agent": "a1"}
    batch = spark.createDataFrame([(json.dumps(beat),), (json.dumps({**beat, "agent": "zz"}),)], "payload string")
    jobs.heartbeat_job(root, lambda: spark.createDataFrame([("a1",)], "agent string"))(batch, 0)
    assert [r["agent"] for r in spark.read.parquet(f"{root}/heartbeats").collect()] == ["a1"]
    assert [r["agent"] for r in spark.read.parquet(f"{root}/unexpected").collect()] == ["zz"]
    for number, (stamp, pages_) in enumerate((("2024-01-01T00:10:00Z", 0), ("2024-01-01T00:24:00Z", 0), ("2024-01-01T00:40:00Z", 1)), 1):
        again = spark.createDataFrame([(json.dumps({**beat, "agent": "zz", "timestamp": stamp}),)], "payload string")
        for _ in range(2):  # a repeat of the batch changes nothing
            jobs.heartbeat_job(root, lambda: spark.createDataFrame([("a1",)], "agent string"))(again, number)
        assert spark.read.parquet(f"{root}/unexpected/batch={number}").count() == pages_
    alerts = spark.read.parquet(f"{root}/alerts/alerts").collect()
    assert [(r["description"], r["n"]) for r in alerts] == [("Failed to process event from alerts", 1)]


def test_silence_watchdog_pages_and_resolves(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "agent string, kind string"
    spark.createDataFrame([("a", "config"), ("b", "heartbeat")], schema).coalesce(1).write.parquet(f"{source}/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    query = (
        processors.silence_watchdog(stream, 1500).writeStream.format("memory").queryName("silence")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        for wanted in (["trigger"], ["trigger", "resolve"]):
            deadline = time.time() + 60
            while time.time() < deadline:
                got = [r["action"] for r in spark.table("silence").orderBy("at_ms").collect()]
                if got[: len(wanted)] == wanted:
                    break
                time.sleep(0.5)
            assert got[: len(wanted)] == wanted
            spark.createDataFrame([("a", "heartbeat")], schema).coalesce(1).write.mode("append").parquet(f"{source}/2")
        assert {r["agent"] for r in spark.table("silence").collect()} == {"a"}
    finally:
        query.stop()


def test_configuration_changes(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "agent string") for xs in ("ab", "bc"))
    rows = {tuple(r) for r in processors.configuration_changes(a, b).collect()}
    assert rows == {("a", "removed"), ("c", "config")} and processors.configuration_changes(a, a).count() == 0


def test_a_removed_agent_is_not_paged(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "agent string, kind string"
    spark.createDataFrame([("a", "config"), ("b", "config")], schema).coalesce(1).write.parquet(f"{source}/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    query = (
        processors.silence_watchdog(stream, 12_000).writeStream.format("memory").queryName("removed")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    )
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not (query.lastProgress or {}).get("numInputRows"):
            time.sleep(0.2)
        spark.createDataFrame([("a", "removed"), ("b", "config")], schema).coalesce(1).write.parquet(f"{source}/2")
        while time.time() < deadline and not spark.table("removed").count():
            time.sleep(0.5)
        time.sleep(1)
        assert [tuple(r)[:2] for r in spark.table("removed").collect()] == [("b", "trigger")]
    finally:
        query.stop()


def test_status_tables_hold_the_published_state(spark, tmp_path):
    rows = views.statuses(spark, SF)
    store = StatusStore(spark, str(tmp_path / "store"), history_size=2)
    store.upsert(rows, 0)
    create_status_tables(spark, "default", str(tmp_path / "tables"))
    try:
        for _ in range(2):
            store.publish("default")
        assert spark.table("default.status_current").count() == store.read("current").count()
        assert spark.table("default.status_history").count() == store.read("history").count()
    finally:
        for name in ("current", "history"):
            spark.sql(f"DROP TABLE default.status_{name}")


def test_metrics_of_a_repeated_batch_count_once(spark, tmp_path):
    metrics = events.heartbeat_metrics(views.heartbeats(spark, SF))
    for _ in range(2):
        outbox.write_metrics(metrics, str(tmp_path), 3)
    assert spark.read.parquet(str(tmp_path)).count() == metrics.count()


def test_mail_digest_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "subject string, body string, arrival bigint"
    mails = [("s", f"m{i}", i) for i in range(7)]
    spark.createDataFrame(mails, schema).coalesce(1).write.parquet(f"{source}/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    query = (
        processors.mail_digests(stream, [500, 1000], 4).writeStream.format("memory").queryName("digests")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    )
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not spark.table("digests").count():
            time.sleep(0.5)
        row = spark.table("digests").first()
    finally:
        query.stop()
    assert row["mails"] == 7
    assert row["text"].split("\n\n---\n\n") == ["m0", "m1", "... (3 omitted)", "m5", "m6"]


def test_read_feeds_merges_sources(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        beat = {"timestamp": "2000", "service": name, "host": "localhost", "agent": "007"}
        (tmp_path / name / "f.json").write_text(json.dumps(beat) + "\n")
    merged = feeds.read_feeds([feeds.read_files(spark, str(tmp_path / n)) for n in ("x", "y")])
    assert merged.isStreaming
    out = _run(events.good(feeds.decode(merged, "heartbeats")), "merged", tmp_path)
    assert sorted(r["service"] for r in out.collect()) == ["x", "y"]
    with pytest.raises(KeyError):
        feeds.decode(merged, "nonsense")
