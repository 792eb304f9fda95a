import json
import time

import pytest
from pyspark.sql import functions as F

from tidewarden.functions import text, times
from tidewarden.operators import (
    checks, configs, incidents, lag, mail_feed, pipes, silence, snapshots, topology,
)
from tidewarden.sources import documents


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def docs(spark, *texts, **extra):
    rows = [(t if isinstance(t, str) else json.dumps(t),) for t in texts]
    df = spark.createDataFrame(rows, "doc string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


# ---- text ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "iso, millis",
    [("PT1H", 3_600_000), ("PT90M", 5_400_000), ("P4D", 345_600_000), ("P1DT2H3M4.5S", 93_784_500), ("P2W", 1_209_600_000)],
)
def test_periods(spark, iso, millis):
    assert times.period_millis(iso) == millis
    assert one(spark, times.period_millis_column(F.lit(iso)))[0] == millis


@pytest.mark.parametrize("iso", ["", "P", "PT", "1h", "P1M", "P1Y", "soon"])
def test_no_periods(spark, iso):
    with pytest.raises(ValueError):
        times.period_millis(iso)
    assert one(spark, times.period_millis_column(F.lit(iso)))[0] is None


def test_periods_with_few_units_cost_no_more_than_full_ones(spark):
    """A unit that is not given was once cast, and each such cast threw an exception of its own."""

    def seconds(start: str, end: str) -> float:
        iso = F.concat(F.lit(start), (F.col("id") % 50 + 1).cast("string"), F.lit(end))
        df = spark.range(0, 20_000, 1, 1).select(times.period_millis_column(iso).alias("ms"))
        began = time.perf_counter()
        assert df.filter("ms > 0").count() == 20_000
        return time.perf_counter() - began

    few, full = (min(seconds(*x) for _ in range(3)) for x in (("PT", "S"), ("P1W1DT1H1M", ".25S")))
    assert few < 3 * full + 0.5


def test_period_text_counts_days(spark):
    assert one(spark, text.period_text(F.lit(4 * 86400 + 3 * 3600 + 125)))[0] == "4d 3h 2m 5s"


@pytest.mark.parametrize(
    "uri, masked",
    [
        ("http://user:pw@h:1/x?q=a@b", "http://user:*@h:1/x?q=a@b"),
        ("http://token@h/x", "http://*@h/x"),
        ("http://h/x@y", "http://h/x@y"),
        ("http://u:p:q@h", "http://u:*@h"),
        ("h:9119", "h:9119"),
    ],
)
def test_user_info_is_masked(spark, uri, masked):
    assert one(spark, text.mask_user_info(F.lit(uri)))[0] == masked


def test_body_limits(spark):
    row = one(spark, text.trim_body(F.lit("x" * 1025)), text.trim_body(F.lit("x" * 1024)), text.limit_body(F.lit("y" * 3500), 1000))
    assert row[0] == "x" * 1024 + " ..." and row[1] == "x" * 1024
    assert row[2] == "y" * 1000 + " ... (2,500 more chars)"


def test_numbers(spark):
    row = one(
        spark, text.round_half_up(F.lit(2.5)), text.round_half_up(F.lit(-2.5)), text.count_text(F.lit(1234567)),
        text.delta_text(F.lit(1000), F.lit(2000)), text.hours_text(F.lit(5_400_000)),
    )
    assert tuple(row) == (3, -2, "1,234,567 msg", "message delta: 1,000, time delta: 2,000 ms", "1.50 H")


def test_pairs_and_paths(spark):
    row = one(
        spark, text.host_port(F.lit("h:1")), text.host_port(F.lit("h:1:2")), text.host_port(F.lit("h:x")),
        text.partition_of_path(F.lit("/brokers/topics/a.b/partitions/3/state")), text.topic_of_path(F.lit("/brokers/topics/a-b")),
    )
    assert tuple(row[0]) == ("h", 1) and row[1] is None and row[2] is None
    assert tuple(row[3]) == ("a.b", 3) and row[4] == "a-b"


def test_right_map_wins(spark):
    left = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    right = F.create_map(F.lit("b"), F.lit("3"))
    assert one(spark, text.merge_maps(left, right))[0] == {"a": "1", "b": "3"}


# ---- lag -------------------------------------------------------------------------------------


def test_adjusted_offsets(spark):
    def adjusted(o, low, high):
        return one(spark, lag.adjust_offset(F.lit(o), F.lit(low), F.lit(high)))[0]

    assert [adjusted(5, 0, 10), adjusted(50, 0, 10), adjusted(-3, 2, 10), adjusted(1, 4, 4), adjusted(1, 5, 4)] == [5, 9, 2, 4, None]


def test_header_time(spark):
    row = one(spark, *[lag.header_millis(F.lit(h)) for h in ('{"received": 5, "t": 6}', '{"t": 6}', "{}")])
    assert tuple(row) == (5, 6, None)


def _lag(spark, processed, header="t"):
    log = spark.createDataFrame(
        [("a", 0, o, json.dumps({header: 1000 * o})) for o in range(3, 11)],
        "topic string, partition int, offset bigint, header string",
    )
    consumer = spark.createDataFrame([("e", "g", "a", 0, processed)], "env string, consumer_group string, topic string, partition int, processed bigint")
    consumer = consumer.join(lag.broker_offsets(log), lag.PARTITION)
    return lag.measure_backlog(consumer, log, ["env", "consumer_group", "topic"])


@pytest.mark.parametrize(
    "processed, messages, time, lost, ahead",
    [(4, 5, 5000, False, False), (10, 0, 0, False, False), (9, 0, 0, False, False), (0, 7, 7000, True, False), (20, 0, 0, False, True)],
)
def test_backlog(spark, processed, messages, time, lost, ahead):
    row = _lag(spark, processed).first()
    assert (row["messages"], row["time"], row["lost"], row["ahead"]) == (messages, time, lost, ahead)


def test_backlog_without_times_falls_back(spark):
    measured = _lag(spark, 4, header="other")
    assert measured.first()["error"] == "missing time header"
    row = lag.measured_or_fallback(measured, ["env", "consumer_group", "topic"]).first()
    assert (row["messages"], row["time"]) == (7, 0)
    row = lag.backlog_fallback(measured).first()
    assert (row["messages"], row["time"]) == (7, 0)


def test_missing_metadata_is_an_error(spark):
    offsets = spark.createDataFrame([("a", 0, 1), ("b", 2, 1)], "topic string, partition int, processed bigint")
    brokers = spark.createDataFrame([("a", 0, 0, 5)], "topic string, partition int, earliest bigint, latest bigint")
    errors = {r["topic"]: r["error"] for r in lag.with_metadata(offsets, brokers).collect()}
    assert errors == {"a": None, "b": "Couldn't fetch metadata for [b,2]"}


def test_topic_stat_without_positive_lag(spark):
    deltas = spark.createDataFrame([("a", 0, 5, 0, 10, 20), ("a", 1, 2, 0, 10, 20)], "topic string, partition int, messages bigint, time bigint, alert_ms bigint, pager_ms bigint")
    row = lag.topic_stat(deltas, ["topic"]).first()
    assert (row["max_partition"], row["max_messages"], row["avg_messages"], row["alert_partitions"]) == (-1, 0, 4, 0)


# ---- checks ----------------------------------------------------------------------------------


def _results(spark):
    return spark.createDataFrame(
        [(200, '{"hey": "what"}', None), (201, '{"hey": "what"}', None), (200, "junk", None), (None, None, "boom")],
        "status_code int, body string, error string",
    )


def test_predicates(spark):
    registry = {"sql": checks.expression_predicate}

    def verdicts(definition):
        ok, data = checks.predicate(definition, registry)
        return [r["ok"] for r in checks.apply_predicate(_results(spark), ok, data).collect()]

    assert verdicts(None) == [True, False, True, False]
    assert verdicts("status_code = 200 and get_json_object(body, '$.hey') = 'what'") == [True, False, False, False]
    assert verdicts({"type": "sql", "ok": "status_code = 201"}) == [False, True, False, False]
    for bad in ({"function": "x"}, {"type": "nope"}):
        with pytest.raises(ValueError):
            checks.predicate(bad, registry)


def test_predicate_data(spark):
    body = json.dumps([{"value": 100, "host": "host1"}, {"value": 51, "host": "host2"}, {"value": 2, "host": "notMe"}])
    df = spark.createDataFrame([(200, body, None)], "status_code int, body string, error string")
    rows = "from_json(body, 'array<struct<value:double,host:string>>')"
    over = f"transform(filter({rows}, x -> x.value > 50), x -> x.host)"
    ok, data = checks.expression_predicate(
        f"status_code = 200 and size({over}) > 0", f"map('count', string(size({rows})), 'violators', array_join({over}, ','))"
    )
    row = checks.apply_predicate(df, ok, data).first()
    assert row["ok"] and row["data"] == {"count": "3", "violators": "host1,host2"}


def test_user_checks(spark):
    inputs = spark.createDataFrame([("base", "good", 1), ("base", "bad", 2)], "base string, payload string, run_id int")

    def check(payload):
        if payload == "bad":
            raise RuntimeError("no")
        return [("sub", False, {"n": 1})]

    got = [(r["run_id"], r["name"], r["ok"], r["data"]) for r in checks.run_checks(inputs, check).collect()]
    assert got == [(1, "base", True, {}), (1, "sub", False, {"n": "1"}), (2, "base", False, {"error": "no"})]
    default = checks.run_checks(inputs.limit(1)).collect()
    assert [(r["name"], r["ok"]) for r in default] == [("base", True), ("default", True)]


@pytest.mark.parametrize(
    "runs, verdicts",
    [
        ([("base", True), ("sub", True)], ["other", "other"]),
        ([("base", False)], ["failed"]),
        ([("base", True), ("sub", False)], ["other", "failed"]),
        ([("base", False), ("base", True)], ["failed", "resolved"]),
        ([("sub", False), ("sub", True), ("base", True)], ["failed", "resolved", "other"]),
    ],
)
def test_check_verdicts(spark, runs, verdicts):
    rows = [("g", n, i, ok, 1, 1) for i, (n, ok) in enumerate(runs)]
    df = spark.createDataFrame(rows, "group string, name string, ts bigint, ok boolean, fail_count int, resolve_count int")
    got = checks.streaks(df, ["group", "name"], ["ts"]).orderBy("ts").collect()
    assert [r["verdict"] for r in got] == verdicts


def test_due(spark):
    defs = spark.createDataFrame(
        [("g", "always", None, None), ("g", "never_run", 60_000, True), ("g", "edge", 60_000, True), ("g", "late", 59_999, True), ("g", "off", None, False)],
        "group string, name string, period_ms bigint, enabled boolean",
    )
    last = times.utc("2024-01-01T00:00:00")
    runs = spark.createDataFrame([("g", n, last) for n in ("edge", "late", "always")], "group string, name string, last_run timestamp")
    got = checks.due(defs, runs, times.at("2024-01-01T00:01:00"))
    assert sorted(r["name"] for r in got.collect()) == ["always", "late", "never_run"]


def test_status_ranges(spark):
    row = one(spark, *[checks.success_range(F.lit(s)) for s in (199, 200, 399, 400)], *[checks.posted(F.lit(s)) for s in (299, 300)])
    assert list(row) == [False, True, True, False, True, False]


def test_mail_feed(spark):
    def entry(title, issued, name, email):
        return (
            f"<entry><title>{title}</title><summary>s</summary><modified>2014-06-12T19:00:05Z</modified><issued>{issued}</issued>"
            f"<author><name>{name}</name><email>{email}</email></author></entry>"
        )

    feed = (
        '<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://purl.org/atom/ns#"><title>Inbox</title>'
        + entry("Check triggered at 11:00", "2024-01-01T10:00:00Z", "Alerts", "alerts@example.com")
        + entry("Something", "2014-04-18T02:28:31Z", "Other", "admin@example.org")
        + entry("Else &amp; more", "2014-04-02T19:16:34Z", "User", "user@example.com")
        + "</feed>"
    )
    entries = documents.atom_entries(docs(spark, feed))
    assert [r["title"] for r in entries.collect()][2] == "Else & more"
    for now, recent in (("10:00:00", 1), ("11:59:00", 1), ("12:00:00", 0), ("12:01:00", 0)):
        row = mail_feed.mail_counts(entries, times.at(f"2024-01-01T{now}"), " alerts@example.com", "Check triggered at.*").first()
        assert (row["total_mails"], row["matching_mails"], row["recent_mails"], row["ok"]) == (3, 1, recent, recent > 0)
    row = mail_feed.mail_counts(entries, times.at("2024-01-01T10:00:00"), "alerts@example.com", "Check").first()
    assert row["matching_mails"] == 0
    bare = "<feed><entry><title>a</title></entry>" + entry("b", "2024-01-01T10:00:00Z", "n", "b@c") + "</feed>"
    rows = documents.atom_entries(docs(spark, bare, "<feed/>")).collect()
    assert [(r["title"], r["email"]) for r in rows] == [("a", None), ("b", "b@c")]


# ---- snapshots -------------------------------------------------------------------------------


def test_master_snapshot_keeps_non_zero_doubles(spark):
    df = docs(spark, '{"a": 0.0, "b": 0.5, "c": 2, "d": 1e-9, "e": -3.0, "f": 1E2}')
    kept = {r["metric"]: r["value"] for r in snapshots.unpivot_snapshot(df, only_non_zero=True).collect()}
    assert kept == {"b": 0.5, "e": -3.0, "f": 100.0}
    assert snapshots.unpivot_snapshot(df).count() == 6


def test_container_statistics(spark):
    info = {"container_id": "c", "executor_id": "e", "framework_id": "f", "source": "s", "statistics": {"cpus": 1.5, "timestamp": 9.0, "n": 2}}
    other = {**info, "status": {"executor_pid": 77, "container_id": {"value": "c"}}}
    rows = snapshots.unpivot_statistics(docs(spark, [info, other]), "container").collect()
    assert len(rows) == 4
    assert [r["dims"]["executor_pid"] for r in rows] == [["-1"], ["-1"], ["77"], ["77"]]
    assert {r["metric"] for r in rows} == {"mesos/container/cpus", "mesos/container/n"}


def test_agents_listed_twice_count_once(spark):
    listing = {"slaves": [{"id": f"i{n}", "pid": f"slave(1)@10.0.0.{n}:5051", "version": "0.27.0", "active": True} for n in range(3)] + [{"id": "odd", "pid": "x"}]}
    found = snapshots.distinct_slaves(snapshots.slaves(docs(spark, listing, listing, env="e")))
    rows = {r["id"]: (r["host"], r["port"], r["error"]) for r in found.collect()}
    assert rows["i1"] == ("10.0.0.1", 5051, None) and len(rows) == 4
    assert rows["odd"][2] == "Error parsing `x`, Expected two sides of a `@`"


# ---- documents -------------------------------------------------------------------------------


def test_work_items_last_duplicate_wins(spark):
    doc = [["a", {"pipeId": "p", "intervals": ["2024-01-01/2024-01-02"]}], ["b.failed", {"more": {"log": "l"}}], ["a", {"pipeId": "p", "intervals": ["2023-01-01/2023-01-02"]}], ["c.failed", {}]]
    items = documents.work_items(docs(spark, doc, env="e"))
    assert items.count() == 3
    work = pipes.min_work_time(items, ["env", "pipe_id"]).collect()
    assert [(r["pipe_id"], r["min_time"].year) for r in work] == [("p", 2023)]
    logs = {r["job"]: r["log"] for r in pipes.failed_jobs(items).collect()}
    assert logs == {"b": "l", "c": "No log found for the job"}


def test_max_time_and_load(spark):
    rows = documents.max_time(docs(spark, [{"result": "2024-01-01T00:00:00Z"}], [], "oops")).collect()
    assert rows[0]["max_time"].year == 2024 and rows[1]["error"] and rows[2]["error"] == "Cannot parse response from broker: oops"
    load = documents.load_status(docs(spark, {"a": 3, "b": 0})).collect()
    assert {r["datasource"]: r["load"] for r in load} == {"a": 3, "b": 0}


def test_jobs(spark):
    listing = docs(spark, {"results": [{"pipeline": "p", "jobs": [{"id": 1}]}, {"pipeline": "idle", "jobs": []}]})
    config = {
        "job.name": "j", "task.inputs": "kafka-a.t1, kafka-b.t2", "task.checkpoint.system": "kafka-a",
        "systems.kafka-a.producer.bootstrap.servers": "h1:9092,h2:9092", "systems.kafka-b.producer.metadata.broker.list": "h3:1",
    }
    explained = docs(spark, {"results": {"explanation": [config]}}, pipeline="p")
    rows = documents.job_config(documents.running_jobs(listing, explained)).orderBy("stream").collect()
    assert [(r["system"], r["stream"], len(r["servers"]), r["error"]) for r in rows] == [("kafka-a", "t1", 2, None), ("kafka-b", "t2", 1, None)]


# ---- configurations --------------------------------------------------------------------------


def test_datasource_thresholds(spark):
    alert = json.dumps({"bar": "PT1H", "baz": {"threshold": "PT2H"}, "qux": {"threshold": "PT3H", "pagerKey": "hey"}, "bad": 7})
    df = spark.createDataFrame([("e", alert)], "env string, alert string")
    rows = {r["datasource"]: (r["threshold_ms"], r["pager_key"], r["error"] is not None) for r in configs.datasource_thresholds(df).collect()}
    hour = 3_600_000
    assert rows == {"bar": (hour, None, False), "baz": (2 * hour, None, False), "qux": (3 * hour, "hey", False), "bad": (None, None, True)}


def test_check_definitions(spark):
    services = {
        "plain": {"uri": "h:1"},
        "full": {"uri": "h:1", "pingPeriod": "PT5M", "failCount": 7, "resolveCount": 1, "pagerKey": "k", "ignoreFailedFetch": True},
        "badflag": {"uri": "h:1", "ignoreFailedFetch": "lol"},
        "badtype": {"uri": "h:1", "predicate": {"type": "nope"}},
        "nosender": {"uri": "h:1", "predicate": {"type": "gmailRss", "titleRegex": "x"}},
        "mail": {"uri": "h:1", "predicate": {"type": "gmailRss", "senderAddress": "a@b"}},
    }
    df = spark.createDataFrame([("g", json.dumps({"services": services}))], "group string, payload string")
    rows = {r["name"]: r for r in configs.check_definitions(df, "services").collect()}
    assert (rows["plain"]["fail_count"], rows["plain"]["resolve_count"], rows["plain"]["enabled"]) == (3, 2, True)
    assert (rows["full"]["period_ms"], rows["full"]["fail_count"], rows["full"]["ignore_failed_fetch"]) == (300_000, 7, True)
    assert {n for n, r in rows.items() if r["error"]} == {"badflag", "badtype", "nosender"}


def test_cluster_settings_honour_false(spark):
    payload = {"zkConnect": "z", "brokersCount": 3, "alert": {"OfflinePartitions": False, "UnderReplicatedPeriod": "PT10M", "UnderReplicatedPartitionsPercentage": 2.5}}
    row = configs.cluster_settings(spark.createDataFrame([("e", json.dumps(payload))], "env string, payload string")).first()
    assert (row["broker_start_id"], row["offline"], row["pct"], row["under_replicated_ms"], row["zk_timeout_ms"]) == (1, False, 2.5, 600_000, 30_000)


def test_other_settings(spark):
    def read(reader, payload):
        return reader(spark.createDataFrame([("e", json.dumps(payload))], "env string, payload string")).first()

    row = read(configs.pipe_settings, {"control": "c", "delayPagers": {"a": "PT1H"}})
    assert (row["default_delay_ms"], row["default_throttle_ms"], row["delay_ms"]) == (345_600_000, 21_600_000, {"a": 3_600_000})
    row = read(configs.job_settings, {"guardianService": "g", "alertThreshold": "PT1M", "pagerThreshold": "PT2M"})
    assert (row["alert_ms"], row["pager_ms"], row["error"]) == (60_000, 120_000, None)
    row = read(configs.manager_settings, {"zkMasterPath": "/m", "zkMaxRetries": 4})
    assert (row["zkMaxRetries"], row["zkSessionTimeout"], row["error"]) == (4, 60001, None)
    assert read(configs.manager_settings, {})["error"] == "zkMasterPath"


def test_config_alerts_when_there_is_none(spark):
    empty = spark.createDataFrame([], "key string, payload string, error string")
    assert configs.config_alerts(empty, "agent").count() == 0
    assert configs.config_alerts(empty, "agent", alert_when_none=True).first()["description"] == "No config for agent"


# ---- topology, pipes, incidents --------------------------------------------------------------


def _changes(spark, rows):
    data = [(t, p, s, times.utc(f"2024-01-01T00:00:{s:02d}"), k, ids) for t, p, s, k, ids in rows]
    return spark.createDataFrame(data, "topic string, partition int, seq int, ts timestamp, kind string, ids array<int>")


def test_since_is_the_start_of_the_current_run(spark):
    rows = _changes(spark, [
        ("t", 0, 1, "assigned", [1, 2]), ("t", 0, 2, "isr", [1, 2]), ("t", 0, 3, "isr", [1]), ("t", 0, 4, "isr", []),
        ("t", 0, 5, "isr", [1]), ("t", 0, 6, "isr", [1, 2]), ("t", 0, 7, "isr", [2]), ("t", 1, 8, "isr", []), ("t", 1, 9, "removed", None),
    ])
    got = {r["seq"]: r for r in topology.partition_history(rows).collect()}
    assert got[1]["offline"] and got[1]["under_replicated"]
    assert got[4]["offline_since"].second == 4 and got[4]["under_replicated_since"].second == 3
    assert got[6]["under_replicated_since"] is None and got[7]["under_replicated_since"].second == 7
    state = topology.partition_state(topology.partition_history(rows))
    assert [r["partition"] for r in state.collect()] == [0]


def test_topic_removal_clears_all_partitions(spark):
    rows = _changes(spark, [("t", 0, 1, "isr", []), ("t", 1, 2, "isr", []), ("u", 0, 3, "isr", []), ("t", None, 4, "removed", None)])
    state = topology.partition_state(topology.partition_history(topology.per_partition(rows)))
    assert [(r["topic"], r["partition"]) for r in state.collect()] == [("u", 0)]


def test_empty_cluster_raises_nothing(spark):
    state = topology.partition_state(topology.partition_history(_changes(spark, [])))
    assert topology.under_replicated_pct(state).collect()[0]["pct"] is None
    found = topology.cluster_conditions(state, "e", times.at("2024-01-01T00:00:00"), 5.0, 1000, True)
    assert [r["failing"] for r in found.collect()] == [False, False, False]
    nan = F.lit(0.0) / F.lit(1.0) * F.lit(float("nan"))
    assert one(spark, topology.over_threshold(nan, F.lit(5.0)))[0] is False


def test_newest_and_longest_condition(spark):
    rows = _changes(spark, [("a", 0, 1, "isr", []), ("b", 0, 5, "isr", [])])
    state = topology.partition_state(topology.partition_history(rows))
    now = times.at("2024-01-01T00:01:05")
    assert topology.newest_condition(state, "offline_since", now).first()["age"] == "0d 0h 1m 0s"
    assert topology.newest_condition(state, "offline_since", now, longest=True).first()["topic"] == "a"


def test_backlog_defaults(spark):
    channels = spark.createDataFrame([("e", "a", None), ("e", "b", "fast"), ("e", "c", "fast")], "env string, pipe_id string, channel string")
    work = spark.createDataFrame([("e", "a", times.utc("2024-01-01T00:00:00"))], "env string, pipe_id string, min_time timestamp")
    periods = spark.createDataFrame([("e", "c", 5)], "env string, pipe_id string, period_ms bigint")
    out = pipes.pipe_backlog(channels, work, periods, times.at("2024-01-01T00:00:01.9"), ["env", "pipe_id"])
    got = {r["pipe_id"]: (r["period_ms"], r["lag_seconds"]) for r in out.collect()}
    assert got == {"a": (345_600_000, 1), "b": (0, 0), "c": (5, 0)}


def test_flag_that_needs_a_key(spark):
    rows = [(1, True, None), (2, False, "k"), (3, True, "k"), (4, False, None), (5, False, "k")]
    df = spark.createDataFrame([("e", t, f, p) for t, f, p in rows], "env string, ts bigint, failing boolean, pager_key string")
    got = incidents.every_failing(df, ["env"], ["ts"], flag_needs_key=True)
    assert [(r["ts"], r["action"]) for r in got.orderBy("ts").collect()] == [(3, "trigger"), (5, "resolve")]


def test_direct_pages_leave_a_record(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "sent boolean")
    assert [r["page"] for r in incidents.pager_events(df, F.col("sent")).collect()] == [False, True, True]
    assert all(r["page"] for r in incidents.pager_events(df, None).collect())


def test_stuck(spark):
    t = times.utc("2024-01-01T00:00:00")
    runs = spark.createDataFrame([("a", t, 60_000), ("b", t, 59_999)], "job string, started_at timestamp, period_ms bigint")
    assert [r["job"] for r in silence.stuck(runs, times.at("2024-01-01T00:03:00")).collect()] == ["b"]
