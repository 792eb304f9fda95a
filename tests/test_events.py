import json

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import events, status
from tidewarden.sinks import outbox
from tidewarden.sources import feeds


def _messages(spark, *bodies):
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    return spark.createDataFrame([(t,) for t in texts], "payload string")


BEAT = {"timestamp": "2000", "service": "svc", "host": "localhost", "agent": "a1"}
ALERT = {
    "timestamp": "2014-01-01T00:00:00Z", "service": "svc", "host": "h", "severity": "anomaly",
    "description": "d", "data": {"x": None, "n": {"y": 1}}, "junk": 3,
}


def test_heartbeat_with_a_bare_year(spark):
    row = events.parse_heartbeats(_messages(spark, BEAT)).first()
    assert (row["ts"].year, row["agent"], row["error"]) == (2000, "a1", None)


@pytest.mark.parametrize("body", ["[]", "{}", "nonsense", '{"timestamp": "2000"}'])
def test_what_is_no_heartbeat(spark, body):
    assert events.parse_heartbeats(_messages(spark, body)).first()["error"] == "missing field"


def test_bad_timestamp(spark):
    row = events.parse_alerts(_messages(spark, {**ALERT, "timestamp": "hey"})).first()
    assert row["error"] == "bad timestamp"


def test_alert_ignores_unknown_fields_and_normalises_severity(spark):
    row = events.parse_alerts(_messages(spark, ALERT)).first()
    assert (row["severity"], row["error"]) == ("ANOMALY", None)
    wire = {**ALERT, "severity": "service-failure"}
    assert events.parse_alerts(_messages(spark, wire)).first()["severity"] == "SERVICE_FAILURE"
    wire = {**ALERT, "severity": "whatever"}
    assert events.parse_alerts(_messages(spark, wire)).first()["error"] == "unknown severity"


def test_alert_log_context(spark):
    alert = {**ALERT, "data": {"x": None, "n": {"y": 1}, "host": "other"}}
    row = events.alert_log_context(events.good(events.parse_alerts(_messages(spark, alert)))).first()
    context = row["context"]
    assert context["x"] == "null"
    assert context["n"] == '{"y":1}'
    assert (context["host"], context["severity"]) == ("h", "anomaly")
    assert context["timestamp"] == "2014-01-01T00:00:00Z"


def test_a_mail_keeps_entries_without_a_value(spark):
    alert = events.good(events.parse_alerts(_messages(spark, ALERT)))
    assert "x: null" in events.alert_mails(alert).first()["body"].split("\n")


def test_a_status_without_tags_has_its_other_dims(spark):
    body = {**BEAT, "track": ["t"], "value": "ok", "message": "m"}
    dims = events.status_metrics(events.good(events.parse_statuses(_messages(spark, body)))).first()["dims"]
    assert dims["track_0"] == ["t"] and dims["status_value"] == ["ok"]


def test_bad_messages_are_kept(spark):
    late = json.dumps({**BEAT, "timestamp": "hey"})
    df = feeds.decode(_messages(spark, "nonsense", late, json.dumps([BEAT, BEAT])), "heartbeats")
    bad = {r["message"]: r["description"] for r in events.isolate_failures(df, "heartbeats").collect()}
    assert bad == {"nonsense": "Failed to decode events from heartbeats", late: "Failed to process event from heartbeats"}
    assert sorted(r["position"] for r in events.good(df).collect()) == [0, 1]


def test_a_track_filter_goes_below_the_newest_status(spark):
    df = spark.range(5).selectExpr("array(cast(id as string)) as track", "timestamp'2024-01-01' as ts", "id as arrival", "'v' as value")
    plan = status.status_by_track(status.latest_status(df), ["3"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Aggregate") < text.index("Filter") and plan.count() == 1


def test_status_tags_become_text(spark):
    body = {**BEAT, "track": ["t", "u"], "tags": {"x": 1, "y": 2}, "value": "ok", "message": "m"}
    good = events.good(events.parse_statuses(_messages(spark, body)))
    row = good.first()
    assert row["tags"] == {"x": "1", "y": "2"}
    dims = events.status_metrics(good).first()["dims"]
    assert dims["tags_x"] == ["1"] and dims["track_1"] == ["u"] and dims["message"] == ["m"]
    assert events.status_metrics(good, compat=True).first()["dims"]["message"] == ["a1"]


def test_pager_forms(spark):
    data = {"type": "trigger", "incidentKey": "i", "serviceKey": "k", "description": "d", "details": {"a": {"x": 1}, "b": "yyy"}}
    trigger = {"timestamp": "2000", "service": "s", "host": "h", "page": True, "data": data}
    resolve = {**trigger, "data": {"type": "resolve", "incidentKey": "i", "serviceKey": "k"}}
    odd = {**trigger, "data": {**data, "type": "shrug"}}
    rows = events.parse_pagers(_messages(spark, trigger, resolve, odd)).collect()
    assert json.loads(rows[0]["details"]) == {"a": {"x": 1}, "b": "yyy"}
    assert (rows[1]["type"], rows[1]["description"], rows[1]["error"]) == ("resolve", None, None)
    assert rows[2]["error"] == "unknown type"


def test_decode_splits_arrays_and_keeps_bad_messages(spark):
    batch = _messages(spark, f"[{json.dumps(BEAT)}, {json.dumps(BEAT)}]", BEAT, "{cut", "[]")
    out = feeds.decode(batch, "heartbeats")
    assert out.filter(F.col("error").isNull()).count() == 3
    bad = events.isolate_failures(out, "heartbeats")
    assert bad.count() == 1


def test_alert_body_and_subject(spark):
    good = events.good(events.parse_alerts(_messages(spark, {**ALERT, "data": {"b": 1, "a": "z"}})))
    row = events.alert_mails(good).first()
    assert row["subject"] == "[ANOMALY] svc: d"
    assert row["body"].split("\n") == ["timestamp: 2014-01-01T00:00:00.000Z", "host: h", "a: z", "b: 1"]


def _statuses(spark, rows):
    schema = "track array<string>, ts timestamp, arrival bigint, tags map<string,string>"
    stamp = "2024-01-01T00:00:{:02d}"
    from tidewarden.functions.times import utc

    return spark.createDataFrame(
        [(t.split("/"), utc(stamp.format(s)), a, {"k": str(a)}) for t, s, a in rows], schema
    )


def test_latest_status_keeps_the_first_of_equal_times(spark):
    df = _statuses(spark, [("a/b", 5, 1), ("a/b", 5, 2), ("a/b", 3, 3), ("c", 1, 4)])
    assert sorted(r["arrival"] for r in status.latest_status(df).collect()) == [1, 4]


def test_history_keeps_ties_at_the_cut(spark):
    df = _statuses(spark, [("a", 5, 1), ("a", 4, 2), ("a", 4, 3), ("a", 3, 4), ("b", 1, 5)])
    assert sorted(r["arrival"] for r in status.status_history(df, 2).collect()) == [1, 2, 3, 5]


def test_upsert_ignores_older_events(spark):
    current = _statuses(spark, [("a", 5, 1)])
    late = _statuses(spark, [("a", 4, 2)])
    assert [r["arrival"] for r in status.upsert(current, late).collect()] == [1]
    assert status.append_history(current, late, 5).count() == 2


def test_status_lookups(spark):
    df = _statuses(spark, [("a/b/c", 1, 1), ("a/x", 2, 2), ("b/a", 3, 3), ("a/c/b", 4, 4)])
    assert sorted(r["arrival"] for r in status.status_by_track(df, ["a", "c"]).collect()) == [1, 4]
    assert [r["arrival"] for r in status.status_by_tag(df, "k", "2").collect()] == [2]
    assert [r["path"] for r in status.all_tracks(df).collect()] == ["a/b/c", "a/c/b", "a/x", "b/a"]
    assert status.status_by_tag(df, "k' OR '1'='1", "2").count() == 0


def test_outboxes(spark):
    actions = spark.createDataFrame(
        [("k", "i", "trigger", "d", '{"a":1}', 500), ("k", "i", "resolve", None, None, 202)],
        "pager_key string, incident_key string, action string, description string, details string, post_status int",
    )
    posted = outbox.pager_outbox(actions)
    payloads = [json.loads(r["payload"]) for r in posted.collect()]
    assert payloads[0]["event_type"] == "trigger"
    assert payloads[1] == {"service_key": "k", "incident_key": "i", "event_type": "resolve"}
    mails = outbox.pager_mails(posted, "ops").collect()
    assert [m["subject"] for m in mails] == ["[SERVICE_FAILURE] ops: Failed to post PagerDuty event"]
    quiet = outbox.pager_outbox(actions, quiet=True)
    assert {r["route"] for r in quiet.collect()} == {"withheld"}
    assert outbox.pager_mails(quiet, "ops").count() == 0
    mailed = outbox.pager_mails(outbox.pager_outbox(actions, mail_only=True), "ops")
    assert {r["subject"] for r in mailed.collect()} == {"[DEFAULT] ops: PagerDuty event"}


def test_sinks_write_partitioned(spark, tmp_path):
    good = events.good(events.parse_heartbeats(_messages(spark, BEAT)))
    outbox.write_metrics(events.heartbeat_metrics(good), str(tmp_path / "m"), 0)
    outbox.write_events(good, "heartbeats", str(tmp_path / "e"), 0)
    assert spark.read.parquet(str(tmp_path / "m")).first()["day"].isoformat() == "2000-01-01"
    row = spark.read.parquet(str(tmp_path / "e")).first()
    assert json.loads(row["payload"])["feed"] == row["feed"] == "heartbeats"
    back = events.parse_heartbeats(spark.createDataFrame([(row["payload"],)], "payload string")).first()
    assert (back["ts"].year, back["agent"]) == (2000, "a1")
