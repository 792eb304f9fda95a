"""Queries from incidents to the pages that are sent, and over settings and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.times import shift
from ..operators import checks, configs, freshness, incidents, mail_feed, pages, silence, status, topology
from ..session import table
from ..sinks import outbox
from . import views
from .ordered_queries import _ORDER, _SILENCE_MS, _STALE_SQL, _period_sql, _state, greedy_sql
from .probe_queries import _FAILED_SQL, _LATE_SQL, _mails
from .registry import query
from .views import CHANGE_SQL, E_SQL, HB_SQL, HOUR_US, NOW_US, START_US, us

_ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def _payload(actions: DataFrame, *columns: str | Column) -> DataFrame:
    return outbox.pager_outbox(actions).select(*columns, "action", "payload")


def _payload_sql(key: str, description: str, details: dict[str, str], action: str = "action") -> str:
    """JSON of a page as text; the values of `details` are SQL for strings."""
    inner = " || ',' || ".join(f"'\"{k}\":\"' || {v} || '\"'" for k, v in details.items())
    return (
        f"'{{\"service_key\":\"pk\",\"incident_key\":\"' || {key} || '\",\"event_type\":\"' || {action} || '\"' || "
        f"CASE WHEN {action} = 'trigger' THEN ',\"description\":\"' || {description} || '\",\"details\":{{' || {inner} || '}}}}' "
        "ELSE '}' END AS payload"
    )


# ---- pages -----------------------------------------------------------------------------------


@query(
    "stale_data_pages",
    f"WITH RECURSIVE {_STALE_SQL}, {greedy_sql('r', str(6 * HOUR_US))}, "
    "u AS (SELECT k, t, true AS bad FROM fired UNION ALL SELECT k, t, false FROM p WHERE NOT stale), "
    "v AS (SELECT *, lag(bad) OVER (PARTITION BY k ORDER BY t) AS was FROM u), "
    "w AS (SELECT v.k AS k, v.t AS t, CASE WHEN bad THEN 'trigger' ELSE 'resolve' END AS action, floor(e.value) AS minutes "
    "FROM v JOIN e ON e.user_id = v.k AND e.t = v.t WHERE (bad OR was) AND v.k % 7 <> 0) "
    "SELECT k AS user_id, t AS ts_us, action, "
    + _payload_sql(
        "'druid/staleData/env' || (k % 3) || '/ds' || k",
        "'Stale data: ds' || k",
        {"maxtime lag": "printf('%.2f H', minutes / 60)", "threshold": _period_sql("1800000 + (k % 4) * 600000")},
    )
    + " FROM w",
)
def stale_data_pages(spark, sf):
    probes = views.events(spark, sf).select(
        "user_id",
        F.concat(F.lit("env"), (F.col("user_id") % 3).cast("string")).alias("env"),
        F.concat(F.lit("ds"), F.col("user_id").cast("string")).alias("datasource"),
        "ts",
        "event_id",
        shift("ts", -F.floor("value") * 60_000).alias("max_time"),
        (1_800_000 + (F.col("user_id") % 4) * 600_000).alias("threshold_ms"),
        F.when(F.col("user_id") % 7 != 0, "pk").alias("pager_key"),
    )
    actions = freshness.stale_data_pager(probes, ["user_id"], _ORDER, 6 * HOUR_US // 1000)
    return _payload(pages.stale_data(actions.filter(F.col("action") != "alert")), "user_id", us().alias("ts_us"))


@query(
    "backlog_pages",
    f"WITH RECURSIVE {_LATE_SQL}, {greedy_sql('r', str(2 * HOUR_US))}, "
    "a AS (SELECT CAST(split_part(k, '/', 1) AS BIGINT) AS user_id, t, 'trigger' AS action FROM fired UNION ALL "
    "SELECT user_id, t, 'resolve' FROM st2 WHERE NOT late AND was), "
    "w AS (SELECT a.*, q.p, q.m FROM a JOIN q USING (user_id, t)) "
    "SELECT user_id, t AS ts_us, action, "
    + _payload_sql(
        "'pipes/backlogged/main/p' || user_id",
        "'Pipe backlogged: p' || user_id",
        {
            "controlService": "'ctl'",
            "alertPeriod": _period_sql("p"),
            "minTime": _ISO.format("m"),
            "backlog": "printf('%.2f H', (t - m) / 3600000000)",
            "channel": "CASE WHEN user_id % 2 = 1 THEN 'fast' ELSE 'null' END",
        },
    )
    + " FROM w",
)
def backlog_pages(spark, sf):
    rows = views.events(spark, sf).select(
        "user_id",
        F.lit("main").alias("env"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("pipe_id"),
        F.when(F.col("user_id") % 2 == 1, "fast").alias("channel"),
        F.lit("ctl").alias("control"),
        "ts",
        "event_id",
        ((F.col("user_id") % 3) * 1_800_000).alias("period_ms"),
        shift("ts", -F.floor("value") * 60_000).alias("min_time"),
        F.lit("pk").alias("pager_key"),
    )
    actions = incidents.backlog_pager(rows, ["user_id"], _ORDER, 2 * HOUR_US)
    return _payload(pages.backlog(actions), "user_id", us().alias("ts_us"))


@query(
    "failed_job_pages",
    f"WITH RECURSIVE {_FAILED_SQL}, w AS (SELECT split_part(k, '/', 1) AS env, split_part(k, '/', 2) AS job, t, 'trigger' AS action "
    "FROM fired UNION ALL SELECT env, job, t, 'resolve' FROM ends JOIN pn USING (env, seq)) SELECT env, job, t AS ts_us, action, "
    + _payload_sql(
        "'pipes/failed/' || env || '/' || job",
        "'Pipe failed: ' || job",
        {"log": "CASE WHEN job = 'job1' THEN 'No log found for the job' ELSE 'log of ' || job || ' at ' || t END"},
    )
    + " FROM w",
)
def failed_job_pages(spark, sf):
    """The page carries the log of the sighting that fired."""
    rows = views.events(spark, sf).select(
        F.col("event_type").alias("env"),
        F.date_trunc("hour", "ts").alias("ts"),
        F.concat(F.lit("job"), (F.col("user_id") % 4).cast("string")).alias("job"),
        ((F.col("user_id") % 4) * 3_600_000).alias("throttle_ms"),
        "value",
    )
    log = F.format_string("log of %s at %d", "job", us())
    failed = rows.filter(F.col("value") > 20).select(
        "env", "job", "ts", "throttle_ms", F.lit("pk").alias("pager_key"), F.when(F.col("job") != "job1", log).alias("log")
    )
    actions = incidents.failed_job_pager(rows.select("env", "ts"), failed.distinct())
    return _payload(pages.failed_job(actions), "env", "job", us().alias("ts_us"))


@query(
    "agent_down_pages",
    f"WITH {HB_SQL}, s AS (SELECT agent, t, arrival FROM v_hb SEMI JOIN v_expected USING (agent) UNION ALL "
    f"SELECT agent, {START_US}, -1 FROM v_expected), n AS (SELECT *, lead(t) OVER (PARTITION BY agent ORDER BY t, arrival) AS nt FROM s), "
    f"d AS (SELECT * FROM n WHERE coalesce(nt, {NOW_US}) // 1000 - t // 1000 > {_SILENCE_MS}), "
    f"w AS (SELECT agent, 'trigger' AS action, t + {_SILENCE_MS}000 AS at_us, t AS seen FROM d UNION ALL "
    "SELECT agent, 'resolve', nt, t FROM d WHERE nt IS NOT NULL) SELECT agent, at_us, action, "
    + _payload_sql(
        "'agent/down/' || agent",
        "'Agent [' || agent || '] is down'",
        {
            "last heartbeat time": _ISO.format("seen"),
            "current time": _ISO.format("at_us"),
            "delay (sec)": "format('{:,}', (at_us // 1000 - seen // 1000) // 1000)",
            "max delay (sec)": f"format('{{:,}}', {_SILENCE_MS // 1000})",
        },
    )
    + " FROM w",
)
def agent_down_pages(spark, sf):
    moments = silence.silence(
        views.heartbeats(spark, sf), views.expected_agents(spark), views.start(), _SILENCE_MS, views.now()
    )
    actions = pages.agent_down(moments.withColumn("pager_key", F.lit("pk")), _SILENCE_MS)
    return _payload(actions, "agent", us("at").alias("at_us"))


@query(
    "unexpected_agent_pages",
    f"WITH {HB_SQL}, s AS (SELECT *, lag(t) OVER (PARTITION BY agent ORDER BY t, arrival) AS p FROM v_hb ANTI JOIN v_expected USING (agent)), "
    f"w AS (SELECT *, 'trigger' AS action FROM s WHERE p IS NULL OR p + {15 * 60_000_000} <= t) SELECT arrival, action, "
    + _payload_sql(
        "'agent/unexpected/' || agent",
        "'Unexpected heartbeat from agent <' || agent || '>'",
        {
            "heartbeatTimestamp": _ISO.format("t"),
            "heartbeatService": "service",
            "heartbeatHost": "host",
            "heartbeatAgent": "agent",
        },
    )
    + " FROM w",
)
def unexpected_agent_pages(spark, sf):
    found = silence.unexpected_agents(views.heartbeats(spark, sf), views.expected_agents(spark))
    return _payload(pages.unexpected_agent(found.withColumn("pager_key", F.lit("pk"))), "arrival")


@query(
    "broker_pages",
    f"WITH {CHANGE_SQL}, a AS (SELECT CAST(count(*) FILTER (off) AS DOUBLE) AS o, count(*) FILTER (ur) / count(*) * 100 AS p, "
    f"CAST(count(*) FILTER (ur_since < {NOW_US - 12 * HOUR_US}) AS DOUBLE) AS l FROM v_present), "
    "c AS (SELECT 'offlinePartitions' AS k, 'Offline partitions' AS d, o AS v, 0.0::DOUBLE AS x FROM a UNION ALL "
    "SELECT 'underReplicated', 'Under-replicated partitions', p, 5.0 FROM a UNION ALL "
    "SELECT 'underReplicatedForPeriod', 'Under-replicated partitions for period of time', l, 0.0 FROM a), "
    "w AS (SELECT *, 'trigger' AS action FROM c WHERE v > x) SELECT 'kafka/main/broker/' || k AS incident_key, action, "
    + _payload_sql(
        "'kafka/main/broker/' || k",
        "d || ': kafka/main/broker'",
        {"value": "printf('%.2f', v)", "threshold": "printf('%.2f', x)"},
    )
    + " FROM w",
)
def broker_pages(spark, sf):
    found = topology.cluster_conditions(
        _state(spark, sf), "main", views.now(), pct=5.0, period_ms=12 * HOUR_US // 1000, offline=True
    )
    rows = found.withColumn("pager_key", F.lit("pk"))
    return _payload(pages.cluster(incidents.every_failing(rows, ["incident_key"], ["ts"])), "incident_key")


# ---- settings --------------------------------------------------------------------------------


def _settings(spark, sf, doc: Column) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("env"), doc.alias("payload")
    )


def _n(divisor: int) -> Column:
    return F.col("s_suppkey") % divisor


@query(
    "cluster_settings",
    "SELECT 'e' || s_suppkey AS env, CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 9 AS INTEGER) END AS brokers_count, "
    "CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 1 END AS broker_start_id, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 4 AS DOUBLE) END AS pct, "
    "CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 3 * 3600000 AS BIGINT) END AS under_replicated_ms, s_suppkey % 5 = 1 AS offline, "
    "CASE WHEN s_suppkey % 9 = 0 THEN 'brokersCount' END AS error FROM supplier",
)
def cluster_settings(spark, sf):
    alert = F.concat_ws(
        ", ",
        F.when(_n(4) != 0, F.format_string('"UnderReplicatedPartitionsPercentage": %d', _n(4))),
        F.when(_n(3) != 0, F.format_string('"UnderReplicatedPeriod": "PT%dH"', _n(3))),
        F.when(_n(5) < 2, F.concat(F.lit('"OfflinePartitions": '), (_n(5) == 1).cast("string"))),
    )
    doc = F.concat_ws(
        ", ",
        F.when(_n(9) != 0, F.format_string('"brokersCount": %d', _n(9))),
        F.when(_n(2) == 0, F.lit('"brokerStartId": 5')),
        F.concat(F.lit('"alert": {'), alert, F.lit("}")),
    )
    found = configs.cluster_settings(_settings(spark, sf, F.concat(F.lit("{"), doc, F.lit("}"))))
    return found.select("env", "brokers_count", "broker_start_id", "pct", "under_replicated_ms", "offline", "error")


@query(
    "job_settings",
    "SELECT 'e' || s_suppkey AS env, CASE WHEN s_suppkey % 7 <> 0 THEN 'g' || (s_suppkey % 7) END AS guardian_service, "
    "CAST(s_suppkey % 50 * 60000 AS BIGINT) AS alert_ms, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 60 * 1000 AS BIGINT) END AS pager_ms, "
    "CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 3 = 0 THEN 'missing or bad field' END AS error FROM supplier",
)
def job_settings(spark, sf):
    guardian = F.when(_n(7) != 0, F.format_string('"guardianService": "g%d", ', _n(7))).otherwise("")
    pager = F.when(_n(3) != 0, F.format_string("PT%dS", _n(60))).otherwise("soon")
    doc = F.concat(F.lit("{"), guardian, F.format_string('"alertThreshold": "PT%dM", "pagerThreshold": "%s"}', _n(50), pager))
    return configs.job_settings(_settings(spark, sf, doc)).select("env", "guardian_service", "alert_ms", "pager_ms", "error")


@query(
    "pipe_settings",
    "SELECT 'e' || s_suppkey AS env, 'c' || s_suppkey AS control, "
    "CAST(CASE s_suppkey % 3 WHEN 0 THEN 345600000 WHEN 1 THEN s_suppkey * 3600000 END AS BIGINT) AS default_delay_ms, "
    "CAST(21600000 AS BIGINT) AS default_throttle_ms, CAST(s_suppkey % 20 * 86400000 AS BIGINT) AS a_ms, CAST(0 AS BIGINT) AS b_ms, "
    "CASE WHEN s_suppkey % 3 = 2 THEN 'bad period' END AS error FROM supplier",
)
def pipe_settings(spark, sf):
    delay = F.when(_n(3) == 1, F.format_string('"defaultDelayPagerPeriod": "PT%dH", ', F.col("s_suppkey")))
    delay = F.coalesce(delay.when(_n(3) == 2, '"defaultDelayPagerPeriod": "P1M", '), F.lit(""))
    rest = F.format_string('"control": "c%d", "delayPagers": {"a": "P%dD", "b": "PT0S"}}', F.col("s_suppkey"), _n(20))
    found = configs.pipe_settings(_settings(spark, sf, F.concat(F.lit("{"), delay, rest)))
    return found.select(
        "env", "control", "default_delay_ms", "default_throttle_ms",
        F.col("delay_ms.a").alias("a_ms"), F.col("delay_ms.b").alias("b_ms"), "error",
    )


@query(
    "manager_settings",
    "SELECT 'e' || s_suppkey AS env, CASE WHEN s_suppkey % 6 <> 0 THEN '/m' || (s_suppkey % 6) END AS path, "
    "CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 30 END AS INTEGER) AS retries, 60001 AS timeout, "
    "CASE WHEN s_suppkey % 6 = 0 THEN 'zkMasterPath' END AS error FROM supplier",
)
def manager_settings(spark, sf):
    doc = F.concat_ws(
        ", ",
        F.when(_n(6) != 0, F.format_string('"zkMasterPath": "/m%d"', _n(6))),
        F.when(_n(2) == 0, F.format_string('"zkMaxRetries": %d', F.col("s_suppkey"))),
    )
    found = configs.manager_settings(_settings(spark, sf, F.concat(F.lit("{"), doc, F.lit("}"))))
    return found.select(
        "env", F.col("zkMasterPath").alias("path"), F.col("zkMaxRetries").alias("retries"), F.col("zkSessionTimeout").alias("timeout"), "error"
    )


# ---- texts, checks, history ------------------------------------------------------------------


@query(
    "delay_texts",
    f"WITH {E_SQL} SELECT event_id, printf('%.2f H', CAST(floor(value) AS BIGINT) / 60) AS hours, "
    f"'message delta: ' || format('{{:,}}', event_id * 1000) || ', time delta: ' || format('{{:,}}', CAST(floor(value) AS BIGINT) * 60000) || ' ms' AS delta, "
    "event_type || '/u' || user_id AS path, 'u' || user_id AS last_part FROM e",
)
def delay_texts(spark, sf):
    delay = F.floor("value") * 60_000
    track = F.array(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    rows = views.events(spark, sf).select(
        "event_id",
        text.hours_text(delay).alias("hours"),
        text.delta_text(F.col("event_id") * 1000, delay).alias("delta"),
        text.track_text(track).alias("path"),
    )
    return rows.withColumn("last_part", F.element_at(text.track_array("path"), -1))


@query("default_check", "SELECT event_id, 'default' AS name, true AS ok FROM events UNION ALL SELECT event_id, 'base', true FROM events")
def default_check(spark, sf):
    """The check that is used when a definition has none."""
    inputs = views.events(spark, sf).select("event_id", F.lit("base").alias("base"), F.col("props").alias("payload"))
    return checks.run_checks(inputs).select("event_id", "name", "ok")


@query(
    "append_history",
    f"WITH {E_SQL}, s AS (SELECT event_type || '/u' || (user_id % 20) AS path, t - t % {HOUR_US} AS ts_us, event_id FROM e) "
    "SELECT path, ts_us, event_id AS arrival FROM s QUALIFY rank() OVER (PARTITION BY path ORDER BY ts_us DESC) <= 10",
)
def append_history(spark, sf):
    """Two batches one after the other leave what one history over all events holds."""
    rows = views.statuses(spark, sf)
    first = status.status_history(rows.filter(F.col("arrival") % 3 != 0))
    found = status.append_history(first, rows.filter(F.col("arrival") % 3 == 0))
    return found.select(F.array_join("track", "/").alias("path"), us().alias("ts_us"), "arrival")


@query(
    "mail_predicate",
    f"WITH {E_SQL}, m AS (SELECT user_id % 4 AS inbox, user_id % 5 = 2 AS hit, t FROM e), "
    f"c AS (SELECT inbox, count(*) FILTER (hit AND t > {NOW_US - 48 * HOUR_US}) AS recent, count(*) AS total FROM m GROUP BY 1) "
    "SELECT i AS inbox, CASE WHEN i % 2 = 0 THEN 200 ELSE 500 END AS status_code, coalesce(recent, 0) AS recent_mails, "
    "coalesce(total, 0) AS total_mails, i % 2 = 0 AND coalesce(recent, 0) > 0 AS ok FROM range(6) r(i) LEFT JOIN c ON c.inbox = r.i",
)
def mail_predicate(spark, sf):
    """Responses of mail feeds, one inbox empty: ok if the answer was 200 and a matching mail is recent."""
    inboxes = table(spark, sf, "nation").filter("n_nationkey < 6").select(
        F.col("n_nationkey").cast("long").alias("inbox"),
        F.when(F.col("n_nationkey") % 2 == 0, 200).otherwise(500).alias("status_code"),
    )
    found = mail_feed.mail_predicate(
        inboxes, _mails(spark, sf), ["inbox"], views.now(), "u2@example.com", threshold_ms=48 * HOUR_US // 1000
    )
    return found.select("inbox", "status_code", "recent_mails", "total_mails", "ok")
