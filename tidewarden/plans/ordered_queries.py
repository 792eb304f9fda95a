"""Queries over lag, checks, throttles, silence, freshness and topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.times import at, shift
from ..operators import checks as ck
from ..operators import freshness, incidents, lag, silence, throttle, topology
from ..operators.segments import find_cuts
from ..session import table
from . import views
from .registry import query
from .views import CHANGE_SQL, CHECK_SQL, E_SQL, HB_SQL, HOUR_US, LOG_SQL, NOW_US, START_US, us

# ---- lag -------------------------------------------------------------------------------------

_CONSUMER = ["env", "consumer_group", "topic"]
_ONE = "env, consumer_group, topic, partition"

_MEASURED_SQL = LOG_SQL + """, m1 AS (
  SELECT env, grp AS consumer_group, topic, part, earliest, latest, off - 1 AS processed, off AS nxt,
    greatest(least(latest - 1, latest), earliest) AS b_at,
    greatest(least(latest - 1, off), earliest) AS c_at
  FROM v_consumer),
  v_lag AS (
  SELECT m1.env, m1.consumer_group, m1.topic, m1.part AS partition, m1.earliest, m1.latest, m1.processed,
    greatest(b_at - c_at, 0) AS messages,
    greatest(coalesce(b.t // 1000, 0) - coalesce(c.t // 1000, 0), 0) AS "time",
    nxt < earliest AS lost, nxt > latest AS ahead
  FROM m1 LEFT JOIN v_log b ON b.topic = m1.topic AND b.part = m1.part AND b.off = m1.b_at
          LEFT JOIN v_log c ON c.topic = m1.topic AND c.part = m1.part AND c.off = m1.c_at)"""


def _consumers(spark, sf, log: DataFrame) -> DataFrame:
    brokers = lag.broker_offsets(log)
    return lag.processed_offsets(views.consumer(brokers), brokers)


def _measured(spark, sf) -> DataFrame:
    log = views.log(spark, sf)
    return lag.measure_backlog(_consumers(spark, sf, log), log, _CONSUMER)


@query("broker_offsets", f"WITH {LOG_SQL} SELECT topic, part AS partition, earliest, latest FROM v_broker")
def broker_offsets(spark, sf):
    return lag.broker_offsets(views.log(spark, sf))


@query(
    "offsets_before",
    f"WITH {LOG_SQL} SELECT topic, part AS partition, coalesce(max(off) FILTER (t < {START_US + 10 * 24 * HOUR_US}) + 1, "
    'min(off)) AS "offset" FROM v_log GROUP BY 1, 2',
)
def offsets_before(spark, sf):
    return lag.offsets_before(views.log(spark, sf), at("2024-01-11T00:00:00"))


@query(
    "consumer_lag",
    f'WITH {_MEASURED_SQL} SELECT {_ONE}, messages, "time", lost, ahead FROM v_lag',
)
def consumer_lag(spark, sf):
    return _measured(spark, sf).select(*_CONSUMER, "partition", "messages", "time", "lost", "ahead")


@query(
    "lag_fallback",
    f"WITH {_MEASURED_SQL} SELECT {_ONE}, CASE WHEN topic = 'view' THEN greatest(latest - processed, 0) "
    "ELSE messages END AS messages, CASE WHEN topic = 'view' THEN 0 ELSE \"time\" END AS \"time\" FROM v_lag",
)
def lag_fallback(spark, sf):
    """Messages of one topic carry no time header: its consumers fall back to offsets."""
    log = views.log(spark, sf)
    log = log.withColumn("header", F.when(F.col("topic") == "view", "{}").otherwise(F.col("header")))
    measured = lag.measure_backlog(_consumers(spark, sf, log), log, _CONSUMER)
    out = lag.measured_or_fallback(measured, _CONSUMER)
    return out.select(*_CONSUMER, "partition", "messages", "time")


_DAY_MS = 86_400_000
_STAT_SQL = _MEASURED_SQL + f""", s1 AS (
  SELECT env, consumer_group, topic, CAST(sum(messages) AS BIGINT) AS total_messages,
    CAST(sum("time") AS BIGINT) AS total_time,
    count(*) FILTER ("time" > {_DAY_MS}) AS alert_partitions,
    count(*) FILTER ("time" > {7 * _DAY_MS}) AS pager_partitions,
    arg_max(partition, "time" * 1000 - partition) AS worst,
    arg_max(messages, "time" * 1000 - partition) AS worst_messages, max("time") AS worst_time
  FROM v_lag GROUP BY 1, 2, 3),
  v_stat AS (
  SELECT s1.*, n AS partitions,
    CAST(floor(total_messages / n + 0.5) AS BIGINT) AS avg_messages,
    CAST(floor(total_time / n + 0.5) AS BIGINT) AS avg_time,
    CASE WHEN worst_time > 0 THEN worst ELSE -1 END AS max_partition,
    CASE WHEN worst_time > 0 THEN worst_messages ELSE 0 END AS max_messages,
    CASE WHEN worst_time > 0 THEN worst_time ELSE 0 END AS max_time
  FROM s1 JOIN (SELECT topic, count(*) AS n FROM v_broker GROUP BY 1) USING (topic))"""
_STAT_COLUMNS = (
    "env, consumer_group, topic, partitions, total_messages, total_time, avg_messages, avg_time, "
    "alert_partitions, pager_partitions, max_partition, max_messages, max_time"
)


def _stats(spark, sf) -> DataFrame:
    log = views.log(spark, sf)
    brokers = lag.broker_offsets(log)
    deltas = _measured(spark, sf).withColumns(
        {"alert_ms": F.lit(_DAY_MS).cast("long"), "pager_ms": F.lit(7 * _DAY_MS).cast("long")}
    )
    counts = brokers.groupBy("topic").agg(F.count(F.lit(1)).alias("partitions"))
    return lag.topic_stat(deltas, _CONSUMER, counts)


@query("topic_stat", f"WITH {_STAT_SQL} SELECT {_STAT_COLUMNS} FROM v_stat")
def topic_stat(spark, sf):
    return _stats(spark, sf).drop("alert_ms", "pager_ms")


@query("distinct_topics", "SELECT DISTINCT event_type AS topic FROM events")
def distinct_topics(spark, sf):
    return lag.distinct_topics(views.log(spark, sf))


@query(
    "offset_metadata",
    f"WITH {LOG_SQL}, c AS (SELECT DISTINCT event_type AS topic, CAST(user_id % 11 AS INTEGER) AS part FROM e) "
    "SELECT c.topic, c.part AS partition, b.latest, CASE WHEN b.topic IS NULL THEN 'Couldn''t fetch metadata for [' || c.topic || ',' || c.part || ']' END AS error "
    "FROM c LEFT JOIN v_broker b ON b.topic = c.topic AND b.part = c.part",
)
def offset_metadata(spark, sf):
    """Partitions 8 to 10 are unknown to the brokers."""
    stored = views.events(spark, sf).select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 11).cast("int").alias("partition")
    ).distinct()
    out = lag.with_metadata(stored, lag.broker_offsets(views.log(spark, sf)))
    return out.select("topic", "partition", "latest", "error")


_PROBE_SQL = E_SQL + f""", d AS (
  SELECT event_type AS topic, t - t % {6 * HOUR_US} AS t, CAST(user_id % 8 AS INTEGER) AS partition, CAST(floor(sum(value) * 1000) AS BIGINT) AS ms
  FROM e GROUP BY 1, 2, 3),
  p AS (SELECT topic, t, count(*) FILTER (ms > 150000) > 0 AS alert, count(*) FILTER (ms > 300000) > 0 AS failing FROM d GROUP BY 1, 2),
  q AS (SELECT *, lag(failing) OVER (PARTITION BY topic ORDER BY t) AS was FROM p)"""


@query(
    "lag_incidents",
    f"WITH {_PROBE_SQL} SELECT 'kafka/consumer/main/cg/' || topic AS incident_key, t AS ts_us, alert, "
    "CASE WHEN failing THEN 'trigger' ELSE 'resolve' END AS action FROM q WHERE failing OR was",
)
def lag_incidents(spark, sf):
    """Four probes a day; a partition lags by the sum of its values in seconds."""
    keys = ["env", "consumer_group", "topic", "ts"]
    deltas = (
        views.events(spark, sf)
        .groupBy(
            F.lit("main").alias("env"),
            F.lit("cg").alias("consumer_group"),
            F.col("event_type").alias("topic"),
            F.timestamp_micros(us() - us() % (6 * HOUR_US)).alias("ts"),
            (F.col("user_id") % 8).cast("int").alias("partition"),
        )
        .agg(F.floor(F.sum("value") * 1000).alias("time"), F.count(F.lit(1)).alias("messages"))
        .withColumns({"alert_ms": F.lit(150_000), "pager_ms": F.lit(300_000)})
    )
    found = lag.lag_conditions(lag.topic_stat(deltas, keys).withColumn("pager_key", F.lit("pk")))
    out = incidents.every_failing(found, ["incident_key"], ["ts"])
    return out.select("incident_key", us().alias("ts_us"), "alert", "action")


def _period_sql(ms: str) -> str:
    s = f"(({ms}) // 1000)"
    return (
        f"({s} // 86400) || 'd ' || ({s} % 86400 // 3600) || 'h ' || ({s} % 3600 // 60) || 'm ' || ({s} % 60) || 's'"
    )


@query(
    "lag_alerts",
    f"WITH {_STAT_SQL} SELECT 'kafka/consumer/' || env || '/' || consumer_group || '/' || topic AS incident_key, "
    "alert_partitions > 0 AS alert, pager_partitions > 0 AS failing, "
    "pager_partitions > 0 AND env = 'env1' AS no_key_alert, "
    "CASE WHEN alert_partitions > 0 THEN max_partition END AS lag_partition, "
    "CASE WHEN alert_partitions > 0 THEN format('{:,}', total_messages) || ' msg' END AS total_delta, "
    f"CASE WHEN alert_partitions > 0 THEN {_period_sql('avg_time')} END AS avg_time, "
    f"CASE WHEN alert_partitions > 0 THEN {_period_sql('max_time')} END AS delta FROM v_stat",
)
def lag_alerts(spark, sf):
    stats = _stats(spark, sf).withColumn("pager_key", F.when(F.col("env") == "env0", "pk"))
    found = lag.lag_conditions(stats).withColumn("d", lag.lag_details("alert_partitions", "alert_ms"))
    return found.select(
        "incident_key",
        "alert",
        "failing",
        "no_key_alert",
        F.col("d.partition").alias("lag_partition"),
        F.col("d.info.messages.totalDelta").alias("total_delta"),
        F.col("d.info.time.avgDelta").alias("avg_time"),
        F.col("d.limits.delta").alias("delta"),
    )


@query(
    "lag_metrics",
    f"WITH {_MEASURED_SQL} SELECT 'consumer/offset/delta/messages' AS metric, env, topic, "
    "CAST(partition AS VARCHAR) AS partition, CAST(messages AS DOUBLE) AS value FROM v_lag UNION ALL "
    "SELECT 'consumer/offset/delta/time', env, topic, CAST(partition AS VARCHAR), CAST(\"time\" AS DOUBLE) FROM v_lag",
)
def lag_metrics(spark, sf):
    dims = {
        "kafkaEnvironment": "env",
        "kafkaConsumerGroup": "consumer_group",
        "kafkaTopic": "topic",
        "kafkaPartition": "partition",
    }
    out = lag.lag_metrics(_measured(spark, sf), dims)
    return out.select(
        "metric",
        F.col("dims.kafkaEnvironment")[0].alias("env"),
        F.col("dims.kafkaTopic")[0].alias("topic"),
        F.col("dims.kafkaPartition")[0].alias("partition"),
        "value",
    )


_CHECKPOINT_SQL = E_SQL + """, v_checkpoint AS (
  SELECT 'kafka-' || (user_id % 2) AS system, event_type AS stream, CAST(user_id % 8 AS INTEGER) AS partition,
    event_id AS log_offset, CAST(floor(value) AS BIGINT) AS off
  FROM e WHERE user_id % 8 <> 5),
  v_latest AS (
  SELECT system, stream, partition, arg_max(off, log_offset) AS off FROM v_checkpoint GROUP BY 1, 2, 3)"""


def _checkpoints(spark, sf) -> DataFrame:
    rows = views.events(spark, sf).filter(F.col("user_id") % 8 != 5)
    return lag.latest_checkpoints(
        rows.select(
            F.concat(F.lit("kafka-"), (F.col("user_id") % 2).cast("string")).alias("system"),
            F.col("event_type").alias("stream"),
            (F.col("user_id") % 8).cast("int").alias("partition"),
            F.col("event_id").alias("log_offset"),
            F.floor("value").alias("offset"),
        )
    )


@query("latest_checkpoint", f'WITH {_CHECKPOINT_SQL} SELECT system, stream, partition, off AS "offset" FROM v_latest')
def latest_checkpoint(spark, sf):
    return _checkpoints(spark, sf)


@query(
    "realtime_lag",
    f"WITH {LOG_SQL}, cp AS (SELECT event_type AS topic, CAST(user_id % 8 AS INTEGER) AS part, "
    "arg_max(CAST(floor(value) AS BIGINT), event_id) AS off FROM e WHERE user_id % 8 <> 5 GROUP BY 1, 2), "
    "j AS (SELECT b.topic, b.part, earliest, latest, coalesce(off, -1) AS processed FROM v_broker b LEFT JOIN cp USING (topic, part)), "
    "k AS (SELECT *, latest - 1 AS b_at, greatest(least(latest - 1, processed + 1), earliest) AS c_at FROM j) "
    "SELECT k.topic, k.part AS partition, processed, greatest(b_at - c_at, 0) AS messages, "
    "greatest(b.t // 1000 - c.t // 1000, 0) AS \"time\", processed + 1 < earliest AS lost, processed + 1 > latest AS ahead "
    "FROM k LEFT JOIN v_log b ON b.topic = k.topic AND b.part = k.part AND b.off = b_at "
    "LEFT JOIN v_log c ON c.topic = k.topic AND c.part = k.part AND c.off = c_at",
)
def realtime_lag(spark, sf):
    log = views.log(spark, sf)
    stored = _checkpoints(spark, sf).select(F.col("stream").alias("topic"), "partition", "offset")
    consumers = lag.checkpointed_offsets(lag.broker_offsets(log), stored, lag.PARTITION)
    out = lag.measure_backlog(consumers, log, ["topic"])
    return out.select("topic", "partition", "processed", "messages", "time", "lost", "ahead")


# ---- checks ----------------------------------------------------------------------------------

_ORDER = ["ts", "event_id"]
_STREAK_SQL = """, k1 AS (
  SELECT *, row_number() OVER w AS rn,
    CASE WHEN lag(ok) OVER w IS DISTINCT FROM ok THEN row_number() OVER w END AS s
  FROM {0} WINDOW w AS (PARTITION BY grp, name ORDER BY t, event_id)),
  k2 AS (
  SELECT *, rn - last_value(s IGNORE NULLS) OVER (PARTITION BY grp, name ORDER BY t, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS streak FROM k1),
  k3 AS (
  SELECT *, NOT ok AND streak >= fail_count AS bad, ok AND streak >= resolve_count AS good FROM k2),
  v_verdict AS (
  SELECT *, CASE WHEN bad THEN 'failed'
    WHEN good AND last_value(CASE WHEN bad THEN true WHEN good THEN false END IGNORE NULLS)
      OVER (PARTITION BY grp, name ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 'resolved' ELSE 'other' END AS verdict FROM k3)"""


@query(
    "streak_verdicts",
    f"WITH {CHECK_SQL}{_STREAK_SQL.format('v_check')} SELECT event_id, name, verdict FROM v_verdict",
)
def streak_verdicts(spark, sf):
    out = ck.streaks(views.checks(spark, sf), ["group", "name"], _ORDER)
    return out.select("event_id", "name", "verdict")


@query(
    "probe_history_text",
    f"WITH {CHECK_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY grp, name ORDER BY t, event_id) AS rn, "
    "coalesce(CAST(status_code AS VARCHAR), 'failed-fetch') AS code, greatest(fail_count, resolve_count) AS n FROM v_check) "
    "SELECT a.event_id, string_agg(b.code, ', ' ORDER BY b.rn) AS history FROM h a JOIN h b "
    "ON a.grp = b.grp AND a.name = b.name AND b.rn <= a.rn AND b.rn > a.rn - a.n GROUP BY 1",
)
def probe_history_text(spark, sf):
    return ck.history_text(views.checks(spark, sf), ["group", "name"], _ORDER).select("event_id", "history")


@query(
    "latest_values",
    f"WITH {CHECK_SQL} SELECT event_id, last_value(body IGNORE NULLS) OVER w AS last_body, "
    "last_value(error IGNORE NULLS) OVER w AS last_error FROM v_check WINDOW w AS (PARTITION BY grp, name "
    "ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def latest_values(spark, sf):
    out = ck.latest_values(views.checks(spark, sf), ["group", "name"], _ORDER)
    return out.select("event_id", "last_body", "last_error")


@query(
    "check_incidents",
    f"WITH {CHECK_SQL}{_STREAK_SQL.format('v_check')}, x AS (SELECT *, last_value(error IGNORE NULLS) OVER (PARTITION BY grp, name "
    "ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error FROM v_verdict) "
    "SELECT event_id, name AS incident_key, CASE WHEN verdict = 'failed' THEN 'trigger' ELSE 'resolve' END AS action "
    "FROM x WHERE verdict = 'resolved' OR (verdict = 'failed' AND NOT (grp = 'g1' AND last_error IS NOT NULL))",
)
def check_incidents(spark, sf):
    """Alerts and pages of failing checks; group g1 ignores failed fetches."""
    keys = ["group", "name"]
    results = views.checks(spark, sf)
    cuts = find_cuts(results, keys, _ORDER)
    rows = ck.latest_values(ck.streaks(results, keys, _ORDER, cuts), keys, _ORDER, cuts)
    rows = rows.withColumn("ignore_failed_fetch", F.col("group") == "g1")
    failed = (F.col("verdict") == "failed") & ~ck.suppressed()
    action = F.when(failed, "trigger").when(F.col("verdict") == "resolved", "resolve")
    return rows.select("event_id", F.col("name").alias("incident_key"), action.alias("action")).filter(
        F.col("action").isNotNull()
    )


@query(
    "keep_last",
    f"WITH {CHECK_SQL} SELECT event_id, name FROM v_check "
    "QUALIFY row_number() OVER (PARTITION BY grp, name ORDER BY t DESC, event_id DESC) <= 3",
)
def keep_last(spark, sf):
    return ck.keep_last(views.checks(spark, sf), ["group", "name"], _ORDER, 3).select("event_id", "name")


@query(
    "due_checks",
    f"WITH {CHECK_SQL}, r AS (SELECT grp, name, max(t) AS last_run FROM v_check WHERE CAST(name AS BIGINT) % 7 <> 0 GROUP BY 1, 2), "
    "d AS (SELECT DISTINCT grp, name, CASE WHEN CAST(name AS BIGINT) % 5 <> 0 THEN (CAST(name AS BIGINT) % 5) * 43200000 END AS p, "
    "CASE WHEN CAST(name AS BIGINT) % 11 = 0 THEN false WHEN CAST(name AS BIGINT) % 2 = 0 THEN true END AS enabled FROM v_check) "
    'SELECT d.grp AS "group", d.name FROM d LEFT JOIN r USING (grp, name) WHERE coalesce(enabled, true) '
    f"AND (p IS NULL OR last_run IS NULL OR last_run + p * 1000 < {NOW_US})",
)
def due_checks(spark, sf):
    results = views.checks(spark, sf)
    number = F.col("name").cast("bigint")
    defs = results.select("group", "name").distinct().withColumns(
        {
            "period_ms": F.when(number % 5 != 0, (number % 5) * 43_200_000),
            "enabled": F.when(number % 11 == 0, False).when(number % 2 == 0, True),
        }
    )
    runs = results.filter(number % 7 != 0).groupBy("group", "name").agg(F.max("ts").alias("last_run"))
    return ck.due(defs, runs, views.now()).select("group", "name")


@query(
    "success_range",
    f"WITH {E_SQL}, s AS (SELECT event_id, CAST(100 + event_id % 500 AS INTEGER) AS status FROM e) "
    "SELECT event_id, status // 200 = 1 AS accepted, status // 100 = 2 AS posted FROM s",
)
def success_range(spark, sf):
    rows = views.events(spark, sf).select("event_id", (100 + F.col("event_id") % 500).cast("int").alias("status"))
    return rows.select("event_id", ck.success_range("status").alias("accepted"), ck.posted("status").alias("posted"))


@query(
    "udf_predicate",
    f"WITH {CHECK_SQL} SELECT event_id, coalesce(status_code = 200 AND CAST(substr(body, 2) AS BIGINT) % 3 = 0, false) AS ok, "
    "CASE WHEN error IS NULL THEN CAST(length(body) AS VARCHAR) END AS body_length FROM v_check",
)
def udf_predicate(spark, sf):
    """A user's check as a SQL expression with data."""
    definition = {
        "type": "sql",
        "ok": "status_code = 200 and cast(substr(body, 2) as bigint) % 3 = 0",
        "data": "map('length', cast(length(body) as string))",
    }
    ok, data = ck.predicate(definition, {"sql": ck.expression_predicate})
    out = ck.apply_predicate(views.checks(spark, sf).drop("ok"), ok, data)
    return out.select("event_id", "ok", F.element_at("data", F.lit("length")).alias("body_length"))


@query(
    "default_predicate",
    f"WITH {CHECK_SQL} SELECT event_id, coalesce(status_code = 200, false) AS ok FROM v_check",
)
def default_predicate(spark, sf):
    ok, data = ck.predicate(None, {})
    return ck.apply_predicate(views.checks(spark, sf).drop("ok"), ok, data).select("event_id", "ok")


_UDTF_SQL = E_SQL + """, v_run AS (
  SELECT 'g' AS grp, 'base' || (user_id % 30) AS base, t, event_id, event_type, value, user_id,
    1 + user_id % 3 AS fail_count, 1 + user_id % 2 AS resolve_count FROM e),
  v_sub AS (
  SELECT grp, base AS name, t, event_id, event_type <> 'error' AS ok, 3 AS fail_count, 2 AS resolve_count FROM v_run
  UNION ALL
  SELECT grp, base || '/' || event_type, t, event_id, value < 50, 3, 2 FROM v_run WHERE event_type <> 'error')"""


def _scripted(payload: str) -> list[tuple[str, bool, dict]]:
    """One sub-check per payload `base|kind|value`; an error payload makes the check raise."""
    base, kind, value = payload.split("|")
    if kind == "error":
        raise ValueError("check failed")
    return [(f"{base}/{kind}", float(value) < 50, {"value": value})]


@query(
    "udtf_checks",
    f"WITH {_UDTF_SQL}{_STREAK_SQL.format('v_sub')} SELECT event_id, name, ok, verdict FROM v_verdict",
)
def udtf_checks(spark, sf):
    """Scripted checks: base rows and sub rows through the same streak rule."""
    base = F.concat(F.lit("base"), (F.col("user_id") % 30).cast("string"))
    inputs = views.events(spark, sf).select(
        F.lit("g").alias("group"),
        base.alias("base"),
        "ts",
        F.col("event_id").alias("run_id"),
        F.concat_ws("|", base, "event_type", F.col("value").cast("string")).alias("payload"),
        F.lit(3).alias("fail_count"),
        F.lit(2).alias("resolve_count"),
    )
    rows = ck.checked(inputs, _scripted)
    out = ck.streaks(rows, ["group", "name"], ["ts", "run_id"])
    return out.select(F.col("run_id").alias("event_id"), "name", "ok", "verdict")


@query(
    "ping_metrics",
    f"WITH {CHECK_SQL}, p AS (SELECT *, coalesce(CAST(status_code AS VARCHAR), 'failed-fetch') AS code FROM v_check) "
    'SELECT metric, grp AS "group", code, ok, CAST(sum(value) AS DOUBLE) AS total FROM ('
    "SELECT 'get' AS metric, grp, code, CAST(ok AS VARCHAR) AS ok, -1 AS value FROM p UNION ALL "
    "SELECT 'latency', grp, code, CAST(ok AS VARCHAR), latency_ms FROM p) u GROUP BY 1, 2, 3, 4",
)
def ping_metrics(spark, sf):
    metrics = ck.ping_metrics(views.checks(spark, sf))
    return metrics.groupBy(
        "metric",
        F.col("dims.pingGroup")[0].alias("group"),
        F.col("dims.pingStatusCode")[0].alias("code"),
        F.col("dims.pingResult")[0].alias("ok"),
    ).agg(F.sum("value").alias("total"))


@query(
    "response_view",
    f"WITH {CHECK_SQL} SELECT event_id, error IS NULL AS success, error AS reason, status_code AS status, "
    "body AS response_body FROM v_check",
)
def response_view(spark, sf):
    out = ck.response_view(views.checks(spark, sf))
    return out.select("event_id", "success", "reason", "status", "response_body")


@query(
    "failure_details",
    f"WITH {CHECK_SQL}{_STREAK_SQL.format('v_check')}, h AS (SELECT *, coalesce(CAST(status_code AS VARCHAR), 'failed-fetch') AS code, "
    "greatest(fail_count, resolve_count) AS n FROM v_verdict), "
    "hh AS (SELECT a.event_id, string_agg(b.code, ', ' ORDER BY b.rn) AS history FROM h a JOIN h b "
    "ON a.grp = b.grp AND a.name = b.name AND b.rn <= a.rn AND b.rn > a.rn - a.n GROUP BY 1), "
    "lv AS (SELECT event_id, verdict, name, last_value(body IGNORE NULLS) OVER w AS last_body, last_value(error IGNORE NULLS) OVER w AS last_error "
    "FROM v_verdict WINDOW w AS (PARTITION BY grp, name ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "SELECT event_id, 'http://user:*@' || name || '/x' AS uri, history, last_body AS body, last_error AS exception "
    "FROM lv JOIN hh USING (event_id) WHERE verdict = 'failed'",
)
def failure_details(spark, sf):
    keys = ["group", "name"]
    rows = views.checks(spark, sf).withColumns(
        {
            "uri": F.concat(F.lit("http://user:secret@"), F.col("name"), F.lit("/x")),
            "definition": F.lit("{}"),
            "data": F.create_map().cast("map<string,string>"),
        }
    )
    cuts = find_cuts(rows, keys, _ORDER)
    rows = ck.streaks(rows, keys, _ORDER, cuts)
    rows = ck.latest_values(rows, keys, _ORDER, cuts)
    rows = ck.history_text(rows, keys, _ORDER, cuts).filter(F.col("verdict") == "failed")

    def field(name):
        return F.get_json_object("details", f"$['{name}']")

    return ck.failure_details(rows).select(
        "event_id",
        field("uri").alias("uri"),
        field("status history").alias("history"),
        field("body").alias("body"),
        field("exception").alias("exception"),
    )


# ---- throttles and incidents -----------------------------------------------------------------


def greedy_sql(rows: str, gap: str, strict: bool = True, first: str | None = None) -> str:
    """CTE `fired(k, t)` over CTE `rows(k, t)`: next pointers by a range frame, then a walk."""
    reach = f"{gap} + 1" if strict else gap
    begin = first or f"SELECT k, min(t) AS t FROM {rows} GROUP BY k"
    return (
        f"nxt AS MATERIALIZED (SELECT k, t, min(t) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN {reach} FOLLOWING "
        f"AND UNBOUNDED FOLLOWING) AS nt FROM {rows}), "
        f"fired AS ({begin} UNION ALL SELECT n.k, n.nt FROM fired f JOIN nxt n ON n.k = f.k AND n.t = f.t WHERE n.nt IS NOT NULL)"
    )


def _by_user(spark, sf) -> DataFrame:
    return views.events(spark, sf).select("user_id", "ts", "event_id")


@query(
    "throttle_greedy",
    f"WITH RECURSIVE {E_SQL}, r AS (SELECT user_id AS k, t FROM e), {greedy_sql('r', str(HOUR_US))} "
    "SELECT k AS user_id, t AS ts_us FROM fired",
)
def throttle_greedy(spark, sf):
    fired = throttle.greedy_throttle(_by_user(spark, sf), ["user_id"], _ORDER, F.lit(HOUR_US))
    return fired.select("user_id", us().alias("ts_us"))


@query(
    "throttle_session",
    f"WITH {E_SQL} SELECT user_id, event_id FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e) x "
    f"WHERE p IS NULL OR p + {6 * HOUR_US} <= t",
)
def throttle_session(spark, sf):
    seen = throttle.session_throttle(_by_user(spark, sf), ["user_id"], _ORDER, 6 * HOUR_US)
    return seen.select("user_id", "event_id")


_EDGE_SQL = E_SQL + """, x AS (
  SELECT user_id, event_id, event_type = 'error' AS bad,
    coalesce(lag(event_type = 'error') OVER (PARTITION BY {0} ORDER BY t, event_id), false) AS was, {0} AS k FROM e)"""


@query(
    "edge_trigger",
    f"WITH {_EDGE_SQL.format('user_id')} SELECT user_id, event_id, CASE WHEN bad THEN 'trigger' ELSE 'resolve' END AS action "
    "FROM x WHERE bad <> was",
)
def edge_trigger(spark, sf):
    rows = views.events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    out = throttle.edge_trigger(rows, ["user_id"], _ORDER, F.col("event_type") == "error")
    return out.select("user_id", "event_id", "action")


@query(
    "probe_failure_pager",
    f"WITH {_EDGE_SQL.format('user_id % 20')} SELECT event_id, 'agent/probe-failed/job' || k AS incident_key, "
    "CASE WHEN bad THEN 'trigger' ELSE 'resolve' END AS action FROM x WHERE bad OR was",
)
def probe_failure_pager(spark, sf):
    runs = views.events(spark, sf).select(
        F.concat(F.lit("job"), (F.col("user_id") % 20).cast("string")).alias("job"),
        "ts",
        "event_id",
        (F.col("event_type") == "error").alias("failing"),
        F.lit("pk").alias("pager_key"),
    )
    out = incidents.every_failing(runs, ["job"], _ORDER)
    return out.select("event_id", incidents.incident_key("agent/probe-failed", "job").alias("incident_key"), "action")


@query(
    "guardian_unavailable",
    f"WITH {E_SQL}, g AS (SELECT user_id % 10 AS env, event_id, t, event_type = 'error' AS bad, user_id % 3 <> 0 AS has_key FROM e), "
    "h AS (SELECT *, last_value(CASE WHEN has_key THEN bad END IGNORE NULLS) OVER (PARTITION BY env ORDER BY t, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM g) "
    "SELECT event_id, CASE WHEN bad THEN 'trigger' ELSE 'resolve' END AS action FROM h WHERE has_key AND (bad OR was)",
)
def guardian_unavailable(spark, sf):
    rows = views.events(spark, sf).select(
        (F.col("user_id") % 10).alias("env"),
        "ts",
        "event_id",
        (F.col("event_type") != "error").alias("located"),
        F.when(F.col("user_id") % 3 != 0, "pk").alias("pager_key"),
    )
    return incidents.guardian_unavailable(rows, ["env"], _ORDER).select("event_id", "action")


@query(
    "pager_or_event",
    f"WITH {_EDGE_SQL.format('user_id')} SELECT event_id, event_id % 4 = 0 OR event_id % 2 = 1 AS page FROM x WHERE bad <> was",
)
def pager_or_event(spark, sf):
    """Direct pages work for event ids that are even but no multiple of four."""
    rows = views.events(spark, sf).select(
        "user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failing"), F.lit("pk").alias("pager_key")
    )
    actions = incidents.rising_edge(rows, ["user_id"], _ORDER)
    direct = (F.col("event_id") % 2 == 0) & (F.col("event_id") % 4 != 0)
    return incidents.pager_events(actions, direct).select("event_id", "page")


# ---- silence ---------------------------------------------------------------------------------

_SILENCE_MS = 5_400_000


@query(
    "silence",
    f"WITH {HB_SQL}, s AS (SELECT agent, t, arrival FROM v_hb SEMI JOIN v_expected USING (agent) UNION ALL "
    f"SELECT agent, {START_US}, -1 FROM v_expected), n AS (SELECT *, lead(t) OVER (PARTITION BY agent ORDER BY t, arrival) AS nt FROM s), "
    f"d AS (SELECT * FROM n WHERE coalesce(nt, {NOW_US}) // 1000 - t // 1000 > {_SILENCE_MS}) "
    f"SELECT agent, 'trigger' AS action, t + {_SILENCE_MS}000 AS at_us, t AS last_seen_us FROM d UNION ALL "
    "SELECT agent, 'resolve', nt, t FROM d WHERE nt IS NOT NULL",
)
def silence_query(spark, sf):
    out = silence.silence(
        views.heartbeats(spark, sf), views.expected_agents(spark), views.start(), _SILENCE_MS, views.now()
    )
    return out.select("agent", "action", us("at").alias("at_us"), us("last_seen").alias("last_seen_us"))


@query(
    "unexpected_agents",
    f"WITH {HB_SQL}, s AS (SELECT *, lag(t) OVER (PARTITION BY agent ORDER BY t, arrival) AS p FROM v_hb ANTI JOIN v_expected USING (agent)) "
    f"SELECT agent, arrival, t AS ts_us FROM s WHERE p IS NULL OR p + {15 * 60_000_000} <= t",
)
def unexpected_agents(spark, sf):
    out = silence.unexpected_agents(views.heartbeats(spark, sf), views.expected_agents(spark))
    return out.select("agent", "arrival", us().alias("ts_us"))


@query(
    "damped_heartbeats",
    f"WITH RECURSIVE {HB_SQL}, r AS (SELECT agent AS k, t FROM v_hb), "
    + greedy_sql(
        "r",
        str(HOUR_US),
        strict=False,
        first=f"SELECT k, min(t) AS t FROM r WHERE t >= {START_US + HOUR_US} GROUP BY k",
    )
    + " SELECT k AS agent, t AS ts_us FROM fired",
)
def damped_heartbeats(spark, sf):
    out = silence.damped_heartbeats(
        views.heartbeats(spark, sf), ["agent"], ["ts", "arrival"], HOUR_US // 1000, views.start()
    )
    return out.select("agent", us().alias("ts_us"))


@query(
    "stuck_jobs",
    f"WITH {E_SQL} SELECT user_id % 400 AS job, max(t) AS last_start_us FROM e GROUP BY 1 "
    f"HAVING max(t) + 3 * (1 + user_id % 400 % 4) * {HOUR_US} < {NOW_US}",
)
def stuck_jobs(spark, sf):
    job = F.col("user_id") % 400
    runs = views.events(spark, sf).select(
        job.alias("job"),
        F.col("ts").alias("started_at"),
        ((1 + job % 4) * 3_600_000).alias("period_ms"),
    )
    return silence.stuck(runs, views.now()).select("job", us("last_start").alias("last_start_us"))


# ---- freshness -------------------------------------------------------------------------------


@query(
    "load_grace",
    f"WITH {E_SQL}, l AS (SELECT *, value >= 30 AS loading FROM e), "
    "l1 AS (SELECT *, CASE WHEN lag(loading) OVER (PARTITION BY user_id ORDER BY t, event_id) IS DISTINCT FROM loading THEN t END AS s FROM l), "
    "l2 AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM l1) "
    f"SELECT user_id, event_id, st AS started_us FROM l2 WHERE loading AND st + {15 * 60_000_000} < t",
)
def load_grace(spark, sf):
    loads = views.events(spark, sf).select(
        "user_id",
        "ts",
        "event_id",
        F.when(F.col("value") < 30, 0).otherwise(F.floor("value")).alias("load"),
    )
    out = freshness.load_grace(loads, ["user_id"], _ORDER)
    return out.select("user_id", "event_id", us("started_at").alias("started_us"))


_STALE_SQL = E_SQL + """, p AS (
  SELECT user_id AS k, t, event_id,
    t - CAST(floor(value) AS BIGINT) * 60000000 < t - (1800000 + (user_id % 4) * 600000) * 1000 AS stale FROM e),
  r AS (SELECT k, t FROM p WHERE stale)"""


@query(
    "stale_data_pager",
    f"WITH RECURSIVE {_STALE_SQL}, {greedy_sql('r', str(6 * HOUR_US))}, "
    "u AS (SELECT k, t, true AS bad FROM fired UNION ALL SELECT k, t, false FROM p WHERE NOT stale), "
    "v AS (SELECT *, lag(bad) OVER (PARTITION BY k ORDER BY t) AS was FROM u) "
    "SELECT k AS user_id, t AS ts_us, CASE WHEN bad AND k % 7 = 0 THEN 'alert' WHEN bad THEN 'trigger' ELSE 'resolve' END AS action "
    "FROM v WHERE bad OR (was AND k % 7 <> 0)",
)
def stale_data_pager(spark, sf):
    probes = views.events(spark, sf).select(
        "user_id",
        "ts",
        "event_id",
        shift("ts", -F.floor("value") * 60_000).alias("max_time"),
        (1_800_000 + (F.col("user_id") % 4) * 600_000).alias("threshold_ms"),
        F.when(F.col("user_id") % 7 != 0, "pk").alias("pager_key"),
    )
    out = freshness.stale_data_pager(probes, ["user_id"], _ORDER, 6 * HOUR_US // 1000)
    return out.select("user_id", us().alias("ts_us"), "action")


@query(
    "freshness_metrics",
    f"WITH {E_SQL}, m AS (SELECT 'env' || (event_id % 3) AS env, 'ds' || user_id AS datasource, max(t) AS mt, "
    "min(event_id % 3) AS n, min(user_id) AS u FROM e GROUP BY 1, 2) "
    f"SELECT env, datasource, CAST(({NOW_US} // 1000 - mt // 1000) // 1000 AS DOUBLE) AS value, "
    f"mt < {NOW_US} - (1 + u % 3 + n) * {2 * HOUR_US} AS stale FROM m WHERE (u + n) % 5 <> 0",
)
def freshness_metrics(spark, sf):
    """Each datasource stands in several environments with a threshold of its own in each."""
    seen = views.events(spark, sf).groupBy(
        F.concat(F.lit("env"), (F.col("event_id") % 3).cast("string")).alias("env"),
        F.concat(F.lit("ds"), F.col("user_id").cast("string")).alias("datasource"),
    ).agg(F.max("ts").alias("max_time"), F.min(F.col("event_id") % 3).alias("n"), F.min("user_id").alias("u"))
    thresholds = seen.filter((F.col("u") + F.col("n")) % 5 != 0).select(
        "env", "datasource", ((1 + F.col("u") % 3 + F.col("n")) * 2 * (HOUR_US // 1000)).alias("threshold_ms")
    )
    known = freshness.with_thresholds(seen, thresholds).withColumn("broker", F.lit("b"))
    verdict = freshness.stale(F.col("max_time"), F.col("threshold_ms"), views.now())
    metrics = freshness.freshness_metrics(known, views.now())
    values = metrics.select(
        F.col("dims.druidEnvironment")[0].alias("env"), F.col("dims.druidDataSource")[0].alias("datasource"), "value"
    )
    return values.join(known.select("env", "datasource", verdict.alias("stale")), ["env", "datasource"])


# ---- topology --------------------------------------------------------------------------------


def _observed(spark, sf) -> DataFrame:
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"
    )
    return nation.filter(~F.col("n_nationkey").isin(3, 7)).select(F.col("n_nationkey").cast("long").alias("id"))


_BROKER_SQL = (
    "o AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region) "
    "AND n_nationkey NOT IN (3, 7)), x AS (SELECT i AS id FROM range(1, 28) r(i))"
)


@query("missing_brokers", f"WITH {_BROKER_SQL} SELECT id FROM x EXCEPT SELECT id FROM o")
def missing_brokers(spark, sf):
    return topology.missing(topology.expected_ids(spark, 1, 27), _observed(spark, sf))


@query("present_brokers", f"WITH {_BROKER_SQL} SELECT id FROM x INTERSECT SELECT id FROM o")
def present_brokers(spark, sf):
    return topology.present(topology.expected_ids(spark, 1, 27), _observed(spark, sf))


@query("out_of_bounds_brokers", f"WITH {_BROKER_SQL} SELECT id FROM o EXCEPT SELECT id FROM x")
def out_of_bounds_brokers(spark, sf):
    return topology.out_of_bounds(topology.expected_ids(spark, 1, 27), _observed(spark, sf))


def _history(spark, sf) -> DataFrame:
    return topology.partition_history(views.changes(spark, sf))


def _state(spark, sf) -> DataFrame:
    return topology.partition_state(_history(spark, sf))


@query(
    "partition_since",
    f"WITH {CHANGE_SQL} SELECT seq, topic, part AS partition, present, off AS offline, off_since AS offline_since_us, "
    "ur AS under_replicated, ur_since AS under_replicated_since_us FROM c4",
)
def partition_since(spark, sf):
    return _history(spark, sf).select(
        "seq",
        "topic",
        "partition",
        "present",
        "offline",
        us("offline_since").alias("offline_since_us"),
        "under_replicated",
        us("under_replicated_since").alias("under_replicated_since_us"),
    )


@query(
    "partition_counts",
    f"WITH {CHANGE_SQL} SELECT count(*) AS partitions, count(*) FILTER (off) AS offline, "
    f"count(*) FILTER (off_since < {NOW_US - 12 * HOUR_US}) AS offline_since, count(*) FILTER (ur) AS under_replicated, "
    f"count(*) FILTER (ur_since < {NOW_US - 12 * HOUR_US}) AS under_replicated_since FROM v_present",
)
def partition_counts(spark, sf):
    return topology.partition_counts(_state(spark, sf), at("2024-01-30T12:00:00"))


@query(
    "under_replicated_pct",
    f"WITH {CHANGE_SQL} SELECT topic, round(count(*) FILTER (ur) / count(*) * 100, 6) AS pct FROM v_present GROUP BY 1",
)
def under_replicated_pct(spark, sf):
    return topology.under_replicated_pct(_state(spark, sf), ["topic"]).withColumn("pct", F.round("pct", 6))


@query(
    "since_before",
    f"WITH {CHANGE_SQL} SELECT topic, part AS partition, ur_since AS since_us FROM v_present WHERE ur_since < {NOW_US - 12 * HOUR_US}",
)
def since_before(spark, sf):
    found = topology.since_before(_state(spark, sf), "under_replicated_since", at("2024-01-30T12:00:00"))
    return found.select("topic", "partition", us("under_replicated_since").alias("since_us"))


@query(
    "newest_condition",
    f"WITH {CHANGE_SQL}, a AS (SELECT topic, part AS partition, ur_since FROM v_present WHERE ur_since IS NOT NULL "
    "ORDER BY ur_since // 1000 DESC, topic, part LIMIT 1) "
    f"SELECT topic, partition, ur_since AS since_us, {_period_sql(f'{NOW_US} // 1000 - ur_since // 1000')} AS age FROM a",
)
def newest_condition(spark, sf):
    out = topology.newest_condition(_state(spark, sf), "under_replicated_since", views.now())
    return out.select("topic", "partition", us("since").alias("since_us"), "age")


@query(
    "cluster_conditions",
    f"WITH {CHANGE_SQL}, a AS (SELECT CAST(count(*) FILTER (off) AS DOUBLE) AS o, count(*) FILTER (ur) / count(*) * 100 AS p, "
    f"CAST(count(*) FILTER (ur_since < {NOW_US - 12 * HOUR_US}) AS DOUBLE) AS l FROM v_present) "
    "SELECT 'kafka/main/broker/offlinePartitions' AS incident_key, o AS value, o > 0 AS failing FROM a UNION ALL "
    "SELECT 'kafka/main/broker/underReplicated', p, p > 40 FROM a UNION ALL "
    "SELECT 'kafka/main/broker/underReplicatedForPeriod', l, l > 0 FROM a",
)
def cluster_conditions(spark, sf):
    out = topology.cluster_conditions(
        _state(spark, sf), "main", views.now(), pct=40.0, period_ms=12 * HOUR_US // 1000, offline=True
    )
    return out.select("incident_key", "value", "failing")


@query(
    "counter_increase",
    f"WITH {E_SQL}, c AS (SELECT event_type AS env, event_id, user_id % 3 AS broker, CAST(floor(value) AS BIGINT) AS reading, t FROM e), "
    "p AS (SELECT *, lag(broker) OVER w AS pb, lag(reading) OVER w AS pr FROM c WINDOW w AS (PARTITION BY env ORDER BY t, event_id)) "
    "SELECT env, event_id, reading - pr AS increase FROM p WHERE pb = broker AND reading > pr",
)
def counter_increase(spark, sf):
    readings = views.events(spark, sf).select(
        F.col("event_type").alias("env"),
        "ts",
        "event_id",
        (F.col("user_id") % 3).alias("broker"),
        F.floor("value").alias("reading"),
    )
    return topology.counter_increase(readings, ["env"], _ORDER).select("env", "event_id", "increase")


@query(
    "lag_text",
    f"WITH {E_SQL} SELECT event_id, ({NOW_US} // 1000 - t // 1000) // 1000 AS lag_seconds, "
    f"{_period_sql(f'{NOW_US} // 1000 - t // 1000')} AS lag, format('{{:,}}', CAST(floor(value) AS BIGINT)) || ' msg' AS messages, "
    "CAST(floor(value + 0.5) AS BIGINT) AS rounded FROM e",
)
def lag_text(spark, sf):
    rows = views.events(spark, sf)
    behind = ((F.unix_millis(views.now()) - F.unix_millis("ts")) / 1000).cast("long")
    return rows.select(
        "event_id",
        behind.alias("lag_seconds"),
        text.period_text(behind).alias("lag"),
        text.count_text(F.floor("value")).alias("messages"),
        text.round_half_up(F.col("value")).alias("rounded"),
    )
