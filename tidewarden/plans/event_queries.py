"""Queries over events and statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import events as ev
from ..operators import status
from ..sinks import outbox
from ..sources import feeds
from . import views
from .registry import query
from .views import ALERT_SQL, E_SQL, HB_SQL, HOUR_US, STATUS_SQL, us


def _path():
    return F.array_join("track", "/").alias("path")


def _status_out(df: DataFrame) -> DataFrame:
    return df.select(_path(), us().alias("ts_us"), "arrival", "value", "message")


_STATUS_COLUMNS = "path, ts_us, arrival, value, message"
_CURRENT_SQL = STATUS_SQL + """, v_current AS (
  SELECT * FROM v_status
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts_us DESC, arrival) = 1)"""


@query("status_latest", f"WITH {_CURRENT_SQL} SELECT {_STATUS_COLUMNS} FROM v_current")
def status_latest(spark, sf):
    return _status_out(status.latest_status(views.statuses(spark, sf)))


@query(
    "status_history_10",
    f"WITH {STATUS_SQL} SELECT {_STATUS_COLUMNS} FROM v_status "
    "QUALIFY rank() OVER (PARTITION BY path ORDER BY ts_us DESC) <= 10",
)
def status_history_10(spark, sf):
    return _status_out(status.status_history(views.statuses(spark, sf), 10))


@query("status_by_tag", f"WITH {_CURRENT_SQL} SELECT {_STATUS_COLUMNS} FROM v_current WHERE k = '42'")
def status_by_tag(spark, sf):
    return _status_out(status.status_by_tag(status.latest_status(views.statuses(spark, sf)), "k", "42"))


@query(
    "status_by_track",
    f"WITH {_CURRENT_SQL} SELECT {_STATUS_COLUMNS} FROM v_current WHERE path = 'click/u3'",
)
def status_by_track(spark, sf):
    current = status.latest_status(views.statuses(spark, sf))
    return _status_out(status.status_by_track(current, ["click", "u3"]))


@query("all_tracks", f"WITH {STATUS_SQL} SELECT DISTINCT path FROM v_status")
def all_tracks(spark, sf):
    return status.all_tracks(views.statuses(spark, sf)).select("path")


@query(
    "track_history",
    f"WITH {STATUS_SQL} SELECT {_STATUS_COLUMNS} FROM v_status WHERE path = 'view/u7' "
    "ORDER BY ts_us DESC, arrival DESC LIMIT 10",
)
def track_history(spark, sf):
    return _status_out(status.track_history(views.statuses(spark, sf), ["view", "u7"], 10))


@query(
    "one_status",
    f"WITH {_CURRENT_SQL} SELECT {_STATUS_COLUMNS} FROM v_current WHERE track_0 = 'error' "
    "ORDER BY path LIMIT 1",
)
def one_status(spark, sf):
    return _status_out(status.one_status(status.latest_status(views.statuses(spark, sf)), ["error"]))


@query(
    "status_upsert",
    f"WITH {_CURRENT_SQL} SELECT {_STATUS_COLUMNS} FROM v_current",
)
def status_upsert(spark, sf):
    """Half of the statuses as the stored state, the late other half as the batch."""
    rows = views.statuses(spark, sf)
    stored = status.latest_status(rows.filter(F.col("arrival") % 2 == 1))
    return _status_out(status.upsert(stored, rows.filter(F.col("arrival") % 2 == 0)))


def _dim_sums(metrics: DataFrame) -> DataFrame:
    each = metrics.select("metric", "value", F.explode("dims").alias("dim", "_v"))
    return each.groupBy("metric", "dim", F.col("_v")[0].alias("dim_value")).agg(
        F.sum("value").alias("total")
    )


def _dims_sql(source: str, metric: str, dims: dict[str, str], prefix: str = "") -> str:
    """Sum of 1.0 per dim and value; a dim is absent where its value is NULL."""
    parts = [
        f"SELECT {metric} AS metric, '{prefix}{d}' AS dim, {v} AS dim_value FROM {source}"
        for d, v in dims.items()
    ]
    return (
        "SELECT metric, dim, dim_value, CAST(count(*) AS DOUBLE) AS total FROM ("
        + " UNION ALL ".join(parts)
        + ") u GROUP BY 1, 2, 3"
    )


@query(
    "status_metrics",
    f"WITH {STATUS_SQL} "
    + _dims_sql(
        "v_status",
        "'status'",
        {
            "tags_k": "k",
            "track_0": "track_0",
            "track_1": "track_1",
            "service": "service",
            "host": "host",
            "agent": "agent",
            "message": "message",
            "status_value": "value",
        },
        "metric-",
    ),
)
def status_metrics(spark, sf):
    return _dim_sums(ev.prefix_dims(ev.status_metrics(views.statuses(spark, sf))))


def _pagers(spark, sf) -> DataFrame:
    return views.events(spark, sf).select(
        "ts",
        F.lit("svc").alias("service"),
        F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("host"),
        (F.col("event_id") % 3 != 0).alias("page"),
        F.when(F.col("event_type") == "error", "trigger").otherwise("resolve").alias("type"),
        F.concat(F.lit("inc/"), F.col("user_id").cast("string")).alias("incident_key"),
        F.concat(F.lit("key"), (F.col("user_id") % 4).cast("string")).alias("service_key"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), (F.col("user_id") % 10).cast("string"))).alias("description"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("details"),
        "event_id",
    )


_PAGER_SQL = E_SQL + """, v_pager AS (
  SELECT event_id, t, 'svc' AS service, 'h' || (user_id % 7) AS host,
    event_id % 3 <> 0 AS page, CASE WHEN event_type = 'error' THEN 'trigger' ELSE 'resolve' END AS type,
    'inc/' || user_id AS incident_key, 'key' || (user_id % 4) AS service_key,
    CASE WHEN event_type = 'error' THEN 'failed ' || (user_id % 10) END AS description, k
  FROM e)"""


@query(
    "pager_metrics",
    f"WITH {_PAGER_SQL} SELECT * FROM ("
    + _dims_sql(
        "v_pager",
        "'pager/' || type",
        {
            "service": "service",
            "host": "host",
            "page": "CAST(page AS VARCHAR)",
            "serviceKey": "service_key",
            "description": "description",
        },
    )
    + ") x WHERE NOT (dim = 'description' AND dim_value IS NULL)",
)
def pager_metrics(spark, sf):
    return _dim_sums(ev.pager_metrics(_pagers(spark, sf)))


@query(
    "alert_metrics",
    f"WITH {ALERT_SQL} "
    + _dims_sql(
        "v_alert", "'alert'", {c: c for c in ("service", "host", "severity", "description")}
    ),
)
def alert_metrics(spark, sf):
    return _dim_sums(ev.alert_metrics(views.alerts(spark, sf)))


@query(
    "heartbeat_metrics",
    f"WITH {HB_SQL} "
    + _dims_sql(
        "(SELECT *, 'prod' AS env FROM v_hb) h",
        "'heartbeat'",
        {c: c for c in ("service", "host", "agent", "env")},
    ),
)
def heartbeat_metrics(spark, sf):
    metrics = ev.heartbeat_metrics(views.heartbeats(spark, sf))
    return _dim_sums(ev.with_base_dims(metrics, env=F.lit("prod")))


@query(
    "event_rate",
    f"WITH {ALERT_SQL} SELECT t - t % {HOUR_US} AS window_us, 'alert' AS metric, service, severity, "
    "CAST(count(*) AS DOUBLE) AS value FROM v_alert GROUP BY 1, 2, 3, 4",
)
def event_rate(spark, sf):
    rate = ev.event_rate(ev.alert_metrics(views.alerts(spark, sf)), ["service", "severity"])
    return rate.select(us("window_start").alias("window_us"), "metric", "service", "severity", "value")


@query(
    "alerts_notify",
    f"WITH {ALERT_SQL} SELECT arrival, t AS ts_us, service, description FROM v_alert "
    "WHERE severity = 'SERVICE_FAILURE'",
)
def alerts_notify(spark, sf):
    found = ev.notify_alerts(views.alerts(spark, sf), "service-failure")
    return found.select("arrival", us().alias("ts_us"), "service", "description")


@query(
    "pageable",
    f"WITH {_PAGER_SQL} SELECT event_id, type, incident_key FROM v_pager WHERE page",
)
def pageable(spark, sf):
    return ev.pageable(_pagers(spark, sf)).select("event_id", "type", "incident_key")


_ISO_SQL = "strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


@query(
    "alert_mails",
    f"WITH {ALERT_SQL} SELECT arrival, '[' || severity || '] ' || service || ': ' || description AS subject, "
    f"'timestamp: ' || {_ISO_SQL} || chr(10) || 'host: ' || host || chr(10) || 'k: ' || k || chr(10) || 'none: null' AS body FROM v_alert",
)
def alert_mails(spark, sf):
    """An entry without a value reads "null"."""
    none = F.create_map(F.lit("none"), F.lit(None).cast("string"))
    alerts = views.alerts(spark, sf).withColumn("data", F.map_concat("data", none))
    return ev.alert_mails(alerts).select("arrival", "subject", "body")


@query(
    "alert_log_context",
    f"WITH {ALERT_SQL} SELECT arrival, 'host: ' || host || chr(10) || 'k: ' || k || chr(10) || 'none: null' || chr(10) || "
    "'service: ' || service || chr(10) || 'severity: ' || lower(replace(severity, '_', '-')) || chr(10) || "
    "'timestamp: ' || strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%SZ') AS context FROM v_alert",
)
def alert_log_context(spark, sf):
    """The host field of the data loses against the fixed field; severity and timestamp are as they came."""
    alerts = views.alerts(spark, sf)
    clash = F.create_map(F.lit("host"), F.lit("from data"), F.lit("none"), F.lit(None).cast("string"))
    alerts = alerts.withColumns(
        {
            "data": F.map_concat("data", clash),
            "severity_text": F.lower(F.replace("severity", F.lit("_"), F.lit("-"))),
            "timestamp_text": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        }
    )
    return ev.alert_log_context(alerts).select("arrival", text.entry_lines("context").alias("context"))


@query(
    "alert_aggregate",
    f"WITH {ALERT_SQL} SELECT t - t % {HOUR_US} AS window_us, description, service AS exception, "
    "count(*) AS n, arg_min(k, arrival) AS first_sample FROM v_alert GROUP BY 1, 2, 3",
)
def alert_aggregate(spark, sf):
    alerts = views.alerts(spark, sf).withColumns(
        {"exception": F.col("service"), "sample": F.element_at("data", F.lit("k"))}
    )
    out = ev.alert_aggregate(alerts, "1 hour")
    return out.select(us("window_start").alias("window_us"), "description", "exception", "n", "first_sample")


@query(
    "event_bus",
    f"WITH {HB_SQL} SELECT 'heartbeats' AS feed, t AS ts_us, "
    "'{\"feed\":\"heartbeats\",\"timestamp\":\"' || " + _ISO_SQL + " || '\",\"service\":\"svc\",\"host\":\"' || host || "
    "'\",\"agent\":\"' || agent || '\",\"arrival\":' || arrival || '}' AS payload FROM v_hb",
)
def event_bus(spark, sf):
    out = ev.to_event_map(views.heartbeats(spark, sf), "heartbeats")
    return out.select("feed", us().alias("ts_us"), "payload")


def _status_messages(spark, sf) -> DataFrame:
    """Status events as bus messages: every 11th is cut short, every 13th has a bad time, every
    7th message is an array of two events."""
    rows = views.events(spark, sf)
    stamp = F.when(F.col("event_id") % 13 == 0, "hey").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    )
    event = F.to_json(
        F.struct(
            stamp.alias("timestamp"),
            F.lit("svc").alias("service"),
            F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("host"),
            F.concat(F.lit("agent-"), (F.col("user_id") % 12).cast("string")).alias("agent"),
            F.array(F.col("event_type"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"))).alias("track"),
            F.from_json("props", "map<string,int>").alias("tags"),
            F.lit("v").alias("value"),
            F.lit("junk").alias("unknown_field"),
        )
    )
    payload = (
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), F.col("event_type")))
        .when(F.col("event_id") % 7 == 0, F.concat(F.lit("["), event, F.lit(","), event, F.lit("]")))
        .otherwise(event)
    )
    return rows.select("event_id", payload.alias("payload"))


_MESSAGES_SQL = E_SQL + """, v_message AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing field'
      WHEN event_id % 13 = 0 THEN 'bad timestamp' END AS error,
    t - t % 1000 AS ts_us, 'agent-' || (user_id % 12) AS agent,
    event_type || '/u' || (user_id % 20) AS path, k
  FROM e, range(CASE WHEN event_id % 11 <> 0 AND event_id % 7 = 0 THEN 2 ELSE 1 END))"""


@query(
    "parse_statuses",
    f"WITH {_MESSAGES_SQL} SELECT event_id, ts_us, agent, path, k FROM v_message WHERE error IS NULL",
)
def parse_statuses(spark, sf):
    parsed = ev.good(feeds.decode(_status_messages(spark, sf), "statuses"))
    return parsed.select(
        "event_id", us().alias("ts_us"), "agent", _path(), F.element_at("tags", F.lit("k")).alias("k")
    )


@query(
    "undecodable_events",
    f"WITH {_MESSAGES_SQL} SELECT CASE WHEN error = 'missing field' THEN 'Failed to decode events from statuses' "
    "ELSE 'Failed to process event from statuses' END AS description, error AS exception, "
    "CASE WHEN error = 'missing field' THEN '{' || split_part(path, '/', 1) ELSE 'hey' END AS message, count(*) AS n "
    "FROM v_message WHERE error IS NOT NULL GROUP BY 1, 2, 3",
)
def undecodable_events(spark, sf):
    bad = ev.isolate_failures(feeds.decode(_status_messages(spark, sf), "statuses"), "statuses")
    whole = F.coalesce(F.get_json_object("message", "$.timestamp"), F.col("message")).alias("message")
    return bad.groupBy("description", "exception", whole).agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_pagers",
    f"WITH {_PAGER_SQL} SELECT event_id, t - t % 1000 AS ts_us, page, type, incident_key, service_key, description, "
    "CASE WHEN type = 'trigger' THEN k END AS k FROM v_pager",
)
def parse_pagers(spark, sf):
    rows = _pagers(spark, sf)
    data = F.struct(
        F.col("type"),
        F.col("incident_key").alias("incidentKey"),
        F.col("service_key").alias("serviceKey"),
        F.col("description"),
        F.from_json("details", "map<string,int>").alias("details"),
    )
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    messages = rows.select("event_id", F.to_json(F.struct(stamp, "service", "host", "page", data.alias("data"))).alias("payload"))
    parsed = ev.good(feeds.decode(messages, "pagers"))
    return parsed.select(
        "event_id", us().alias("ts_us"), "page", "type", "incident_key", "service_key", "description",
        F.get_json_object("details", "$.k").alias("k"),
    )


@query(
    "parse_alerts",
    f"WITH {ALERT_SQL} SELECT arrival, t - t % 1000 AS ts_us, severity, description, k FROM v_alert",
)
def parse_alerts(spark, sf):
    rows = views.alerts(spark, sf)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    wire = F.replace(F.lower("severity"), F.lit("_"), F.lit("-")).alias("severity")
    messages = rows.select(
        "arrival", F.to_json(F.struct(stamp, "service", "host", wire, "description", "data")).alias("payload")
    )
    parsed = ev.good(feeds.decode(messages, "alerts"))
    return parsed.select(
        "arrival", us().alias("ts_us"), "severity", "description", F.element_at("data", F.lit("k")).alias("k")
    )


@query(
    "parse_heartbeats",
    f"WITH {HB_SQL} SELECT arrival, t - t % 1000 AS ts_us, host, agent FROM v_hb",
)
def parse_heartbeats(spark, sf):
    rows = views.heartbeats(spark, sf)
    bus = ev.to_event_map(rows, "heartbeats").withColumn(
        "arrival", F.get_json_object("payload", "$.arrival").cast("bigint")
    )
    parsed = ev.good(feeds.decode(bus.select("payload", "arrival"), "heartbeats"))
    return parsed.select("arrival", us().alias("ts_us"), "host", "agent")


@query(
    "pager_outbox",
    f"WITH {_PAGER_SQL} SELECT event_id, 'post' AS route, '{{\"service_key\":\"' || service_key || "
    "'\",\"incident_key\":\"' || incident_key || '\",\"event_type\":\"' || type || '\"' || "
    "CASE WHEN type = 'trigger' THEN ',\"description\":\"' || description || '\",\"details\":{\"k\":' || k || '}}' "
    "ELSE '}' END AS payload FROM v_pager WHERE page",
)
def pager_outbox(spark, sf):
    rows = ev.pageable(_pagers(spark, sf)).select(
        "event_id",
        F.col("service_key").alias("pager_key"),
        "incident_key",
        F.col("type").alias("action"),
        "description",
        F.from_json("details", "map<string,int>").alias("details"),
    )
    return outbox.pager_outbox(rows).select("event_id", "route", "payload")


@query(
    "pager_mails",
    f"WITH {_PAGER_SQL} SELECT '[SERVICE_FAILURE] ops: Failed to post PagerDuty event' AS subject, "
    "type, count(*) AS n FROM v_pager WHERE page AND event_id % 5 = 0 GROUP BY 1, 2",
)
def pager_mails(spark, sf):
    """Every fifth post is answered with 503."""
    rows = ev.pageable(_pagers(spark, sf)).select(
        F.col("service_key").alias("pager_key"),
        "incident_key",
        F.col("type").alias("action"),
        "description",
        "details",
        F.when(F.col("event_id") % 5 == 0, 503).otherwise(202).alias("post_status"),
    )
    mails = outbox.pager_mails(outbox.pager_outbox(rows), "ops")
    return mails.groupBy("subject", F.get_json_object("body", "$.event_type").alias("type")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "mail_outbox",
    f"WITH {ALERT_SQL} SELECT arrival, '[monitor] [' || severity || '] ' || service || ': ' || description AS subject, "
    "'ops@example.org' AS recipients, 'withheld' AS delivery FROM v_alert WHERE severity = 'SERVICE_FAILURE'",
)
def mail_outbox(spark, sf):
    mails = ev.alert_mails(ev.notify_alerts(views.alerts(spark, sf)))
    out = outbox.mail_outbox(mails, "[monitor] %s", ("ops@example.org",), quiet=True)
    return out.select("arrival", "subject", "recipients", "delivery")
