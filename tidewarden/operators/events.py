"""Event parsing and the metrics every event contributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text
from ..functions.times import instant


MISSING = "missing field"


def _parsed(df: DataFrame, payload: str, schema: str, required: list[str]) -> DataFrame:
    """Columns of the event plus `ts`, `error` and `raw`, the message; a row that is not such an event has
    an error.
    An array where an object is expected parses to a struct of nulls, hence the required fields.
    `inline` keeps the parsed struct in one place, so each message is parsed once and not once
    per field."""
    rest = [c for c in df.columns if c != payload]
    names = [f.name for f in T.StructType.fromDDL(schema).fields if f.name != "timestamp"]
    out = df.select(*rest, F.col(payload).alias("_raw"), F.inline(F.array(F.from_json(payload, schema))))
    missing = F.lit(False)
    for field in required:
        missing = missing | F.col(field).isNull()
    out = out.select(
        *rest, "_raw", instant("timestamp").alias("ts"), F.col("timestamp").alias("_stamp"), *names, missing.alias("_missing")
    )
    problem = F.when(F.col("_missing"), MISSING).when(F.col("ts").isNull(), "bad timestamp")
    return out.select(*rest, "ts", *names, problem.alias("error"), F.col("_raw").alias("raw"), "_stamp")


def _keep_bad(df: DataFrame) -> DataFrame:
    """Only a row with an error keeps its message in `raw`."""
    return df.withColumn("raw", F.when(F.col("error").isNotNull(), F.col("raw")))


def parse_heartbeats(df: DataFrame, payload: str = "payload") -> DataFrame:
    required = ["timestamp", "service", "host", "agent"]
    return _keep_bad(_parsed(df, payload, schemas.HEARTBEAT, required).drop("_stamp"))


def parse_statuses(df: DataFrame, payload: str = "payload") -> DataFrame:
    required = ["timestamp", "service", "host", "track"]
    return _keep_bad(_parsed(df, payload, schemas.STATUS, required).drop("_stamp"))


def parse_pagers(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Flat rows tagged by `type`; details stay as JSON text."""
    out = _parsed(df, payload, schemas.PAGER, ["timestamp", "service", "host", "data"])
    rest = [c for c in out.columns if c not in ("data", "error", "raw", "_stamp")]
    known = F.col("data.type").isin("trigger", "resolve")
    out = out.select(
        *rest,
        F.col("data.type").alias("type"),
        F.col("data.incidentKey").alias("incident_key"),
        F.col("data.serviceKey").alias("service_key"),
        F.col("data.description").alias("description"),
        F.col("data.details").alias("details"),
        F.coalesce("error", F.when(~F.coalesce(known, F.lit(False)), "unknown type")).alias(
            "error"
        ),
        "raw",
    )
    return _keep_bad(out)


def parse_alerts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Severity is upper-cased with underscores and must be a known one. The event's own texts of severity
    and timestamp stay as `severity_text` and `timestamp_text`."""
    out = _parsed(df, payload, schemas.ALERT, ["timestamp", "severity"])
    out = out.withColumnRenamed("_stamp", "timestamp_text").withColumn("severity_text", F.col("severity"))
    out = out.withColumn("severity", text.severity_name("severity"))
    known = F.col("severity").isin(*schemas.SEVERITIES)
    return _keep_bad(out.withColumn("error", F.coalesce("error", F.when(~known, F.lit("unknown severity")))))


def good(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error").isNull()).drop("error", "raw")


def isolate_failures(df: DataFrame, topic: str) -> DataFrame:
    """Alert rows for what could not be decoded (it is no such event) or processed (it is one with a value
    that does not serve), with the message as it came; the other rows go on through `good`."""
    bad = df.filter(F.col("error").isNotNull())
    what = F.when(F.col("error") == MISSING, f"Failed to decode events from {topic}")
    return bad.select(
        what.otherwise(f"Failed to process event from {topic}").alias("description"),
        F.col("error").alias("exception"),
        F.col("raw").alias("message"),
    )


def to_event_map(df: DataFrame, feed: str) -> DataFrame:
    """Feed-tagged JSON of every row, the shape of the event bus."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fields = [F.col(c) for c in df.columns if c != "ts"]
    body = F.to_json(F.struct(F.lit(feed).alias("feed"), stamp.alias("timestamp"), *fields))
    return df.select(F.lit(feed).alias("feed"), F.col("ts"), body.alias("payload"))


def _one(value: Column | str) -> Column:
    return F.array(F.col(value) if isinstance(value, str) else value)


def _dims(**named: Column | str) -> Column:
    parts = []
    for name, value in named.items():
        parts += [F.lit(name), _one(value)]
    return F.create_map(*parts)


def _metric(df: DataFrame, metric: Column, dims: Column) -> DataFrame:
    return df.select(
        metric.alias("metric"), F.lit(1.0).alias("value"), dims.alias("dims"), F.col("ts").alias("created")
    )


def status_metrics(df: DataFrame, compat: bool = False) -> DataFrame:
    """Metric `status`. `compat=True` puts the agent into the dim `message`. Without tags or track there
    are no dims for them."""
    no_tags = F.create_map().cast("map<string,string>")
    tags = F.transform_values(
        F.transform_keys(F.coalesce("tags", no_tags), lambda k, _: F.concat(F.lit("tags_"), k)),
        lambda _, v: F.array(v),
    )
    track = F.coalesce("track", F.array().cast("array<string>"))
    places = F.transform(track, lambda _, i: F.concat(F.lit("track_"), i.cast("string")))
    tracks = F.map_from_arrays(places, F.transform(track, lambda el: F.array(el)))
    fixed = _dims(
        service="service",
        host="host",
        agent="agent",
        message="agent" if compat else "message",
        status_value="value",
    )
    return _metric(df, F.lit("status"), F.map_concat(tags, tracks, fixed))


def pager_metrics(df: DataFrame) -> DataFrame:
    base = _dims(
        service="service",
        host="host",
        page=F.col("page").cast("string"),
        serviceKey="service_key",
    )
    dims = F.when(
        F.col("type") == "trigger", F.map_concat(base, _dims(description="description"))
    ).otherwise(base)
    return _metric(df, F.concat(F.lit("pager/"), F.col("type")), dims)


def alert_metrics(df: DataFrame) -> DataFrame:
    dims = _dims(service="service", host="host", severity="severity", description="description")
    return _metric(df, F.lit("alert"), dims)


def heartbeat_metrics(df: DataFrame) -> DataFrame:
    return _metric(df, F.lit("heartbeat"), _dims(service="service", host="host", agent="agent"))


def prefix_dims(df: DataFrame, prefix: str = "metric-") -> DataFrame:
    return df.withColumn("dims", F.transform_keys("dims", lambda k, _: F.concat(F.lit(prefix), k)))


def with_base_dims(df: DataFrame, **base: Column | str) -> DataFrame:
    return df.withColumn("dims", F.map_concat("dims", _dims(**base)))


def event_rate(metrics: DataFrame, dims: list[str], width: str = "1 hour") -> DataFrame:
    """Events per window and dims; sums before the shuffle."""
    named = [F.col("dims")[d][0].alias(d) for d in dims]
    return (
        metrics.groupBy(F.window("created", width).alias("_w"), "metric", *named)
        .agg(F.sum("value").alias("value"))
        .select(F.col("_w.start").alias("window_start"), "metric", *dims, "value")
    )


def alert_log_context(df: DataFrame) -> DataFrame:
    """Alert data as text, overlaid with the fixed fields (they win); null reads "null". Severity and
    timestamp are the event's own texts where it has kept them. Nested values are JSON text."""
    stamp, severity = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("severity")
    if "timestamp_text" in df.columns:
        stamp = F.coalesce("timestamp_text", stamp)
    if "severity_text" in df.columns:
        severity = F.coalesce("severity_text", severity)
    data = F.transform_values("data", lambda _, v: F.coalesce(v, F.lit("null")))
    fixed = F.create_map(
        F.lit("timestamp"), stamp,
        F.lit("service"), F.col("service"),
        F.lit("host"), F.col("host"),
        F.lit("severity"), severity,
    )
    empty = F.create_map().cast("map<string,string>")
    return df.withColumn("context", text.merge_maps(F.coalesce(data, empty), fixed))


def notify_alerts(df: DataFrame, severity: str = "service-failure") -> DataFrame:
    """Alerts of exactly the notify severity."""
    return df.filter(F.col("severity") == F.lit(severity.upper().replace("-", "_")))


def pageable(df: DataFrame) -> DataFrame:
    return df.filter("page")


def alert_body(df: DataFrame) -> Column:
    """Timestamp, host, then the data in key order, one `key: value` line each."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("timestamp: "), stamp),
        F.concat(F.lit("host: "), F.col("host")),
        F.nullif(text.entry_lines("data"), F.lit("")),
    )


def alert_mails(df: DataFrame, max_body: int = 100_000) -> DataFrame:
    """Subject and limited body of each alert, the input of the digest."""
    subject = text.alert_subject("severity", "service", "description")
    return df.select(
        *df.columns, subject.alias("subject"), text.limit_body(alert_body(df), max_body).alias("body")
    )


def alert_aggregate(df: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Repeated alerts collapsed per window, description and exception: count and first sample."""
    return (
        df.groupBy(F.window("ts", width).alias("_w"), "description", "exception")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("sample", F.struct("ts", "arrival")).alias("first_sample"),
        )
        .select(
            F.col("_w.start").alias("window_start"), "description", "exception", "n", "first_sample"
        )
    )
