"""Streaming jobs: one query per feed, from the source through decoding to its tables.

A micro-batch writes to a folder named by its id, replacing what an earlier attempt of the same
batch may have left, so a batch that is run again after a lost executor or a restart does not
write anything twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import events, pages, silence
from ..sinks import outbox
from ..sinks.outbox import write_batch
from ..sinks.status_store import StatusStore
from ..sources import feeds
from .keyed import TIME_TO_LIVE_MS, Counters, LoadGrace, Partitions, Sightings, Streaks, keyed, watchdog
from .processors import mail_digests
from .windows import rate_rows, rate_windows

Handler = Callable[[DataFrame, int], None]


def start(
    df: DataFrame, handler: Handler, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def _bad_rows(decoded: DataFrame, feed: str, root: str, batch_id: int) -> None:
    """Messages that failed, and one alert for each kind of failure with the number and one message."""
    bad = events.isolate_failures(decoded, feed)
    write_batch(bad, f"{root}/dead_letters/{feed}", batch_id)
    alerts = bad.groupBy("description", "exception").agg(
        F.count(F.lit(1)).alias("n"), F.min("message").alias("first_sample")
    )
    write_batch(alerts, f"{root}/alerts/{feed}", batch_id)


def status_job(spark: SparkSession, source: DataFrame, root: str, compat: bool = False) -> Handler:
    """Statuses: current state, history, metrics, dead letters."""
    store = StatusStore(spark, f"{root}/status")

    def handle(batch: DataFrame, batch_id: int) -> None:
        decoded = feeds.decode(batch, "statuses").persist()
        try:
            good = events.good(decoded)
            store.upsert(good, batch_id)
            metrics = events.prefix_dims(events.status_metrics(good, compat))
            write_batch(metrics, f"{root}/metrics/statuses", batch_id)
            _bad_rows(decoded, "statuses", root, batch_id)
        finally:
            decoded.unpersist()

    return handle


def alert_job(root: str, severity: str = "service-failure", rate_width: str = "1 hour", delay: str = "10 minutes") -> Handler:
    """Alerts: mails of the notify severity, log context, metrics, dead letters, and rates per window of event time:
    closed windows in `rates/alerts/windows`, metrics later than the delay in `rates/alerts/late`."""
    dims = ["service", "severity"]
    rates = rate_windows(dims, rate_width, delay).handler(f"{root}/rates/alerts")

    def handle(batch: DataFrame, batch_id: int) -> None:
        decoded = feeds.decode(batch, "alerts").persist()
        try:
            good = events.good(decoded)
            mails = events.alert_mails(events.notify_alerts(good, severity))
            write_batch(mails.select("subject", "body", "ts"), f"{root}/mails", batch_id)
            write_batch(
                events.alert_log_context(good).select("description", "context"),
                f"{root}/alert_log",
                batch_id,
            )
            metrics = events.alert_metrics(good)
            write_batch(events.prefix_dims(metrics), f"{root}/metrics/alerts", batch_id)
            rates(rate_rows(metrics, dims), batch_id)
            _bad_rows(decoded, "alerts", root, batch_id)
        finally:
            decoded.unpersist()

    return handle


def pager_job(root: str, quiet: bool = False, mail_only: bool = False) -> Handler:
    """Pager events: outbox rows of those that ask for a page, metrics, dead letters."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        decoded = feeds.decode(batch, "pagers").persist()
        try:
            good = events.good(decoded)
            actions = events.pageable(good).select(
                F.col("service_key").alias("pager_key"),
                "incident_key",
                F.col("type").alias("action"),
                "description",
                "details",
            )
            write_batch(outbox.pager_outbox(actions, quiet, mail_only), f"{root}/pages", batch_id)
            metrics = events.prefix_dims(events.pager_metrics(good))
            write_batch(metrics, f"{root}/metrics/pagers", batch_id)
            _bad_rows(decoded, "pagers", root, batch_id)
        finally:
            decoded.unpersist()

    return handle


def digest_stream(
    source: DataFrame, waits_ms: list[int], cutoff: int, severity: str = "service-failure"
) -> DataFrame:
    """Digests of the mails of a stream of alert messages; each message needs an arrival."""
    good = events.good(feeds.decode(source, "alerts"))
    mails = events.alert_mails(events.notify_alerts(good, severity))
    return mail_digests(mails.select("subject", "body", "arrival"), waits_ms, cutoff)


def watchdog_stream(source: DataFrame, configuration: DataFrame, period_ms: int) -> DataFrame:
    """Actions for silent agents from a stream of heartbeat messages and a stream of configuration rows
    (agent, kind, and epoch and seq where there are any; see `keyed.configuration_epoch`)."""
    beats = events.good(feeds.decode(source, "heartbeats")).select("agent", F.lit("heartbeat").alias("kind"))
    known = [c for c in ("agent", "kind", "epoch", "seq") if c in configuration.columns]
    return watchdog(beats.unionByName(configuration.select(*known), allowMissingColumns=True), period_ms)


def verdict_stream(results: DataFrame, time_to_live_ms: int | None = TIME_TO_LIVE_MS) -> DataFrame:
    """Verdicts of a stream of probe results: group, name, at, id, ok, fail_count, resolve_count."""
    return keyed(results, Streaks(["group", "name"], ["at", "id"], ["at", "id", "ok"], time_to_live_ms))


def verdict_job(root: str) -> Handler:
    """Verdicts of `verdict_stream`: all of them, and the incidents that open or end with them."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{root}/verdicts", batch_id)
        action = F.when(F.col("verdict") == "failed", "trigger").when(F.col("verdict") == "resolved", "resolve")
        key = F.concat_ws("/", "group", "name").alias("incident_key")
        pages = batch.select(key, action.alias("action"), "at", "id").filter("action IS NOT NULL")
        write_batch(pages, f"{root}/incidents", batch_id)

    return handle


def topology_stream(changes: DataFrame, time_to_live_ms: int | None = TIME_TO_LIVE_MS) -> DataFrame:
    """Since when partitions are offline or under-replicated, on every change: topic, partition, kind, ids, at, seq."""
    return keyed(changes, Partitions(["topic"], ["at", "seq"], ["at", "seq"], time_to_live_ms))


def counter_stream(readings: DataFrame, keys: list[str], time_to_live_ms: int | None = TIME_TO_LIVE_MS) -> DataFrame:
    """Rises of counters: keys, broker, reading, at, id."""
    return keyed(readings, Counters(keys, ["at", "id"], ["at", "id"], time_to_live_ms))


def load_stream(loads: DataFrame, keys: list[str], grace_us: int, time_to_live_ms: int | None = TIME_TO_LIVE_MS) -> DataFrame:
    """Loads that have been above zero for longer than the grace: keys, load, at, id."""
    return keyed(loads, LoadGrace(grace_us, keys, ["at", "id"], ["at", "id"], time_to_live_ms))


def stranger_stream(source: DataFrame, expected: DataFrame, gap_ms: int = silence.UNEXPECTED_GAP_MS) -> DataFrame:
    """Heartbeats of agents that are not expected, when they were not seen for the gap. A stranger is forgotten when it
    has not been seen for a hundred gaps, so the state does not grow with all strangers there ever were."""
    good = events.good(feeds.decode(source, "heartbeats"))
    strangers = good.join(expected, "agent", "left_anti").select("agent", F.unix_micros("ts").alias("at"), "service", "host")
    return keyed(strangers, Sightings(gap_ms * 1000, ["agent"], ["at", "service", "host"], ["at", "service", "host"], 100 * gap_ms))


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/batch={batch_id - 1}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _strangers(good: DataFrame, config: DataFrame, root: str, batch_id: int) -> None:
    """Pages for unexpected agents that were not seen for the gap, in this batch or before. The last sighting of
    each is kept from batch to batch, until it is older than the newest of all by more than a hundred gaps."""
    seen = good.join(config, "agent", "left_anti").select("agent", "ts", "service", "host").withColumn("old", F.lit(False))
    before = _earlier(good.sparkSession, f"{root}/strangers", batch_id)
    if before is not None:
        seen = seen.unionByName(before.withColumn("old", F.lit(True)))
    order = F.xxhash64("service", "host", "old").alias("arrival")
    found = silence.unexpected_agents(seen.select("*", order), config).filter(~F.col("old"))
    columns = ["agent", "ts", "service", "host"]
    write_batch(pages.unexpected_agent(found.select(*columns)), f"{root}/unexpected", batch_id)
    last = seen.groupBy("agent").agg(F.max_by(F.struct("ts", "service", "host"), F.struct("ts", "service", "host")).alias("l"))
    last = last.select("agent", "l.*")
    newest = last.agg(F.max("ts").alias("t")).first()["t"]
    if newest is not None:
        last = last.filter(F.col("ts") > F.lit(newest) - F.expr(f"INTERVAL {100 * silence.UNEXPECTED_GAP_MS} MILLISECONDS"))
    write_batch(last, f"{root}/strangers", batch_id)


def heartbeat_job(root: str, expected: Callable[[], DataFrame]) -> Handler:
    """Heartbeats: receipts of expected agents, pages for strangers, metrics. The configuration is read
    anew for every micro-batch, so a change takes effect with the next one."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        decoded = feeds.decode(batch, "heartbeats").persist()
        try:
            good, config = events.good(decoded), expected()
            write_batch(silence.expected_only(good, config), f"{root}/heartbeats", batch_id)
            _strangers(good, config, root, batch_id)
            metrics = events.prefix_dims(events.heartbeat_metrics(good))
            write_batch(metrics, f"{root}/metrics/heartbeats", batch_id)
            _bad_rows(decoded, "heartbeats", root, batch_id)
        finally:
            decoded.unpersist()

    return handle
