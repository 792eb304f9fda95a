"""Consumer lag over log and offset tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_text, period_text, round_half_up
from .segments import broadcast_under, materialize

PARTITION = ["topic", "partition"]
CONSUMER = ["env", "consumer_group", "topic"]


def broker_offsets(log: DataFrame) -> DataFrame:
    """Earliest offset and next offset ("latest") per partition."""
    return log.groupBy(*PARTITION).agg(
        F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest")
    )


def offsets_before(log: DataFrame, when: Column) -> DataFrame:
    """Next offset after the last message written before `when`; the earliest one if none was."""
    written = F.when(F.col("ts") < when, F.col("offset"))
    return log.groupBy(*PARTITION).agg(
        F.coalesce(F.max(written) + 1, F.min("offset")).alias("offset")
    )


def header_millis(header: Column | str) -> Column:
    """Creation time of a message: header field `received`, else `t`, else null."""
    received = F.get_json_object(header, "$.received")
    return F.coalesce(received, F.get_json_object(header, "$.t")).try_cast("bigint")


def adjust_offset(offset: Column, low: Column, high: Column) -> Column:
    """The nearest offset that can be read; null when the bounds are the wrong way round."""
    return F.when(low <= high, F.greatest(F.least(high - 1, offset), low))


def processed_offsets(consumer_offsets: DataFrame, brokers: DataFrame) -> DataFrame:
    """Partitions known on both sides; the stored offset is the next one, so processed is one less."""
    out = consumer_offsets.join(brokers, PARTITION, "inner")
    return out.withColumn("processed", F.col("offset") - 1).drop("offset")


def checkpointed_offsets(partitions: DataFrame, checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """All partitions with their checkpoint, -1 where there is none."""
    out = partitions.join(checkpoints, keys, "left")
    return out.withColumn("processed", F.coalesce("offset", F.lit(-1))).drop("offset")


def with_metadata(offsets: DataFrame, brokers: DataFrame) -> DataFrame:
    """Offsets with broker bounds; a partition without metadata carries an error, it is not dropped."""
    known = brokers.withColumn("_known", F.lit(True))
    out = offsets.join(known, PARTITION, "left")
    message = F.format_string("Couldn't fetch metadata for [%s,%d]", F.col("topic"), F.col("partition"))
    return out.withColumn("error", F.when(F.col("_known").isNull(), message)).drop("_known")


def distinct_topics(offsets: DataFrame) -> DataFrame:
    return offsets.select("topic").distinct()


def measure_backlog(consumers: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Message and time delta per consumer partition.

    `consumers`: keys + partition, processed, earliest, latest. The two messages to look up per
    partition form a table that is joined to the log by exact offset. It is counted first: as long
    as it is small it is broadcast, and the log is read once, only its four columns, without a
    shuffle. Header JSON is parsed for the matching rows alone.
    Adds messages, time, lost, ahead, error.
    """
    consumers = materialize(consumers)
    following = F.col("processed") + 1
    bounded = consumers.select(
        "*",
        adjust_offset(F.col("latest"), F.col("earliest"), F.col("latest")).alias("_broker_at"),
        adjust_offset(following, F.col("earliest"), F.col("latest")).alias("_consumer_at"),
    )
    both = F.array(
        F.struct(F.lit(True).alias("at_broker"), F.col("_broker_at").alias("offset")),
        F.struct(F.lit(False).alias("at_broker"), F.col("_consumer_at").alias("offset")),
    )
    one = [*keys, "partition"]
    lookups = bounded.select(*one, F.explode(both).alias("l")).select(
        *one, "l.at_broker", "l.offset"
    )
    wanted = broadcast_under(lookups.select(*PARTITION, "offset").distinct())
    times = (
        log.select(*PARTITION, "offset", "header")
        .join(wanted, [*PARTITION, "offset"], "inner")
        .select(*PARTITION, "offset", header_millis("header").alias("_t"), F.lit(True).alias("_hit"))
    )
    times = materialize(times)
    found = (
        lookups.join(times, [*PARTITION, "offset"], "left")
        .groupBy(*one)
        .agg(
            F.max(F.when(F.col("at_broker"), F.col("_t"))).alias("_bt"),
            F.max(F.when(~F.col("at_broker"), F.col("_t"))).alias("_ct"),
            F.count_if(F.col("_hit") & F.col("_t").isNull()).alias("_untimed"),
        )
    )
    out = bounded.join(found, one, "left")
    error = F.when(F.col("_broker_at").isNull(), "offset bounds").when(
        F.col("_untimed") > 0, "missing time header"
    )
    zero = F.lit(0).cast("long")
    kept = [c for c in consumers.columns if c != "error"]
    return out.select(
        *kept,
        F.greatest(F.col("_broker_at") - F.col("_consumer_at"), zero).alias("messages"),
        F.greatest(F.coalesce("_bt", zero) - F.coalesce("_ct", zero), zero).alias("time"),
        (following < F.col("earliest")).alias("lost"),
        (following > F.col("latest")).alias("ahead"),
        (F.coalesce("error", error) if "error" in consumers.columns else error).alias("error"),
    )


def backlog_fallback(consumers: DataFrame) -> DataFrame:
    """Lag when times cannot be measured: offsets only, time 0."""
    zero = F.lit(0).cast("long")
    return consumers.withColumns(
        {
            "messages": F.greatest(F.col("latest") - F.col("processed"), zero),
            "time": zero,
        }
    )


def measured_or_fallback(measured: DataFrame, keys: list[str]) -> DataFrame:
    """One failed partition makes the whole consumer fall back, as one measurement covers it."""
    failed = measured.filter(F.col("error").isNotNull()).select(*keys).distinct()
    failed = failed.withColumn("_failed", F.lit(True))
    zero = F.lit(0).cast("long")
    rough = F.greatest(F.col("latest") - F.col("processed"), zero)
    out = measured.join(failed, keys, "left")
    return out.withColumns(
        {
            "messages": F.when(F.col("_failed"), rough).otherwise(F.col("messages")),
            "time": F.when(F.col("_failed"), zero).otherwise(F.col("time")),
        }
    ).drop("_failed")


def topic_stat(deltas: DataFrame, keys: list[str], partition_counts: DataFrame | None = None) -> DataFrame:
    """Totals, averages and the worst partition per consumer and topic.

    `deltas` has alert_ms and pager_ms. Averages divide by the broker's partition count when
    `partition_counts` (topic, partitions) is given, else by the measured number."""
    worst = F.max_by(
        F.struct("partition", "messages", "time"), F.struct(F.col("time"), -F.col("partition"))
    )
    out = deltas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("measured"),
        F.sum("messages").alias("total_messages"),
        F.sum("time").alias("total_time"),
        F.count_if(F.col("time") > F.col("alert_ms")).alias("alert_partitions"),
        F.count_if(F.col("time") > F.col("pager_ms")).alias("pager_partitions"),
        F.max("alert_ms").alias("alert_ms"),
        F.max("pager_ms").alias("pager_ms"),
        worst.alias("_worst"),
    )
    if partition_counts is not None:
        out = out.join(partition_counts, "topic", "left")
    else:
        out = out.withColumn("partitions", F.col("measured"))
    lagging = F.col("_worst.time") > 0
    zero = F.lit(0).cast("long")
    return out.select(
        *keys,
        "partitions",
        "total_messages",
        "total_time",
        round_half_up(F.col("total_messages") / F.col("partitions")).alias("avg_messages"),
        round_half_up(F.col("total_time") / F.col("partitions")).alias("avg_time"),
        "alert_partitions",
        "pager_partitions",
        F.when(lagging, F.col("_worst.partition")).otherwise(-1).alias("max_partition"),
        F.when(lagging, F.col("_worst.messages")).otherwise(zero).alias("max_messages"),
        F.when(lagging, F.col("_worst.time")).otherwise(zero).alias("max_time"),
        "alert_ms",
        "pager_ms",
    )


def lag_details(count: str, threshold_ms: str) -> Column:
    """Nested report of a topic_stat row; null when no partition is over the threshold."""

    def period(column: str) -> Column:
        return period_text((F.col(column) / 1000).cast("long"))

    return F.when(
        F.col(count) > 0,
        F.struct(
            F.col("max_partition").alias("partition"),
            F.struct(
                F.col(count).alias("lagPartitionsCount"),
                F.struct(
                    count_text("total_messages").alias("totalDelta"),
                    count_text("avg_messages").alias("avgDelta"),
                    count_text("max_messages").alias("maxPartitionDelta"),
                ).alias("messages"),
                F.struct(
                    period("avg_time").alias("avgDelta"),
                    period("max_time").alias("maxPartitionDelta"),
                ).alias("time"),
            ).alias("info"),
            F.struct(
                period(threshold_ms).alias("threshold"), period("max_time").alias("delta")
            ).alias("limits"),
        ),
    )


def lag_conditions(stats: DataFrame) -> DataFrame:
    """Alert and pager conditions of each consumer and topic; feed them to `incidents` with the
    policy `every`. Without a pager key a reached pager threshold becomes one more alert."""
    paging = F.col("pager_partitions") > 0
    return stats.withColumns(
        {
            "incident_key": F.format_string(
                "kafka/consumer/%s/%s/%s", "env", "consumer_group", "topic"
            ),
            "alert": F.col("alert_partitions") > 0,
            "failing": paging,
            "no_key_alert": paging & F.col("pager_key").isNull(),
        }
    )


def lag_metrics(deltas: DataFrame, dims: dict[str, str]) -> DataFrame:
    """Two metrics per partition: message and time delta."""
    parts = []
    for name, column in dims.items():
        parts += [F.lit(name), F.array(F.col(column).cast("string"))]
    pair = F.array(
        F.struct(
            F.lit("consumer/offset/delta/messages").alias("metric"),
            F.col("messages").cast("double").alias("value"),
        ),
        F.struct(
            F.lit("consumer/offset/delta/time").alias("metric"),
            F.col("time").cast("double").alias("value"),
        ),
    )
    return deltas.select(F.explode(pair).alias("m"), F.create_map(*parts).alias("dims")).select(
        "m.metric", "m.value", "dims"
    )


def latest_checkpoints(checkpoint_log: DataFrame) -> DataFrame:
    """Last written offset per system, stream and partition. Rows: log_offset, key,
    is_checkpoint, offsets map<struct<system,stream,partition>,bigint> exploded to columns."""
    return (
        checkpoint_log.filter(F.col("offset").isNotNull())
        .groupBy("system", "stream", "partition")
        .agg(F.max_by("offset", "log_offset").alias("offset"))
    )


def checkpoint_freshness(states: DataFrame, now: Column, timeout_ms: int) -> DataFrame:
    """`outcome` per checkpoint reader: values, none, or an error with its text.
    Rows: app, topic, initialised, started, last_ok, failure."""
    limit = F.unix_millis(now) - F.lit(timeout_ms)
    outdated = F.unix_millis("last_ok") < limit
    late_start = F.unix_millis("started") < limit
    subject = F.format_string("Checkpoints for %s - topic %s", "app", "topic")
    stale_text = F.concat(
        subject, F.lit(" are outdated (last time updated at: "), F.col("last_ok").cast("string"), F.lit(")")
    )
    return states.withColumns(
        {
            "outcome": F.when(
                F.col("initialised"), F.when(F.coalesce(outdated, F.lit(False)), "error").otherwise("values")
            ).otherwise(F.when(late_start, "error").otherwise("none")),
            "message": F.when(F.col("initialised") & F.coalesce(outdated, F.lit(False)), stale_text).when(
                ~F.col("initialised") & late_start,
                F.format_string("CheckpointManager for %s - topic %s failed to initialize", "app", "topic"),
            ),
            "cause": F.when(F.col("initialised") & F.coalesce(outdated, F.lit(False)), F.col("failure")),
        }
    )
