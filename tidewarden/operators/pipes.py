"""Backlog and failures of pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import millis

DEFAULT_PERIOD_MS = 4 * 86_400_000
FAILURE_THROTTLE_MS = 6 * 3_600_000
ALERT_THROTTLE_MS = 3_600_000


def min_work_time(items: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest interval start per pipe; a pipe without intervals has no row.
    The minimum is taken inside each row first, so nothing is exploded."""
    starts = F.transform("intervals", lambda i: i["start"])
    return (
        items.filter(F.col("pipe_id").isNotNull())
        .groupBy(*keys)
        .agg(F.min(F.array_min(starts)).alias("min_time"))
        .filter(F.col("min_time").isNotNull())
    )


def pipe_channels(pipelines: DataFrame) -> DataFrame:
    return pipelines.select("env", F.explode("pipes").alias("p")).select(
        "env", F.col("p.id").alias("pipe_id"), F.col("p.channel").alias("channel")
    )


def complete_environments(work: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Work list and pipelines of the environments that delivered both."""
    return work.withColumnRenamed("doc", "work_doc").join(
        pipelines.withColumnRenamed("doc", "pipelines_doc"), "env", "inner"
    )


def pipe_backlog(
    channels: DataFrame,
    work: DataFrame,
    periods: DataFrame,
    now: Column,
    keys: list[str],
    default_ms: int = DEFAULT_PERIOD_MS,
) -> DataFrame:
    """Backlog per pipe with its alert period: the specific one, else the default for pipes
    without a channel, else 0 = disabled."""
    out = channels.join(work, keys, "left").join(periods, keys, "left")
    fallback = F.when(F.col("channel").isNull(), F.lit(default_ms)).otherwise(F.lit(0))
    behind = millis(now) - millis(F.coalesce("min_time", now))
    lag = F.greatest(F.lit(0).cast("long"), behind)
    return out.withColumns(
        {
            "period_ms": F.coalesce("period_ms", fallback).cast("long"),
            "lag_millis": lag,
            "lag_seconds": (lag / 1000).cast("long"),
        }
    )


def backlog_metrics(backlog: DataFrame) -> DataFrame:
    """Metric `pipe/backlog` of rows env, control (the service that runs the pipes), pipe_id, channel."""
    dims = F.create_map(
        F.lit("pipesBacklogEnvironment"), F.array("env"),
        F.lit("pipesBacklogControl"), F.array("control"),
        F.lit("pipesBacklogPipeId"), F.array("pipe_id"),
        F.lit("pipesBacklogChannel"), F.array(F.coalesce("channel", F.lit("null"))),
    )
    return backlog.select(
        F.lit("pipe/backlog").alias("metric"),
        F.col("lag_seconds").cast("double").alias("value"),
        dims.alias("dims"),
    )


def failed_jobs(items: DataFrame) -> DataFrame:
    """Items whose id marks a failed job, with the job name and its log."""
    failed = items.filter(F.contains("item_id", F.lit(".failed")))
    return failed.select(
        "env",
        F.replace("item_id", F.lit(".failed"), F.lit("")).alias("job"),
        F.coalesce("log", F.lit("No log found for the job")).alias("log"),
        *[c for c in items.columns if c not in ("env", "item_id", "log")],
    )


def with_throttles(failed: DataFrame, throttles: DataFrame) -> DataFrame:
    """Specific throttle per job of an environment, else the default."""
    out = failed.join(throttles, ["env", "job"], "left")
    return out.withColumn(
        "throttle_ms", F.coalesce("throttle_ms", F.lit(FAILURE_THROTTLE_MS)).cast("long")
    )


def resolved_jobs(triggered: DataFrame, failed_now: DataFrame) -> DataFrame:
    return triggered.join(failed_now, ["env", "job"], "left_anti")
