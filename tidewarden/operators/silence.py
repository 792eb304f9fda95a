"""Silent agents, stuck jobs and damped heartbeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import millis, shift
from .ordered import OrderedRows
from .throttle import greedy_throttle, session_throttle

UNEXPECTED_GAP_MS = 15 * 60 * 1000
STUCK_PERIODS = 3


def expected_only(heartbeats: DataFrame, expected: DataFrame) -> DataFrame:
    return heartbeats.join(expected, "agent", "left_semi")


def unexpected_agents(
    heartbeats: DataFrame, expected: DataFrame, gap_ms: int = UNEXPECTED_GAP_MS
) -> DataFrame:
    """Heartbeats of agents nobody expects, reported when not seen for `gap`."""
    strangers = heartbeats.join(expected, "agent", "left_anti")
    return session_throttle(strangers, ["agent"], ["ts", "arrival"], gap_ms * 1000)


def silence(
    heartbeats: DataFrame, expected: DataFrame, start: Column, period_ms: int, now: Column
) -> DataFrame:
    """Down and up moments of expected agents: down one period after a sighting when none follows
    in that time, up at the next sighting. An agent never seen counts as seen at `start`.
    Returns agent, action, at, last_seen."""
    seen = expected_only(heartbeats, expected).select("agent", "ts", "arrival")
    first = expected.select("agent", start.alias("ts"), F.lit(-1).cast("long").alias("arrival"))
    rows = OrderedRows(seen.unionByName(first), ["agent"], ["ts", "arrival"]).following(
        _next=F.col("ts")
    )
    until = F.coalesce("_next", now)
    down = rows.df.filter(millis(until) - millis("ts") > period_ms)
    moments = F.array(
        F.struct(F.lit("trigger").alias("action"), shift("ts", period_ms).alias("at")),
        F.struct(F.lit("resolve").alias("action"), F.col("_next").alias("at")),
    )
    return (
        down.select("agent", F.col("ts").alias("last_seen"), F.explode(moments).alias("m"))
        .select("agent", "m.action", "m.at", "last_seen")
        .filter(F.col("at").isNotNull())
    )


def stuck(runs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose last start lies more than three periods back."""
    last = runs.groupBy("job").agg(
        F.max("started_at").alias("last_start"), F.max("period_ms").alias("period_ms")
    )
    return last.filter(shift("last_start", F.col("period_ms") * STUCK_PERIODS) < now)


def damped_heartbeats(
    ticks: DataFrame, keys: list[str], order: list[str], period_ms: int, start: Column
) -> DataFrame:
    """Ticks that emit a heartbeat: at least one period after the last emitted one, counted from
    `start`, which must not lie after the first tick."""
    return greedy_throttle(
        ticks, keys, order, F.lit(period_ms * 1000), strict=False, start=F.unix_micros(start)
    )
