"""From trigger and resolve actions to complete pages: incident_key, description and details.

Each function takes the actions of one kind and adds the three columns the outbox sends. Times are ISO
text in UTC, durations are text as in the alerts. A missing value in the details reads "null".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hours_text, period_text
from ..functions.times import millis
from .incidents import incident_key

NO_LOG = "No log found for the job"


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _details(**named: Column) -> Column:
    parts = []
    for name, value in named.items():
        parts += [F.lit(name), F.coalesce(value.cast("string"), F.lit("null"))]
    return F.create_map(*parts)


def _page(df: DataFrame, key: Column, description: Column, details: Column) -> DataFrame:
    return df.withColumns({"incident_key": key, "description": description, "details": details})


def stale_data(actions: DataFrame) -> DataFrame:
    """Actions with env, datasource, ts, max_time, threshold_ms."""
    details = _details(
        **{
            "maxtime lag": hours_text(millis("ts") - millis("max_time")),
            "threshold": period_text(F.col("threshold_ms") / 1000),
        }
    )
    key = incident_key("druid/staleData", "env", "datasource")
    return _page(actions, key, F.concat(F.lit("Stale data: "), "datasource"), details)


def backlog(actions: DataFrame) -> DataFrame:
    """Actions with env, pipe_id, ts, min_time, period_ms, channel, control."""
    details = _details(
        controlService=F.col("control"),
        alertPeriod=period_text(F.col("period_ms") / 1000),
        minTime=_stamp("min_time"),
        backlog=hours_text(millis("ts") - millis("min_time")),
        channel=F.col("channel"),
    )
    key = incident_key("pipes/backlogged", "env", "pipe_id")
    return _page(actions, key, F.concat(F.lit("Pipe backlogged: "), "pipe_id"), details)


def failed_job(actions: DataFrame) -> DataFrame:
    """Actions with env, job, log."""
    details = _details(log=F.coalesce("log", F.lit(NO_LOG)))
    key = incident_key("pipes/failed", "env", "job")
    return _page(actions, key, F.concat(F.lit("Pipe failed: "), "job"), details)


def agent_down(actions: DataFrame, period_ms: int) -> DataFrame:
    """Actions with agent, at, last_seen; down since more than `period_ms`."""
    seconds = lambda ms: F.format_string("%,d", (ms / 1000).cast("long"))
    details = _details(
        **{
            "last heartbeat time": _stamp("last_seen"),
            "current time": _stamp("at"),
            "delay (sec)": seconds(millis("at") - millis("last_seen")),
            "max delay (sec)": seconds(F.lit(period_ms)),
        }
    )
    description = F.format_string("Agent [%s] is down", "agent")
    return _page(actions, incident_key("agent/down", "agent"), description, details)


def unexpected_agent(heartbeats: DataFrame) -> DataFrame:
    """Reported heartbeats of strangers: agent, ts, service, host. Each is a trigger."""
    details = _details(
        heartbeatTimestamp=_stamp("ts"),
        heartbeatService=F.col("service"),
        heartbeatHost=F.col("host"),
        heartbeatAgent=F.col("agent"),
    )
    description = F.format_string("Unexpected heartbeat from agent <%s>", "agent")
    found = _page(heartbeats, incident_key("agent/unexpected", "agent"), description, details)
    return found.withColumn("action", F.lit("trigger"))


def cluster(actions: DataFrame) -> DataFrame:
    """Actions of cluster conditions, which have a key and a description, with value and threshold."""
    number = lambda c: F.format_string("%.2f", c)
    return actions.withColumn("details", _details(value=number("value"), threshold=number("threshold")))
