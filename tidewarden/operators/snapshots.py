"""Cluster snapshots: JSON documents to metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import host_port, split_pair

STATISTICS = (
    "array<struct<container_id:string,executor_id:string,framework_id:string,source:string,"
    "statistics:map<string,double>,status:struct<executor_pid:string>>>"
)
SLAVES = "struct<slaves:array<struct<id:string,pid:string,version:string>>>"


def non_zero_double(text: Column | str) -> Column:
    """A JSON double with an absolute value above 1e-6; JSON integers do not count."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike("[.eE]") & (F.abs(text.try_cast("double")) > F.lit(1e-6))


def unpivot_snapshot(df: DataFrame, doc: str = "doc", only_non_zero: bool = False) -> DataFrame:
    """One metric row per entry of a name -> number object; other columns are kept."""
    rest = [c for c in df.columns if c != doc]
    entries = F.from_json(doc, "map<string,string>")
    out = df.select(*rest, F.explode(entries).alias("metric", "_text"))
    if only_non_zero:
        out = out.filter(non_zero_double("_text"))
    return out.select(*rest, "metric", F.col("_text").try_cast("double").alias("value"))


def unpivot_statistics(df: DataFrame, label: str, doc: str = "doc") -> DataFrame:
    """`mesos/<label>/<statistic>` per info and statistic, except `timestamp`."""
    rest = [c for c in df.columns if c != doc]
    out = df.select(*rest, F.explode(F.from_json(doc, STATISTICS)).alias("i"))
    if label == "container":
        dims = F.create_map(
            F.lit("container_id"), F.array("i.container_id"),
            F.lit("executor_id"), F.array("i.executor_id"),
            F.lit("framework_id"), F.array("i.framework_id"),
            F.lit("source"), F.array("i.source"),
            F.lit("executor_pid"), F.array(F.coalesce("i.status.executor_pid", F.lit("-1"))),
        )
    else:
        dims = F.create_map(
            F.lit("executor_id"), F.array("i.executor_id"),
            F.lit("framework_id"), F.array("i.framework_id"),
            F.lit("executor_source"), F.array("i.source"),
        )
    out = out.select(*rest, dims.alias("dims"), F.explode("i.statistics").alias("k", "value"))
    return out.filter(F.col("k") != "timestamp").select(
        *rest, F.concat(F.lit(f"mesos/{label}/"), F.col("k")).alias("metric"), "value", "dims"
    )


def slaves(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Agents listed by masters: env, id, version, host, port; `error` for an odd pid."""
    listed = df.select("env", F.inline(F.from_json(doc, SLAVES)["slaves"]))
    address = host_port(F.element_at(split_pair("pid", "@"), 2))
    out = listed.select("env", "id", "pid", "version", F.inline(F.array(address)))
    problem = F.format_string("Error parsing `%s`, Expected two sides of a `@`", F.col("pid"))
    return out.withColumn("error", F.when(F.col("port").isNull(), problem))


def distinct_slaves(df: DataFrame) -> DataFrame:
    """The same agent reported by several masters counts once."""
    return df.dropDuplicates(["id", "pid", "version", "env"])


def classify_response(df: DataFrame) -> DataFrame:
    """`outcome`: keep for 200, ignore for a redirect, alert for the rest; `alert` has the text."""
    status = F.col("status")
    failed = F.concat(F.lit("Failed to fetch response from mesos node "), F.col("host"))
    outcome = F.when(status == 200, "keep").when(status == 307, "ignore").otherwise("alert")
    return df.withColumns({"outcome": outcome, "alert": F.when(outcome == "alert", failed)})


def probe_failures(df: DataFrame, timeout_ms: int = 10_000) -> DataFrame:
    """Each way an endpoint can fail has its own alert; the other endpoints are untouched.
    Rows: host, path, status, fetch_error, timed_out, parsed."""
    host, path = F.col("host"), F.col("path")
    timeout = F.format_string(
        f"Timed out waiting {timeout_ms} ms for result from mesos node at %s/%s", host, path
    )
    alert = (
        F.when(F.col("timed_out"), timeout)
        .when(
            F.col("fetch_error").isNotNull(),
            F.format_string("Error fetching mesos data from %s/%s", host, path),
        )
        .when(
            ~F.col("status").isin(200, 307),
            F.concat(F.lit("Failed to fetch response from mesos node "), host),
        )
        .when(
            (F.col("status") == 200) & ~F.col("parsed"),
            F.format_string("Failed to deserialize metrics for mesos %s/%s", host, path),
        )
    )
    severity = F.when(alert.startswith("Failed to deserialize"), "ANOMALY").when(
        alert.isNotNull(), "COMPONENT_FAILURE"
    )
    return df.withColumns({"alert": alert, "severity": severity})
