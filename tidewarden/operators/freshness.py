"""Data freshness and load state of datasources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import lag_seconds, shift
from .incidents import throttled
from .ordered import OrderedRows

STALE_THROTTLE_MS = 3_600_000
LOAD_GRACE_MS = 15 * 60_000


def with_thresholds(observed: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Datasources of an environment that have a threshold configured for it."""
    return observed.join(thresholds, ["env", "datasource"], "inner")


def stale(max_time: Column, threshold_ms: Column, now: Column) -> Column:
    return max_time < shift(now, -threshold_ms)


def freshness_metrics(df: DataFrame, now: Column) -> DataFrame:
    dims = F.create_map(
        F.lit("druidEnvironment"), F.array("env"),
        F.lit("druidDataSource"), F.array("datasource"),
        F.lit("druidBrokerService"), F.array("broker"),
    )
    return df.select(
        F.lit("maxtime/lag").alias("metric"),
        lag_seconds(F.col("max_time"), now).cast("double").alias("value"),
        dims.alias("dims"),
    )


def stale_data_pager(
    probes: DataFrame, keys: list[str], order: list[str], throttle_ms: int = STALE_THROTTLE_MS
) -> DataFrame:
    """Rows ts, max_time, threshold_ms, pager_key. Alerts and pages are throttled greedily; without a pager
    key a stale row is an alert, and its end is nothing."""
    failing = stale(F.col("max_time"), F.col("threshold_ms"), F.col("ts"))
    return throttled(probes.withColumn("failing", failing), keys, order, throttle_ms * 1000)


def load_grace(
    loads: DataFrame, keys: list[str], order: list[str], grace_ms: int = LOAD_GRACE_MS
) -> DataFrame:
    """Probes that still find segments to load more than the grace period after the first of the
    current run of non-zero loads. Adds started_at."""
    loading = F.col("load") > 0
    rows = OrderedRows(loads, keys, order).runs(_loading=loading)
    overdue = loading & (shift("_loading_start", grace_ms) < F.col("ts"))
    return rows.df.filter(overdue).select(*loads.columns, F.col("_loading_start").alias("started_at"))
