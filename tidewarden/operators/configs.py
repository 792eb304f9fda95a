"""Probe configuration as tables: reading, checking, diffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import period_millis_column


def config_by_key(commits: DataFrame, key: str) -> DataFrame:
    """`outcome` of the wanted key: value, error (unparsable or empty); no row when absent."""
    bad = F.col("error").isNotNull() | F.col("payload").isNull() | (F.trim("payload") == "")
    return commits.filter(F.col("key") == key).withColumn(
        "outcome", F.when(bad, "error").otherwise("value")
    )


def valid_configs(commits: DataFrame) -> DataFrame:
    """Configs that parsed; an empty one is dropped silently."""
    return commits.filter(F.col("payload").isNotNull() & F.col("error").isNull())


def config_alerts(commits: DataFrame, what: str, alert_when_none: bool = False) -> DataFrame:
    """One alert per unparsable config; with `alert_when_none` also when there is no config."""
    bad = commits.filter(F.col("payload").isNotNull() & F.col("error").isNotNull())
    alerts = bad.select(
        F.format_string(f"Bad config for {what}: %s", F.col("key")).alias("description"), "error"
    )
    if not alert_when_none:
        return alerts
    none = commits.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0)
    return alerts.unionByName(
        none.select(
            F.lit(f"No config for {what}").alias("description"), F.lit(None).cast("string").alias("error")
        )
    )


def config_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """`change` per key: removed, added, changed or unchanged."""
    left = old.select(F.col(key).alias("_ok"), F.col(value).alias("old_value"))
    right = new.select(F.col(key).alias("_nk"), F.col(value).alias("new_value"))
    both = left.join(right, F.col("_ok") == F.col("_nk"), "full_outer")
    change = (
        F.when(F.col("_nk").isNull(), "removed")
        .when(F.col("_ok").isNull(), "added")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged")
        .otherwise("changed")
    )
    return both.select(
        F.coalesce("_ok", "_nk").alias(key), "old_value", "new_value", change.alias("change")
    )


def new_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.select(key).join(old.select(key), key, "left_anti")


def gone_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.select(key).join(new.select(key), key, "left_anti")


def expand_map(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """Groups to services, environments to monitored pairs: one row per map entry."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(column).alias(key, value))


def monitored_pairs(configs: DataFrame) -> DataFrame:
    """Rows env, path, pager_key, alert (JSON: group -> topic -> {alert, pager}) to one row per
    env, consumer group and topic with thresholds in milliseconds."""
    groups = configs.select(
        "env",
        "path",
        "pager_key",
        F.explode(F.from_json("alert", "map<string,map<string,string>>")).alias(
            "consumer_group", "_topics"
        ),
    )
    topics = groups.select(
        "env", "path", "pager_key", "consumer_group", F.explode("_topics").alias("topic", "_raw")
    )
    alert = period_millis_column(F.get_json_object("_raw", "$.alert"))
    pager = period_millis_column(F.get_json_object("_raw", "$.pager"))
    kept = ["env", "path", "pager_key", "consumer_group", "topic"]
    periods = F.struct(alert.alias("alert_ms"), pager.alias("pager_ms"))
    out = topics.select(*kept, "_raw", F.inline(F.array(periods)))
    bad = F.col("alert_ms").isNull() | F.col("pager_ms").isNull()
    problem = F.when(bad, F.concat(F.lit("Cannot interpret alert payload: "), F.col("_raw")))
    return out.select(*kept, "alert_ms", "pager_ms", problem.alias("error"))


def datasource_thresholds(configs: DataFrame) -> DataFrame:
    """Rows env, alert (JSON map). A threshold is a period text or an object with threshold and
    an optional pagerKey; anything else is an error."""
    each = configs.select(
        "env", F.explode(F.from_json("alert", "map<string,string>")).alias("datasource", "_raw")
    )
    is_object = F.col("_raw").startswith("{")
    period = F.when(is_object, F.get_json_object("_raw", "$.threshold")).otherwise(F.col("_raw"))
    pager_key = F.when(is_object, F.get_json_object("_raw", "$.pagerKey"))
    out = each.select(
        "env",
        "datasource",
        "_raw",
        pager_key.alias("pager_key"),
        F.explode(F.array(period_millis_column(period))).alias("threshold_ms"),
    )
    problem = F.concat(F.lit("Cannot interpret alert payload: "), F.col("_raw"))
    return out.select(
        "env",
        "datasource",
        "threshold_ms",
        "pager_key",
        F.when(F.col("threshold_ms").isNull(), problem).alias("error"),
    )


def _field(raw: Column, name: str) -> Column:
    return F.get_json_object(raw, f"$.{name}")


def check_definitions(configs: DataFrame, entries: str) -> DataFrame:
    """Rows group, payload (JSON with an object `entries` of name -> definition) to typed
    definitions with the default counts and `error` for values that cannot be read."""
    definitions = F.from_json(_field(F.col("payload"), entries), "map<string,string>")
    raw = F.col("definition")
    each = configs.select("group", F.explode(definitions).alias("name", "definition"))
    period = F.coalesce(_field(raw, "pingPeriod"), _field(raw, "checkPeriod"))
    period_ms = period_millis_column(period)

    def count(name: str, default: int) -> Column:
        text = _field(raw, name)
        return F.when(text.isNull(), default).otherwise(text.try_cast("int"))

    def flag(name: str, default: bool) -> Column:
        text = _field(raw, name)
        return F.when(text.isNull(), default).otherwise(text.try_cast("boolean"))

    fail, resolve = count("failCount", 3), count("resolveCount", 2)
    enabled, ignore = flag("enabled", True), flag("ignoreFailedFetch", False)
    kind = _field(raw, "predicate.type")
    predicate = _field(raw, "predicate")
    shaped = predicate.startswith("{")

    def invalid(name: str) -> Column:
        return F.concat(F.lit(f"Invalid '{name}' for "), F.col("name"))

    problem = F.coalesce(
        F.when(period.isNotNull() & period_ms.isNull(), invalid("period")),
        F.when(fail.isNull(), invalid("failCount")),
        F.when(resolve.isNull(), invalid("resolveCount")),
        F.when(enabled.isNull(), invalid("enabled")),
        F.when(ignore.isNull(), invalid("ignoreFailedFetch")),
        F.when(shaped & ~F.coalesce(kind.isin("gmailRss", "sql"), F.lit(False)), invalid("predicate")),
        F.when((kind == "gmailRss") & _field(raw, "predicate.senderAddress").isNull(), invalid("predicate")),
    )
    return each.select(
        "group",
        "name",
        enabled.alias("enabled"),
        period_ms.alias("period_ms"),
        fail.alias("fail_count"),
        resolve.alias("resolve_count"),
        _field(raw, "pagerKey").alias("pager_key"),
        ignore.alias("ignore_failed_fetch"),
        predicate.alias("predicate"),
        _field(raw, "uri").alias("uri"),
        "definition",
        problem.alias("error"),
    )


def cluster_settings(configs: DataFrame) -> DataFrame:
    """Rows env, payload to broker counts and the optional thresholds of a cluster."""
    raw = F.col("payload")
    period = _field(raw, "alert.UnderReplicatedPeriod")
    brokers = _field(raw, "brokersCount").try_cast("int")
    return configs.select(
        "env",
        brokers.alias("brokers_count"),
        F.coalesce(_field(raw, "brokerStartId").try_cast("int"), F.lit(1)).alias("broker_start_id"),
        F.coalesce(_field(raw, "zkTimeout").try_cast("bigint"), F.lit(30000)).alias("zk_timeout_ms"),
        _field(raw, "jmxPort").try_cast("int").alias("jmx_port"),
        _field(raw, "pagerKey").alias("pager_key"),
        _field(raw, "alert.UnderReplicatedPartitionsPercentage").try_cast("double").alias("pct"),
        period_millis_column(period).alias("under_replicated_ms"),
        F.coalesce(_field(raw, "alert.OfflinePartitions").try_cast("boolean"), F.lit(False)).alias("offline"),
        F.coalesce(_field(raw, "alert.UncleanLeaderElection").try_cast("boolean"), F.lit(False)).alias("unclean"),
        F.when(brokers.isNull(), "brokersCount").alias("error"),
    )


def job_settings(configs: DataFrame) -> DataFrame:
    """Rows env, payload to the two thresholds of streaming jobs."""
    raw = F.col("payload")
    alert = period_millis_column(_field(raw, "alertThreshold"))
    pager = period_millis_column(_field(raw, "pagerThreshold"))
    service = _field(raw, "guardianService")
    return configs.select(
        "env",
        service.alias("guardian_service"),
        _field(raw, "pagerKey").alias("pager_key"),
        alert.alias("alert_ms"),
        pager.alias("pager_ms"),
        F.when(alert.isNull() | pager.isNull() | service.isNull(), "missing or bad field").alias("error"),
    )


def pipe_settings(configs: DataFrame) -> DataFrame:
    """Rows env, payload: default and specific delay periods and failure throttles of pipes."""
    raw = F.col("payload")

    def periods(name: str) -> Column:
        table = F.from_json(_field(raw, name), "map<string,string>")
        return F.transform_values(table, lambda _, v: period_millis_column(v))

    def period(name: str, default_ms: int) -> Column:
        text = _field(raw, name)
        return F.when(text.isNull(), F.lit(default_ms).cast("long")).otherwise(period_millis_column(text))

    delay = period("defaultDelayPagerPeriod", 4 * 86_400_000)
    throttle = period("defaultFailurePagerThrottle", 6 * 3_600_000)
    return configs.select(
        "env",
        _field(raw, "control").alias("control"),
        _field(raw, "delayPagerKey").alias("delay_pager_key"),
        _field(raw, "failurePagerKey").alias("failure_pager_key"),
        delay.alias("default_delay_ms"),
        throttle.alias("default_throttle_ms"),
        periods("delayPagers").alias("delay_ms"),
        periods("failurePagers").alias("throttle_ms"),
        F.when(delay.isNull() | throttle.isNull(), "bad period").alias("error"),
    )


# Defaults of the cluster manager probe's settings.
MANAGER_DEFAULTS = {
    "zkSessionTimeout": 60001,
    "zkConnectionTimeout": 1001,
    "zkMaxRetries": 30,
    "zkBaseSleep": 1002,
    "exhibitorMaxRetries": 29,
    "exhibitorBaseSleep": 1003,
    "exhibitorPollingMs": 1004,
}


def manager_settings(configs: DataFrame) -> DataFrame:
    raw = F.col("payload")
    numbers = [
        F.coalesce(_field(raw, n).try_cast("int"), F.lit(d)).alias(n) for n, d in MANAGER_DEFAULTS.items()
    ]
    path = _field(raw, "zkMasterPath")
    return configs.select(
        "env",
        path.alias("zkMasterPath"),
        _field(raw, "zkEnsemble").alias("zkEnsemble"),
        _field(raw, "exhibitorURI").alias("exhibitorURI"),
        *numbers,
        F.when(path.isNull(), "zkMasterPath").alias("error"),
    )
