"""Brokers, partitions and counters of a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import period_text
from ..functions.times import millis
from .ordered import OrderedRows

PARTITION = ["topic", "partition"]


def expected_ids(spark: SparkSession, start: int, count: int) -> DataFrame:
    return spark.range(start, start + count)


def missing(expected: DataFrame, observed: DataFrame) -> DataFrame:
    return expected.join(observed, "id", "left_anti")


def present(expected: DataFrame, observed: DataFrame) -> DataFrame:
    return observed.select("id").join(expected, "id", "left_semi").distinct()


def out_of_bounds(expected: DataFrame, observed: DataFrame) -> DataFrame:
    return observed.select("id").join(expected, "id", "left_anti").distinct()


def under_replicated(assigned: Column | str, isr: Column | str) -> Column:
    return F.size(F.array_except(assigned, isr)) > 0


def per_partition(changes: DataFrame) -> DataFrame:
    """Removal of a whole topic (partition null) becomes one removal per known partition."""
    whole = changes.filter(F.col("partition").isNull())
    single = changes.filter(F.col("partition").isNotNull())
    known = single.select(*PARTITION).distinct()
    spread = whole.drop("partition").join(known, "topic", "inner").select(*changes.columns)
    return single.unionByName(spread)


def partition_history(changes: DataFrame) -> DataFrame:
    """State after every change: present, offline, under_replicated and since when each holds.
    Rows: topic, partition, seq, ts, kind (assigned, isr, removed), ids."""
    none = F.array().cast("array<int>")
    gone = F.col("kind") == "removed"
    rows = OrderedRows(changes, PARTITION, ["ts", "seq"]).last_known(
        inclusive=True,
        assigned=F.when(F.col("kind") == "assigned", F.col("ids")).when(gone, none),
        isr=F.when(F.col("kind") == "isr", F.col("ids")).when(gone, none),
    )
    assigned, isr = F.coalesce("assigned", none), F.coalesce("isr", none)
    rows = rows.with_columns(
        present=~gone,
        offline=~gone & (F.size(isr) == 0),
        under_replicated=~gone & under_replicated(assigned, isr),
    )
    out = rows.runs(offline="offline", under_replicated="under_replicated").df
    return out.withColumns(
        {
            f"{state}_since": F.when(F.col(state), F.col(f"{state}_start"))
            for state in ("offline", "under_replicated")
        }
    ).drop("offline_start", "offline_length", "under_replicated_start", "under_replicated_length")


def partition_state(history: DataFrame) -> DataFrame:
    """Present partitions in their last known state."""
    columns = [c for c in history.columns if c not in PARTITION]
    last = history.groupBy(*PARTITION).agg(
        F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("_s")
    )
    return last.select(*PARTITION, "_s.*").filter("present")


def since_before(df: DataFrame, since: str, when: Column) -> DataFrame:
    return df.filter(F.col(since) < when)


def partition_counts(state: DataFrame, since_limit: Column) -> DataFrame:
    return state.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.count_if("offline").alias("offline"),
        F.count_if(F.col("offline_since") < since_limit).alias("offline_since"),
        F.count_if("under_replicated").alias("under_replicated"),
        F.count_if(F.col("under_replicated_since") < since_limit).alias("under_replicated_since"),
    )


def under_replicated_pct(state: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of under-replicated partitions in percent; null, never NaN, without partitions."""
    total = F.count(F.lit(1))
    share = F.when(total > 0, F.count_if("under_replicated") / total * 100)
    return state.groupBy(*(by or [])).agg(share.alias("pct"))


def over_threshold(value: Column, threshold: Column) -> Column:
    """Strictly greater; a missing or undefined value is not over anything."""
    return F.coalesce(~F.isnan(value.cast("double")) & (value > threshold), F.lit(False))


def newest_condition(state: DataFrame, since: str, now: Column, longest: bool = False) -> DataFrame:
    """The partition whose condition began last (first with `longest`), with its age."""
    holding = state.filter(F.col(since).isNotNull())
    # ties: lowest topic and partition
    best = F.struct(F.col(since), F.struct(*PARTITION)) if longest else F.struct(
        (-millis(since)).alias("s"), F.struct(*PARTITION)
    )
    picked = holding.agg(F.min_by(F.struct(*PARTITION, F.col(since).alias("since")), best).alias("r"))
    seconds = ((millis(now) - millis("since")) / 1000).cast("long")
    return picked.filter(F.col("r").isNotNull()).select("r.*").withColumn("age", period_text(seconds))


def counter_increase(readings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Readings above the previous one of the same broker. Rows: broker, reading."""
    rows = OrderedRows(readings, keys, order).previous(_broker="broker", _reading="reading")
    same = F.col("_broker") == F.col("broker")
    rose = F.col("reading") > F.col("_reading")
    increase = (F.col("reading") - F.col("_reading")).alias("increase")
    return rows.df.filter(same & rose).select(*readings.columns, increase)


def cluster_conditions(
    state: DataFrame, env: str, now: Column, pct: float | None, period_ms: int | None, offline: bool
) -> DataFrame:
    """Conditions of one cluster for the policy `every`: offline partitions, share of
    under-replicated ones, and any under-replicated for a whole period."""
    service = f"kafka/{env}/broker"
    limit = F.timestamp_millis(millis(now) - F.lit(period_ms or 0))
    total = state.agg(
        F.count_if("offline").cast("double").alias("offline"),
        F.when(
            F.count(F.lit(1)) > 0, F.count_if("under_replicated") / F.count(F.lit(1)) * 100
        ).alias("pct"),
        F.count_if(F.col("under_replicated_since") < limit).cast("double").alias("long"),
    )

    def condition(value: str, threshold: float, key: str, text: str) -> Column:
        return F.struct(
            F.lit(f"{service}/{key}").alias("incident_key"),
            F.lit(f"{text}: {service}").alias("description"),
            F.col(value).alias("value"),
            F.lit(float(threshold)).alias("threshold"),
            over_threshold(F.col(value), F.lit(float(threshold))).alias("failing"),
        )

    wanted = []
    if offline:
        wanted.append(condition("offline", 0, "offlinePartitions", "Offline partitions"))
    if pct is not None:
        wanted.append(condition("pct", pct, "underReplicated", "Under-replicated partitions"))
    if period_ms is not None:
        text = "Under-replicated partitions for period of time"
        wanted.append(condition("long", 0, "underReplicatedForPeriod", text))
    return total.select(F.explode(F.array(*wanted)).alias("c")).select("c.*", now.alias("ts"))
