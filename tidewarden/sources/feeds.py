"""Event feeds as batch or streaming DataFrames of (payload, arrival columns)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events

PARSERS = {
    "heartbeats": events.parse_heartbeats,
    "statuses": events.parse_statuses,
    "alerts": events.parse_alerts,
    "pagers": events.parse_pagers,
}


def read_kafka(
    spark: SparkSession, feed: str, servers: str, max_per_trigger: int = 5_000_000, cluster: str = ""
) -> DataFrame:
    """A feed from Kafka, from the newest offset when there is no checkpoint yet. Needs the Kafka
    connector on the classpath; offsets are committed by the query's checkpoint. Offsets count within a
    partition of a cluster only, so both are carried."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", feed)
        .option("startingOffsets", "latest")
        .option("maxOffsetsPerTrigger", max_per_trigger)
        .load()
    )
    return raw.select(
        F.col("value").cast("string").alias("payload"),
        F.col("timestamp").alias("received_at"),
        F.lit(cluster or servers).alias("cluster"),
        F.col("partition"),
        F.col("offset").alias("arrival"),
    )


def read_files(
    spark: SparkSession, path: str, streaming: bool = True, max_files: int = 1000
) -> DataFrame:
    """A feed from files of one JSON event (or array of events) per line."""
    if streaming:
        return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed(
            "value", "payload"
        )
    return spark.read.text(path).withColumnRenamed("value", "payload")


def read_feeds(sources: list[DataFrame]) -> DataFrame:
    """The same feed from several clusters."""
    return reduce(DataFrame.unionByName, sources)


def decode(df: DataFrame, feed: str) -> DataFrame:
    """One message holds no, one or several events. Rows carry `position`, the event's place in its
    message, and the parsed event or `error` and `raw`."""
    text = F.trim("payload")
    single = F.array(text)
    many = F.from_json(text, "array<string>")
    parts = F.when(text.startswith("["), F.coalesce(many, single)).otherwise(single)
    rest = [c for c in df.columns if c != "payload"]
    exploded = df.select(*rest, F.posexplode(parts).alias("position", "payload"))
    return PARSERS[feed](exploded)


def read_log(
    spark: SparkSession, path: str, schema: str, streaming: bool = True, max_files: int = 1000
) -> DataFrame:
    """A log table (messages, checkpoints). As a stream it goes on from the query's checkpoint;
    without one, or with a new one, it starts again from the beginning."""
    if streaming:
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
        return reader.parquet(path)
    return spark.read.schema(schema).parquet(path)


def received(df: DataFrame, clock: Column) -> DataFrame:
    """Receipt time of heartbeats from an explicit clock."""
    return df.withColumn("received_at", clock)
