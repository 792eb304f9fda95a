"""Current state and trimmed history per track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HISTORY_SIZE = 10
ARRIVAL = ("received_at", "cluster", "partition", "arrival", "position")


def latest_status(df: DataFrame) -> DataFrame:
    """The newest status per track; among equal timestamps the earliest arrival stays, in the order of
    `ARRIVAL` as far as the table has those columns. An aggregate, so each task sends one row per track and a
    hot track costs nothing extra; a filter on the track goes below it."""
    rest = [c for c in df.columns if c != "track"]
    newest = F.struct(-F.unix_micros("ts"), *[c for c in ARRIVAL if c in df.columns])
    found = df.groupBy("track").agg(F.min_by(F.struct(*rest), newest).alias("_row"))
    return found.select(*["track" if c == "track" else F.col(f"_row.{c}").alias(c) for c in df.columns])


def status_history(df: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """Statuses no older than the n-th newest of their track, ties at the cut included. One scan: each task
    passes on no more than n ranks of a track."""
    newest = Window.partitionBy("track").orderBy(F.col("ts").desc())
    return df.withColumn("_n", F.rank().over(newest)).filter(F.col("_n") <= n).drop("_n")


def status_by_tag(df: DataFrame, tag: str, value: str) -> DataFrame:
    return df.filter(F.element_at("tags", F.lit(tag)) == F.lit(value))


def _literal(track: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in track])


def status_by_track(df: DataFrame, track: list[str]) -> DataFrame:
    """First elements equal and all given elements contained, in any order."""
    contained = F.size(F.array_except(_literal(track), F.col("track"))) == 0
    return df.filter((F.get("track", F.lit(0)) == F.lit(track[0])) & contained)


def all_tracks(df: DataFrame) -> DataFrame:
    path = F.array_join("track", "/").alias("path")
    return df.select("track").distinct().select("track", path).orderBy("path")


def track_history(df: DataFrame, track: list[str], n: int) -> DataFrame:
    """The newest n statuses of exactly this track."""
    return (
        df.filter(F.col("track") == _literal(track))
        .orderBy(F.col("ts").desc(), F.col("arrival").desc())
        .limit(n)
    )


def one_status(df: DataFrame, track: list[str]) -> DataFrame:
    return status_by_track(df, track).orderBy(F.array_join("track", "/")).limit(1)


def upsert(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Current state after a batch: an older event never replaces a newer one."""
    return latest_status(current.unionByName(batch))


def append_history(history: DataFrame, batch: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """History after a batch: every event enters, then each track is trimmed."""
    return status_history(history.unionByName(batch), n)
