"""Event-time windows over a stream: each window is given once, when the watermark has passed its end; rows that come
after that go to a table of their own instead of being dropped.

The watermark is the largest instant seen so far less the allowed delay. A micro-batch is held against the watermark of
the batch before it, as Structured Streaming does, and leaves four folders named by its id: the windows that it closes,
the late rows, the partial aggregates of the windows that are still open, and its watermark. The next batch reads the
last two. So what is carried is bounded by the open windows, and a batch that runs again after a lost executor or a
restart reads and writes the same folders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.outbox import write_batch

Handler = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Windows:
    """Aggregates per window of `width` and keys. `partial` is computed from rows, `merge` from partial values of the
    same names, and `final` are the columns given besides window_start and the keys. Rows need `ts`; rows without one
    belong to no window and count as late."""

    keys: list[str]
    width: str
    delay: str
    partial: dict[str, Column]
    merge: dict[str, Column]
    final: list[Column]

    def over(self, rows: DataFrame) -> DataFrame:
        """The same windows over a whole table."""
        parts = self._merged(self._parts(rows.filter("ts IS NOT NULL").withColumn("_w", F.window("ts", self.width))))
        return self._given(parts)

    def _parts(self, rows: DataFrame) -> DataFrame:
        keyed = rows.groupBy(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *self.keys)
        return keyed.agg(*[value.alias(name) for name, value in self.partial.items()])

    def _merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("window_start", "window_end", *self.keys).agg(*[v.alias(n) for n, v in self.merge.items()])

    def _given(self, parts: DataFrame) -> DataFrame:
        return parts.select("window_start", *self.keys, *self.final)

    def handler(self, root: str) -> Handler:
        """foreachBatch handler that keeps `windows`, `late`, `open` and `watermark` below `root`."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            before = _value(_folder(spark, f"{root}/watermark", batch_id - 1))
            batch = batch.persist()
            try:
                rows = batch.filter("ts IS NOT NULL").withColumn("_w", F.window("ts", self.width))
                late = F.lit(False) if before is None else F.col("_w.end") <= F.lit(before)
                write_batch(batch.filter("ts IS NULL").unionByName(rows.filter(late).drop("_w")), f"{root}/late", batch_id)
                newest = rows.agg((F.max("ts") - F.expr(f"INTERVAL {self.delay}")).alias("at")).first()["at"]
                marks = [m for m in (before, newest) if m is not None]
                mark = max(marks) if marks else None

                parts = self._parts(rows.filter(~late))
                carried = _folder(spark, f"{root}/open", batch_id - 1)
                both = self._merged(parts if carried is None else parts.unionByName(carried)).persist()
                try:
                    done = F.lit(False) if mark is None else F.col("window_end") <= F.lit(mark)
                    write_batch(self._given(both.filter(done)), f"{root}/windows", batch_id)
                    write_batch(both.filter(~done), f"{root}/open", batch_id)
                finally:
                    both.unpersist()
                write_batch(spark.createDataFrame([(mark,)], "at timestamp").coalesce(1), f"{root}/watermark", batch_id)
            finally:
                batch.unpersist()

        return handle


def _folder(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/batch={batch_id}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _value(marks: DataFrame | None):
    return None if marks is None else marks.first()["at"]


def alert_windows(width: str = "5 minutes", delay: str = "10 minutes") -> Windows:
    """Repeated alerts collapsed per window, description and exception, as `events.alert_aggregate` does for a table.
    Rows: ts, arrival, description, exception, sample."""
    first = F.min(F.struct("ts", "arrival", "sample"))
    return Windows(
        ["description", "exception"], width, delay,
        {"n": F.count(F.lit(1)), "first": first}, {"n": F.sum("n"), "first": F.min("first")},
        [F.col("n"), F.col("first.sample").alias("first_sample")],
    )


def rate_windows(dims: list[str], width: str = "1 hour", delay: str = "10 minutes") -> Windows:
    """Sums of metric values per window, metric and dims, as `events.event_rate` does for a table; see `rate_rows`."""
    return Windows(["metric", *dims], width, delay, {"value": F.sum("value")}, {"value": F.sum("value")}, [F.col("value")])


def rate_rows(metrics: DataFrame, dims: list[str]) -> DataFrame:
    """Metrics (created, metric, value, dims) as rows for `rate_windows`."""
    return metrics.select(F.col("created").alias("ts"), "metric", *[F.col("dims")[d][0].alias(d) for d in dims], "value")
