"""Splitting of hot keys for per-key ordered work.

A window partitioned by key sends all rows of a key to one task. When a key holds a large share
of the table that task is the whole job. `find_cuts` finds such keys and cuts each of them into
consecutive segments of about `rows_per_segment` rows, by instant and, within an instant, by the
tie-break column; `Cuts.mark` adds the segment number. Callers then work on (key, segment) and carry
a small summary from one segment of a key to the next.

A key is hot when it has more than `rows_per_segment` rows, and gets as many segments as its rows ask
for; neither number has a ceiling. Cut points come from a sample with `SAMPLES` rows per segment, chosen
by a hash of the row's place, so a second look at the same data finds the same ones. They are a table of
their own, checkpointed and never collected: it is broadcast, as one sorted array per key that rows search
by halving, when its measured bytes are under `broadcast_bytes`; beyond that the cut points are sorted in
among the rows and the last one is carried forward.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ROWS_CONF = "spark.tidewarden.rowsPerSegment"
BROADCAST_CONF = "spark.tidewarden.broadcastBytes"
DEFAULT_ROWS = 2_000_000
DEFAULT_BROADCAST = 64 * 1024 * 1024
SAMPLES = 32
_FIRST, _LAST = -(2**63), 2**63 - 1

SEG = "_seg"
HOT = "_hot"


@dataclass(frozen=True)
class Cuts:
    """Cut points of the hot keys of a table (`_k_<key>`, `_pos`, `_tie`); `frame` is None when there are
    none. `segments` is the largest number of segments of a key.

    A segment is a function of key, instant and (where one instant alone is too large) the
    tie-break column `tie`, so the cuts found for a table serve every table derived from it by
    dropping rows, and save looking for hot keys again at every step. A table ordered by another
    tie-break keeps all rows of an instant together."""

    keys: list[str]
    frame: DataFrame | None
    segments: int = 0
    tie: str | None = None

    @property
    def split(self) -> bool:
        return self.frame is not None

    def mark(self, df: DataFrame, order: list[str]) -> DataFrame:
        """Add `_seg` (0 for ordinary keys) and `_hot`."""
        if self.frame is None:
            return df
        tied = self.tie is not None and order[1:2] == [self.tie]
        tie = position(df, self.tie) if tied else F.lit(_LAST)
        at = F.struct(position(df, order[0]).alias("pos"), tie.alias("tie"))
        if stored_bytes(self.frame) <= broadcast_bytes(df):
            return self._search(df, at)
        return self._carry(df, at)

    def _search(self, df: DataFrame, at: Column) -> DataFrame:
        names = ["_k_" + k for k in self.keys]
        points = F.sort_array(F.collect_list(F.struct(F.col("_pos").alias("pos"), F.col("_tie").alias("tie"))))
        lists = self.frame.groupBy(*names).agg(points.alias("_cuts"))
        halves = F.array(*[F.lit(1 << i) for i in range(max(self.segments, 1).bit_length() - 1, -1, -1)])

        def step(passed: Column, half: Column) -> Column:
            # passed cut points lie at or before the row; go on by `half` if that one does too
            return F.when(F.coalesce(F.get("_cuts", passed + half - 1) <= at, F.lit(False)), passed + half).otherwise(passed)

        seg = F.when(F.col("_cuts").isNull(), 0).otherwise(F.aggregate(halves, F.lit(0), step))
        same = same_keys(df, lists, self.keys, "_k_")
        return df.join(F.broadcast(lists), same, "left").select(
            *df.columns, seg.alias(SEG), F.col("_cuts").isNotNull().alias(HOT)
        )

    def _carry(self, df: DataFrame, at: Column) -> DataFrame:
        """Cut points and rows in one order, dealt out by ranges; each row takes the number of the last cut
        point before it, from its own range or from the last range that has one."""
        names = ["_k_" + k for k in self.keys]
        numbered = self.frame.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy("_pos", "_tie")))
        start = self.frame.select(*names).distinct().select(
            *names, F.lit(_FIRST).alias("_pos"), F.lit(_FIRST).alias("_tie"), F.lit(0).alias("_n")
        )
        place = F.struct("_pos", "_tie").cast("struct<pos:bigint,tie:bigint>").alias("_at")
        points = numbered.unionByName(start).select(*names, place, "_n", F.lit(False).alias("_is_row"))
        rows = df.select(
            *[F.col(k).alias("_k_" + k) for k in self.keys], at.alias("_at"), F.lit(True).alias("_is_row"),
            F.struct(*df.columns).alias("_row"),
        )
        order = [*names, "_at", "_is_row"]
        both = rows.unionByName(points, allowMissingColumns=True).repartitionByRange(*order)
        both = materialize(both.withColumn("_range", F.spark_partition_id()))
        cut = F.when(~F.col("_is_row"), F.struct(*names, "_n"))
        ends = both.filter(~F.col("_is_row")).groupBy("_range").agg(
            F.max_by(F.struct(*names, "_n"), F.struct(*names, "_at")).alias("_end")
        )
        ranges = both.select("_range").distinct().join(ends, "_range", "left")
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select("_range", F.last("_end", True).over(earlier).alias("_before"))
        so_far = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_own", F.last(cut, True).over(so_far)).filter("_is_row")
        found = found.join(F.broadcast(ranges), "_range").withColumn("_cut", F.coalesce("_own", "_before"))
        hot = F.col("_cut").isNotNull()
        for name in names:
            hot = hot & F.col(name).eqNullSafe(F.col(f"_cut.{name}"))
        return found.select("_row.*", F.when(hot, F.col("_cut._n")).otherwise(0).alias(SEG), hot.alias(HOT))


def broadcast_bytes(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BROADCAST_CONF, str(DEFAULT_BROADCAST)))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the values of a table, by reading it; for small tables that are checkpointed."""
    size = F.octet_length(F.to_json(F.struct("*"))) + 16
    return df.select(size.alias("_size")).agg(F.sum("_size")).first()[0] or 0


def position(df: DataFrame, column: str) -> Column:
    """An order column as a long: instants become microseconds since the epoch."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("long")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    """Null-safe equality of key columns, the right side's being renamed with `prefix`."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[prefix + key])
    return condition


def find_cuts(df: DataFrame, keys: list[str], order: list[str]) -> Cuts:
    """Cut points of the keys of `df` that are too large for one task, if there are any."""
    rows = int(df.sparkSession.conf.get(ROWS_CONF, str(DEFAULT_ROWS)))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0] or 0
    if largest <= rows:
        return Cuts(keys, None)

    names = ["_k_" + k for k in keys]
    renamed = [F.col(k).alias("_k_" + k) for k in keys]
    hot = broadcast_under(counts.filter(F.col("_n") > rows).select(*renamed))
    tie = order[1] if len(order) > 1 and _is_number(df.schema[order[1]].dataType) else None
    tied = position(df, tie) if tie is not None else F.lit(_FIRST)
    each = max(1, rows // SAMPLES)  # one row in so many is a sample
    chosen = F.pmod(F.xxhash64(*keys, *order[:2]), F.lit(each)) == 0
    placed = df.filter(chosen).select(*keys, position(df, order[0]).alias("_pos"), tied.alias("_tie"))
    samples = placed.join(hot, same_keys(placed, hot, keys, "_k_"), "inner").select(*names, "_pos", "_tie")
    number = F.row_number().over(Window.partitionBy(*names).orderBy("_pos", "_tie")) - 1
    segment = F.floor(number * F.lit(each) / F.lit(rows))
    starts = samples.withColumn("_s", segment).filter(F.col("_s") > 0)
    starts = starts.groupBy(*names, "_s").agg(F.min(F.struct("_pos", "_tie")).alias("_p"))
    frame = materialize(starts.select(*names, "_p._pos", "_p._tie").distinct())
    most = frame.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return Cuts(keys, frame if most else None, most + 1, tie)


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table by a reliable checkpoint in the session's shared folder.
    Only a local session may fall back to a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="tidewarden-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def broadcast_under(df: DataFrame) -> DataFrame:
    """A table that should be small, checkpointed and measured: with a broadcast hint when its bytes are
    under `broadcast_bytes`, else left to an ordinary join."""
    kept = materialize(df)
    return F.broadcast(kept) if stored_bytes(kept) <= broadcast_bytes(df) else kept
