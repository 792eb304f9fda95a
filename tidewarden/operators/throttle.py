"""The "do not repeat yourself" rules: greedy throttle, session throttle, rising edge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import OrderedRows, _column
from .segments import (
    HOT, SEG, Cuts, broadcast_under, find_cuts, materialize, position, same_keys,
)

_HELPERS = ("_first", "_pos", "_gap", "_from")


def _fire(pos: np.ndarray, gap: int, last: int | None, strict: bool) -> tuple[list[int], int | None]:
    """Row numbers that fire in one sorted run, jumping from each fired row to the next one."""
    fired, at, side = [], 0, "right" if strict else "left"
    while True:
        if last is not None:
            at += int(np.searchsorted(pos[at:], last + gap, side))
        if at >= len(pos):
            return fired, last
        fired.append(at)
        last = int(pos[at])
        at += 1


def _fired_rows(strict: bool):
    """mapInArrow body over rows sorted by key and time; the state is one number per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, gap = None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            names = batch.schema.names
            pos = batch.column(names.index("_pos")).to_numpy(zero_copy_only=False)
            gaps = batch.column(names.index("_gap")).to_numpy(zero_copy_only=False)
            first = batch.column(names.index("_first")).to_numpy(zero_copy_only=False)
            begin = batch.column(names.index("_from"))
            keep = np.zeros(n, dtype=bool)
            starts = np.flatnonzero(first)
            bounds = [0, *[s for s in starts.tolist() if s > 0], n]
            for a, b in zip(bounds, bounds[1:]):
                if first[a]:
                    last, gap = begin[a].as_py(), int(gaps[a])
                fired, last = _fire(pos[a:b], gap, last, strict)
                keep[[a + i for i in fired]] = True
            kept = [i for i, name in enumerate(names) if name not in _HELPERS]
            yield batch.select(kept).filter(pa.array(keep))

    return run


def _segment_entries(strict: bool):
    """One hot segment: the instants at which a chain of fired rows may enter it, and for each the last instant of
    that chain within the segment."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pos = np.sort(pdf["_pos"].to_numpy())
        gap, side = int(pdf["_gap"].iloc[0]), "right" if strict else "left"
        # what fired last lies before the segment, so the first row to fire is among the rows of one gap
        reach = int(np.searchsorted(pos, pos[0] + gap, side)) + 1
        entries = pos[: min(reach, len(pos))]
        chain = entries.copy()
        live = np.ones(len(chain), dtype=bool)
        while live.any():
            values, back = np.unique(chain[live], return_inverse=True)
            nxt = np.searchsorted(pos, values + gap, side)
            if not strict:
                nxt = np.maximum(nxt, np.searchsorted(pos, values, "right"))
            ended = nxt >= len(pos)
            values = np.where(ended, values, pos[np.minimum(nxt, len(pos) - 1)])
            where = np.flatnonzero(live)
            chain[where] = values[back]
            live[where[ended[back]]] = False
        first = pdf.iloc[0]
        return pd.DataFrame({"_id": first["_id"], SEG: first[SEG], "_pos": entries, "_gap": gap, "_exit": chain})

    return run


def _successors(points: DataFrame, asked: DataFrame) -> DataFrame:
    """For each of `asked` (_id, _after) the smallest _pos of `points` (_id, _pos) that is larger, as _next; those
    without one are left out. Points and questions are dealt out together by ranges, in falling order, and every question
    takes the last point before it: from its own range or, by a table of one row per range, from an earlier one."""
    back = -F.col("_pos")
    rows = points.select("_id", back.alias("_back"), F.lit(False).alias("_asks"), F.lit(None).cast("long").alias("_after"))
    questions = asked.select("_id", (-F.col("_after")).alias("_back"), F.lit(True).alias("_asks"), "_after")
    order = ["_id", "_back", F.desc("_asks")]  # a question comes before the point it names, so it finds larger ones
    both = rows.unionByName(questions).repartitionByRange(*order)
    both = materialize(both.withColumn("_range", F.spark_partition_id()))
    point = F.when(~F.col("_asks"), F.struct("_id", "_back"))
    ends = both.groupBy("_range").agg(F.max(point).alias("_end"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ends = ends.select("_range", F.max("_end").over(earlier).alias("_before"))
    so_far = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last(point, True).over(so_far)).filter("_asks").join(F.broadcast(ends), "_range")
    found = found.withColumn("_found", F.coalesce("_own", "_before")).filter("_found._id = _id")
    return found.select("_id", "_after", (-F.col("_found._back")).alias("_next"))


def _orbits(points: DataFrame, jumps: DataFrame) -> DataFrame:
    """The points that are reached from the first one of each _id by jumps (_id, _pos, _next). Every round doubles the
    length of all jumps and the number of points reached, so a chain of n takes log n rounds."""
    reached = materialize(points.groupBy("_id").agg(F.min("_pos").alias("_pos")))
    jumps = materialize(jumps)
    while True:
        ahead = materialize(reached.join(jumps, ["_id", "_pos"]).select("_id", F.col("_next").alias("_pos")))
        if ahead.isEmpty():
            return reached
        reached = reached.unionByName(ahead)  # of checkpoints, one for each round
        onward = jumps.select("_id", F.col("_pos").alias("_next"), F.col("_next").alias("_far"))
        jumps = materialize(jumps.join(onward, ["_id", "_next"]).select("_id", "_pos", F.col("_far").alias("_next")))


def greedy_throttle(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    gap: Column,
    strict: bool = True,
    start: Column | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Rows that fire: the first of a key, then the first one more than `gap` microseconds after
    the last fired one (`strict=False`: at least `gap` after). `start` presets the last fired
    instant. `gap` and `start` must be constant within a key. Returns the fired rows only.

    One shuffle on the key and one streaming pass in Arrow batches. A hot key is cut into segments. Within
    a segment, each instant at which a chain of fired rows may enter is led to the chain's last instant
    there; a merge of ranges finds the instant at which that chain enters a later segment; doubling those
    jumps gives the segments that are really entered, and where; and then all segments are resolved in
    parallel. All of it is narrow rows: no row or group is larger than a segment, however long the gap is.
    """
    cuts = cuts or find_cuts(df, keys, order)
    start = F.lit(None).cast("long") if start is None else start
    base, columns = cuts.mark(df, order), df.columns
    cold = base.filter(~F.col(HOT)) if cuts.split else base
    fired = _fire_cold(cold, df, keys, order, gap, start, strict, columns)
    if not cuts.split:
        return fired
    return fired.unionByName(
        _fire_hot(base.filter(HOT), df, keys, order, gap, start, strict, columns)
    )


def _fire_cold(rows, df, keys, order, gap, start, strict, columns) -> DataFrame:
    by_key = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.select(
        *columns,
        (F.row_number().over(by_key) == 1).alias("_first"),
        position(df, order[0]).alias("_pos"),
        gap.cast("long").alias("_gap"),
        start.alias("_from"),
    ).sortWithinPartitions(*keys, *order)
    return marked.mapInArrow(_fired_rows(strict), rows.select(*columns).schema)


def _fire_hot(rows, df, keys, order, gap, start, strict, columns) -> DataFrame:
    pos = position(df, order[0])
    placed = rows.select(*keys, SEG, pos.alias("_pos"), gap.cast("long").alias("_gap"), start.alias("_start"))
    clear = F.col("_start") + F.col("_gap") - F.lit(0 if strict else 1)
    placed = placed.filter(F.col("_start").isNull() | (F.col("_pos") > clear))  # the others cannot fire
    placed = materialize(placed.groupBy(*keys, SEG, "_pos").agg(F.first("_gap").alias("_gap")))
    ids = materialize(placed.select(*[F.col(k).alias("_k_" + k) for k in keys]).distinct())
    ids = broadcast_under(ids.withColumn("_id", F.monotonically_increasing_id()))
    instants = placed.join(ids, same_keys(placed, ids, keys, "_k_")).select("_id", SEG, "_pos", "_gap")

    entry_schema = f"_id long, {SEG} int, _pos long, _gap long, _exit long"
    entries = instants.groupBy("_id", SEG).applyInPandas(_segment_entries(strict), entry_schema)
    # an instant that is cut into several segments is entered in the first of them
    first = F.min(F.struct(SEG, "_gap", "_exit")).alias("_first")
    points = materialize(entries.groupBy("_id", "_pos").agg(first).select("_id", "_pos", "_first.*"))
    after = F.col("_exit") + F.col("_gap")
    after = after if strict else F.greatest(after - 1, F.col("_exit"))
    points = points.withColumn("_after", after)
    found = _successors(points, points.select("_id", "_after").distinct())
    jumps = points.select("_id", "_pos", "_after").join(found, ["_id", "_after"]).select("_id", "_pos", "_next")
    entered = _orbits(points, jumps).join(points, ["_id", "_pos"]).select("_id", SEG, F.col("_pos").alias("_entry"))

    by_seg = Window.partitionBy("_id", SEG).orderBy("_pos")
    marked = (
        instants.join(entered, ["_id", SEG])
        .filter("_pos >= _entry")
        .select(
            "_id",
            "_pos",
            "_gap",
            F.lit(None).cast("long").alias("_from"),
            (F.row_number().over(by_seg) == 1).alias("_first"),
            F.col("_pos").alias("_at"),
            SEG,
        )
        .sortWithinPartitions("_id", SEG, "_pos")
    )
    fired = marked.mapInArrow(_fired_rows(strict), f"_id long, _at long, {SEG} int")
    fired = fired.select("_id", "_at").join(ids, "_id").drop("_id")
    at_fired = rows.withColumn("_pos", pos).join(
        fired,
        same_keys(rows, fired, keys, "_k_") & (F.col("_pos") == F.col("_at")),
        "inner",
    )
    whole = F.struct(*columns)
    return (
        at_fired.groupBy(*[F.col(k).alias("_g_" + k) for k in keys], "_pos")
        .agg(F.min_by(whole, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def session_throttle(
    df: DataFrame, keys: list[str], order: list[str], gap_micros: int, cuts: Cuts | None = None
) -> DataFrame:
    """Rows seen at least `gap` after the previous sighting of the key, fired or not."""
    pos = position(df, order[0])
    rows = OrderedRows(df, keys, order, cuts).with_columns(_pos=pos).previous(_seen=F.col("_pos"))
    quiet = F.col("_seen").isNull() | (F.col("_seen") + F.lit(gap_micros) <= F.col("_pos"))
    return rows.df.filter(quiet).drop("_pos", "_seen")


def edge_trigger(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    failing: Column | str,
    cuts: Cuts | None = None,
) -> DataFrame:
    """`action` = trigger when `failing` turns true, resolve when it turns false; nothing between."""
    rows = OrderedRows(df.withColumn("_failing", _column(failing)), keys, order, cuts)
    rows = rows.previous(_failed=F.col("_failing"))
    was = F.coalesce("_failed", F.lit(False))
    action = F.when(F.col("_failing") & ~was, "trigger").when(~F.col("_failing") & was, "resolve")
    return (
        rows.df.withColumn("action", action)
        .filter(F.col("action").isNotNull())
        .drop("_failing", "_failed")
    )
