"""Places of rows in a global order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.segments import materialize


def ranked(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """rows with `pos`, the place (from 0) within its group by `order`, and `n`, the rows of the group. Group columns
    hold no nulls; nulls in `order` come first; rows that agree in all columns of both take their places in any order.
    The columns `_range`, `_uid` and `_own` are not allowed.

    Rows are dealt out by ranges of (group, order) and a number that tells equal rows apart, so neither a hot group
    nor a row that stands very often is one task. A range holds part of a group only at its borders; what lies
    before comes from counts per range and group, which are joined back."""
    rows = materialize(rows).withColumn("_uid", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*groups, *order, "_uid").withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt)
    counts = dealt.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_own"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *groups, "_range", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"), F.sum("_own").over(whole).alias("n")
    )
    place = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order, "_uid"))
    placed = dealt.withColumn("_place", place).join(counts, [*groups, "_range"])
    return placed.select(*[c for c in rows.columns if c != "_uid"], (F.col("_before") + F.col("_place") - 1).alias("pos"), "n")
