"""Look-back, look-ahead, last-known-value and running totals per key, safe for hot keys.

Ordinary keys use one window. When `find_cuts` cut a key, the window runs per (key, segment)
and the value that crosses a segment border comes from a summary with one row per segment. Each
summary is checkpointed, so a chain of steps stays one shuffle of the rows plus one pass over the
hot rows per step, instead of recomputing all earlier summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .segments import HOT, SEG, Cuts, broadcast_under, find_cuts, materialize


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


class OrderedRows:
    """Rows of `df` in ascending `order` within `keys`. `order` must identify a row of a key.
    `cuts` are those of a table this one was derived from; without them they are looked for."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], cuts: Cuts | None = None):
        cuts = cuts or find_cuts(df, keys, order)
        self._df, self.cuts = cuts.mark(df, order), cuts
        self.keys, self.order = list(keys), list(order)

    def _with(self, df: DataFrame) -> "OrderedRows":
        other = object.__new__(OrderedRows)
        other._df, other.cuts, other.keys, other.order = df, self.cuts, self.keys, self.order
        return other

    @property
    def split(self) -> bool:
        return self.cuts.split

    @property
    def df(self) -> DataFrame:
        return self._df.drop(SEG, HOT) if self.split else self._df

    @property
    def _window(self):
        parts = self.keys + ([HOT, SEG] if self.split else [])
        return Window.partitionBy(*parts).orderBy(*self.order)

    @property
    def _order_struct(self) -> Column:
        return F.struct(*self.order)

    def select(self, *columns) -> "OrderedRows":
        """Project, keeping what later steps need."""
        extra = [SEG, HOT] if self.split else []
        return self._with(self._df.select(*columns, *extra))

    def with_columns(self, **columns: Column) -> "OrderedRows":
        return self._with(self._df.withColumns(columns))

    def _segment_summary(self, *aggregates: Column) -> DataFrame:
        return self._df.filter(HOT).groupBy(*self.keys, SEG).agg(*aggregates)

    def _join_carry(self, df: DataFrame, carry: DataFrame, names: list[str]) -> DataFrame:
        on = self.keys + [SEG]
        renamed = carry.select(
            *[F.col(c).alias("_c_" + c) for c in on], *[F.col(n) for n in names]
        )
        renamed = broadcast_under(renamed)
        condition = F.col(HOT)
        for c in on:
            condition = condition & df[c].eqNullSafe(renamed["_c_" + c])
        return df.join(renamed, condition, "left").drop(*["_c_" + c for c in on])

    def _neighbour(self, exprs: dict, back: bool) -> "OrderedRows":
        value = F.struct(*[_column(e).alias(n) for n, e in exprs.items()])
        shift = F.lag if back else F.lead
        df = self._df.withColumn("_near", shift(value).over(self._window))
        near = F.col("_near")
        if self.split:
            pick = F.max_by if back else F.min_by
            summary = self._segment_summary(pick(value, self._order_struct).alias("_edge"))
            by_key = Window.partitionBy(*self.keys).orderBy(SEG)
            carry = summary.withColumn("_carry", shift("_edge").over(by_key))
            df = self._join_carry(df, carry, ["_carry"])
            near = F.coalesce(near, F.col("_carry"))
        kept = [c for c in self._df.columns if c not in exprs]
        return self._with(df.select(*kept, *[near[n].alias(n) for n in exprs]))

    def previous(self, **exprs: Column | str) -> "OrderedRows":
        """Values of the row before, null on a key's first row."""
        return self._neighbour(exprs, back=True)

    def following(self, **exprs: Column | str) -> "OrderedRows":
        """Values of the row after, null on a key's last row."""
        return self._neighbour(exprs, back=False)

    def last_known(self, inclusive: bool = False, **exprs: Column | str) -> "OrderedRows":
        """Latest non-null value of each expression, up to the row before (or this row)."""
        frame = self._window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        kept = [c for c in self._df.columns if c not in exprs]
        inner = {n: F.last(_column(e), ignorenulls=True).over(frame) for n, e in exprs.items()}
        if not self.split:
            return self._with(
                self._df.select(*kept, *[c.alias(n) for n, c in inner.items()])
            )
        df = self._df.select("*", *[c.alias("_in_" + n) for n, c in inner.items()])
        summary = self._segment_summary(
            *[
                F.max_by(_column(e), F.when(_column(e).isNotNull(), self._order_struct)).alias(
                    "_s_" + n
                )
                for n, e in exprs.items()
            ]
        )
        before = Window.partitionBy(*self.keys).orderBy(SEG).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = summary.select(
            *self.keys,
            SEG,
            *[F.last("_s_" + n, ignorenulls=True).over(before).alias("_c_" + n) for n in exprs],
        )
        df = self._join_carry(df, carry, ["_c_" + n for n in exprs])
        return self._with(
            df.select(
                *kept, *[F.coalesce("_in_" + n, "_c_" + n).alias(n) for n in exprs]
            )
        )

    def running(self, **exprs: Column | str) -> "OrderedRows":
        """Running total of each expression including this row; running(n=F.lit(1)) numbers rows."""
        frame = self._window.rowsBetween(Window.unboundedPreceding, 0)
        kept = [c for c in self._df.columns if c not in exprs]
        inner = {n: F.sum(_column(e)).over(frame) for n, e in exprs.items()}
        if not self.split:
            return self._with(
                self._df.select(*kept, *[c.alias(n) for n, c in inner.items()])
            )
        df = self._df.select("*", *[c.alias("_in_" + n) for n, c in inner.items()])
        summary = self._segment_summary(
            *[F.sum(_column(e)).alias("_s_" + n) for n, e in exprs.items()]
        )
        before = Window.partitionBy(*self.keys).orderBy(SEG).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = summary.select(
            *self.keys, SEG, *[F.sum("_s_" + n).over(before).alias("_c_" + n) for n in exprs]
        )
        df = self._join_carry(df, carry, ["_c_" + n for n in exprs])
        total = {
            n: F.coalesce("_in_" + n, F.lit(0)) + F.coalesce("_c_" + n, F.lit(0)) for n in exprs
        }
        return self._with(df.select(*kept, *[c.alias(n) for n, c in total.items()]))

    def recent(self, n: int, **exprs: Column | str) -> "OrderedRows":
        """Arrays of the last n values up to this row, the oldest first, nulls included. One window whatever n is;
        between segments only the last n - 1 values of a segment are passed on."""
        kept = [c for c in self._df.columns if c not in exprs]
        value = F.struct(*[_column(e).alias(name) for name, e in exprs.items()])
        held = F.collect_list(value).over(self._window.rowsBetween(1 - n, 0))
        df = self._df.select("*", held.alias("_held"))
        values = F.col("_held")
        if self.split and n > 1:
            df = self._join_carry(df, self._tails(value, n - 1), ["_tail"])
            both = F.when(F.col("_tail").isNull(), F.col("_held")).otherwise(F.concat("_tail", "_held"))
            values = F.slice(both, F.greatest(F.size(both) - n, F.lit(0)) + 1, F.lit(n))
        return self._with(df.select(*kept, *[values[name].alias(name) for name in exprs]))

    def _tails(self, value: Column, n: int) -> DataFrame:
        """For each hot segment the last n values before it, from as many segments as they may lie in."""
        back = Window.partitionBy(*self.keys, SEG).orderBy(*[F.col(c).desc() for c in self.order])
        last = self._df.filter(HOT).select(*self.keys, SEG, self._order_struct.alias("_o"), value.alias("_v"), F.row_number().over(back).alias("_n"))
        own = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"])
        ends = materialize(last.filter(F.col("_n") <= n).groupBy(*self.keys, SEG).agg(own.alias("_own"), F.count(F.lit(1)).alias("_rows")))
        least = ends.agg(F.min("_rows")).first()[0] or 1
        before = Window.partitionBy(*self.keys).orderBy(SEG).rowsBetween(-(-(-n // least)), -1)
        tail = F.flatten(F.collect_list("_own").over(before))
        return ends.select(*self.keys, SEG, F.slice(tail, F.greatest(F.size(tail) - n, F.lit(0)) + 1, F.lit(n)).alias("_tail"))

    def runs(self, **states: Column | str) -> "OrderedRows":
        """For each state its current run of equal consecutive values: `<name>_start`, the first
        order value of the run, and `<name>_length`, the rows of the run up to this one."""
        w = self._window
        frame = w.rowsBetween(Window.unboundedPreceding, 0)
        df = self._df.select("*", *[_column(e).alias("_s_" + n) for n, e in states.items()])
        df = df.select(
            "*",
            F.row_number().over(w).alias("_rn"),
            *[F.lag("_s_" + n).over(w).alias("_b_" + n) for n in states],
        )

        def at_change(n: str, value: str) -> Column:
            same = F.col("_s_" + n).eqNullSafe(F.col("_b_" + n))
            return F.last(F.when((F.col("_rn") == 1) | ~same, F.col(value)), True).over(frame)

        df = df.select(
            "*",
            *[at_change(n, "_rn").alias("_i_" + n) for n in states],
            *[at_change(n, self.order[0]).alias("_t_" + n) for n in states],
        )
        length = {n: (F.col("_rn") - F.col("_i_" + n) + 1).cast("long") for n in states}
        start = {n: F.col("_t_" + n) for n in states}
        if self.split:
            df = self._join_carry(df, self._run_carry(df, states, length), ["_c_" + n for n in states])
            for n in states:
                same = F.col("_s_" + n).eqNullSafe(F.col(f"_c_{n}.state"))
                goes_on = F.col("_c_" + n).isNotNull() & (F.col("_i_" + n) == 1) & same
                length[n] = F.when(goes_on, length[n] + F.col(f"_c_{n}.rows")).otherwise(length[n])
                start[n] = F.when(goes_on, F.col(f"_c_{n}.at")).otherwise(start[n])
        return self._with(
            df.select(
                *self._df.columns,
                *[start[n].alias(n + "_start") for n in states],
                *[length[n].alias(n + "_length") for n in states],
            )
        )

    def _run_carry(self, df: DataFrame, states: dict, length: dict) -> DataFrame:
        """The run that is open at the end of the segments before each segment. A segment that is
        one run, of the state the segment before ended in, prolongs that one's open run."""
        last = {
            n: F.struct(
                F.col("_s_" + n).alias("state"),
                length[n].alias("rows"),
                F.col("_t_" + n).alias("at"),
                (F.col("_i_" + n) == 1).alias("whole"),
            )
            for n in states
        }
        ends = (
            df.filter(HOT)
            .groupBy(*self.keys, SEG)
            .agg(
                *[F.max_by(last[n], self._order_struct).alias("_l_" + n) for n in states],
                *[F.min_by(F.struct("_s_" + n), self._order_struct).alias("_f_" + n) for n in states],
            )
        )
        by_key = Window.partitionBy(*self.keys).orderBy(SEG)
        for n in states:
            before = F.lag(F.struct(f"_l_{n}.state")).over(by_key)
            same = before["state"].eqNullSafe(F.col(f"_f_{n}._s_{n}"))
            prolongs = F.col(f"_l_{n}.whole") & before.isNotNull() & same
            ends = ends.withColumn("_new", F.when(prolongs, 0).otherwise(1))
            ends = ends.withColumn("_chain", F.sum("_new").over(by_key))
            in_chain = Window.partitionBy(*self.keys, "_chain").orderBy(SEG)
            so_far = in_chain.rowsBetween(Window.unboundedPreceding, 0)
            open_run = F.struct(
                F.col(f"_l_{n}.state").alias("state"),
                F.sum(f"_l_{n}.rows").over(so_far).alias("rows"),
                F.first(f"_l_{n}.at").over(so_far).alias("at"),
            )
            ends = ends.withColumn("_open", open_run).withColumn("_c_" + n, F.lag("_open").over(by_key))
        return ends
