"""From conditions to trigger and resolve actions: one operator, several policies.

Input rows: key columns, `ts`, a tie-break, `failing`, `pager_key`. Output: the input columns plus
`action`. A row without a pager key emits nothing but still moves the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import shift
from .ordered import OrderedRows
from .segments import find_cuts
from .throttle import edge_trigger, greedy_throttle


def incident_key(kind: str, *parts: Column | str) -> Column:
    return F.concat_ws("/", F.lit(kind), *[F.col(p) if isinstance(p, str) else p for p in parts])


def _paged(df: DataFrame) -> DataFrame:
    return df.filter(F.col("pager_key").isNotNull())


def every_failing(
    df: DataFrame, keys: list[str], order: list[str], flag_needs_key: bool = False
) -> DataFrame:
    """Trigger at every failing row, resolve at the first good one after.
    `flag_needs_key`: only a trigger that was sent can be resolved."""
    columns = df.columns
    rows = OrderedRows(df, keys, order)
    if flag_needs_key:
        has_key = F.col("pager_key").isNotNull()
        rows = rows.last_known(_failed=F.when(has_key, F.col("failing")))
    else:
        rows = rows.previous(_failed=F.col("failing"))
    action = F.when(F.col("failing"), "trigger").when(F.col("_failed"), "resolve")
    out = rows.df.select(*columns, action.alias("action")).filter(F.col("action").isNotNull())
    return _paged(out)


def rising_edge(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _paged(edge_trigger(df, keys, order, "failing"))


def throttled(df: DataFrame, keys: list[str], order: list[str], gap_micros: int) -> DataFrame:
    """Greedy throttle over the failing rows; the first good row after a fired one resolves.
    A resolve does not reset the throttle clock, so a relapse within it stays silent.
    Rows without a pager key come out with `action` alert in place of trigger, and resolve nothing."""
    columns = df.columns
    cuts = find_cuts(df, keys, order)
    fired = greedy_throttle(df.filter("failing"), keys, order, F.lit(gap_micros), cuts=cuts)
    seen = fired.unionByName(df.filter(~F.col("failing")))
    rows = OrderedRows(seen, keys, order, cuts).previous(_failed=F.col("failing"))
    has_key = F.col("pager_key").isNotNull()
    action = F.when(F.col("failing"), F.when(has_key, "trigger").otherwise("alert"))
    action = action.when(F.col("_failed") & has_key, "resolve")
    return rows.df.select(*columns, action.alias("action")).filter(F.col("action").isNotNull())


def backlog_pager(df: DataFrame, keys: list[str], order: list[str], gap_micros: int) -> DataFrame:
    """Pages for pipes whose earliest work is older than their period, greedily throttled within
    one spell of lateness; the first row back in range resolves. Rows: min_time, period_ms
    (0 = disabled)."""
    columns = df.columns
    edge = shift("ts", -F.col("period_ms"))
    oldest = F.coalesce("min_time", "ts")
    late = (F.col("period_ms") != 0) & (oldest < edge)
    state = df.withColumn("_late", F.when(late, True).when(oldest >= edge, False))
    state = state.filter(F.col("_late").isNotNull())
    cuts = find_cuts(df, keys, order)
    rows = OrderedRows(state, keys, order, cuts)
    spells = rows.running(_spell=F.when(F.col("_late"), 0).otherwise(1).cast("long"))
    pages = greedy_throttle(
        spells.df.filter("_late"), [*keys, "_spell"], order, F.lit(gap_micros), cuts=cuts
    ).select(*columns, F.lit("trigger").alias("action"))
    back = rows.previous(_was=F.col("_late")).df.filter(~F.col("_late") & F.col("_was"))
    resolves = back.select(*columns, F.lit("resolve").alias("action"))
    return _paged(pages.unionByName(resolves))


def failed_job_pager(probes: DataFrame, failed: DataFrame) -> DataFrame:
    """Pages for failed jobs per environment.

    `probes`: env, ts, one row per probe. `failed`: env, job, ts, throttle_ms, pager_key. The first
    sighting is only noted, the second pages, later ones page again once more than the throttle has
    passed since the last page; throttle 0 never pages. A job that is missing from the next probe
    is resolved if it was paged, and forgotten. A `log` of the failed jobs goes along with the trigger."""
    numbered = OrderedRows(probes.select("env", "ts").distinct(), ["env"], ["ts"])
    numbered = numbered.running(seq=F.lit(1).cast("long")).df
    jobs = ["env", "job"]
    cuts = find_cuts(failed, jobs, ["ts"])
    rows = OrderedRows(failed.join(numbered, ["env", "ts"], "inner"), jobs, ["ts"], cuts)
    rows = rows.previous(_before=F.col("seq"))
    fresh = F.col("_before").isNull() | (F.col("_before") != F.col("seq") - 1)
    spells = rows.last_known(inclusive=True, _spell=F.when(fresh, F.col("seq"))).df
    again = spells.filter((F.col("seq") > F.col("_spell")) & (F.col("throttle_ms") > 0))
    pages = greedy_throttle(
        again, [*jobs, "_spell"], ["ts"], F.col("throttle_ms") * F.lit(1000), cuts=cuts
    )
    ends = spells.groupBy(*jobs, "_spell").agg(
        (F.max("seq") + 1).alias("seq"),
        F.max("pager_key").alias("pager_key"),
        (F.max("throttle_ms") > 0).alias("_pages"),
        F.count(F.lit(1)).alias("_sightings"),
    )
    gone = ends.filter(F.col("_pages") & (F.col("_sightings") > 1)).join(
        numbered, ["env", "seq"], "inner"
    )
    log = ["log"] if "log" in failed.columns else []
    out = pages.select("env", "job", "ts", "pager_key", F.lit("trigger").alias("action"), *log)
    out = out.unionByName(
        gone.select("env", "job", "ts", "pager_key", F.lit("resolve").alias("action")),
        allowMissingColumns=True,
    )
    return _paged(out).withColumn("incident_key", incident_key("pipes/failed", "env", "job"))


def pager_events(df: DataFrame, direct_ok: Column | None) -> DataFrame:
    """Pager events of actions. A page sent directly leaves an event for the books with
    page = false; without a direct route, or when it failed, the event asks for the page."""
    page = F.lit(True) if direct_ok is None else ~F.coalesce(direct_ok, F.lit(False))
    return df.withColumn("page", page)


def guardian_unavailable(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows env, ts, located, pager_key: page while the service cannot be located."""
    return every_failing(
        df.withColumn("failing", ~F.col("located")), keys, order, flag_needs_key=True
    )

