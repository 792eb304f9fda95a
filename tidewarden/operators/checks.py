"""Verdicts of probes and scripted checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.window import Window

from ..functions.text import mask_user_info, trim_body
from ..functions.times import shift
from .ordered import OrderedRows
from .segments import Cuts, materialize

FAIL_COUNT = 3
RESOLVE_COUNT = 2
# Fetch errors a check may be told to ignore.
IGNORABLE_ERRORS = ("GlobalRequestTimeoutException", "NoBrokersAvailableException")


def due(defs: DataFrame, last_runs: DataFrame, now: Column) -> DataFrame:
    """Enabled definitions to run: no period, never run, or last run + period before now."""
    joined = defs.join(last_runs, ["group", "name"], "left")
    passed = shift("last_run", F.col("period_ms")) < now
    run = F.col("period_ms").isNull() | F.col("last_run").isNull() | passed
    return joined.filter(F.coalesce("enabled", F.lit(True)) & run)


def default_ok() -> Column:
    return F.coalesce(F.col("status_code") == 200, F.lit(False))


def success_range(status: Column | str) -> Column:
    """200 to 399, what the probes accept."""
    return (F.col(status) if isinstance(status, str) else status).between(200, 399)


def posted(status: Column | str) -> Column:
    """200 to 299, what a pager post needs."""
    return (F.col(status) if isinstance(status, str) else status).between(200, 299)


Predicate = Callable[[], tuple[Column, Column]]


def predicate(definition: str | dict | None, registry: dict[str, Callable[..., tuple[Column, Column]]]):
    """(ok, data) columns of a definition. Absent: status 200. Text: a SQL expression over
    status_code and body, a boolean or struct(ok, data). A dict names a registered builder by
    `type`; anything else raises ValueError, the caller's config error."""
    no_data = F.lit(None).cast("map<string,string>")
    if definition is None:
        return default_ok(), no_data
    if isinstance(definition, str):
        return F.coalesce(F.expr(definition).cast("boolean"), F.lit(False)), no_data
    kind = definition.get("type")
    if kind is None:
        raise ValueError("Missing predicate type")
    if kind not in registry:
        raise ValueError("Unknown predicate type")
    return registry[kind](**{k: v for k, v in definition.items() if k != "type"})


def expression_predicate(ok: str, data: str | None = None) -> tuple[Column, Column]:
    """Builder for `type: sql`: expressions for the verdict and for a string map of data."""
    found = F.expr(data) if data else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.expr(ok).cast("boolean"), F.lit(False)), found


def apply_predicate(results: DataFrame, ok: Column, data: Column) -> DataFrame:
    """Failed fetches are never ok."""
    fetched = F.col("error").isNull()
    return results.withColumns({"ok": fetched & ok, "data": F.when(fetched, data)})


class AnalysisError(ValueError):
    """The arguments of a check's table function do not fit."""


CheckFunction = Callable[[str], Iterable[tuple[str, bool, dict]]]


def default_check(payload: str) -> list[tuple[str, bool, dict]]:
    """The check used when a definition has none."""
    return [("default", True, {})]


def _results(function: CheckFunction, base: str, payload: str) -> list[tuple[str, bool, dict]]:
    try:
        found = list(function(payload))
    except Exception as problem:  # the check is user code; its failure is a result
        return [(base, False, {"error": str(problem)})]
    own = [(n, bool(ok), {k: str(v) for k, v in data.items()}) for n, ok, data in found]
    return [(base, True, {}), *own]


def check_table_function(function: CheckFunction = default_check):
    """A user's check as a polymorphic table function, to be registered with `spark.udtf.register` and used in SQL as
    `SELECT * FROM name(TABLE(inputs))` or, per row, `FROM inputs, LATERAL name(base, payload)`. Of a table it gives every
    column but payload and adds name, ok and data, as `run_checks` does; of two texts only the latter. A row on which
    the check raises gives one bad row, and leaves the others alone."""

    class Check:
        @staticmethod
        def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
            own = T.StructType.fromDDL("name string, ok boolean, data map<string,string>").fields
            if len(arguments) == 1 and arguments[0].isTable:
                given = arguments[0].dataType
                if not {"base", "payload"} <= set(given.names):
                    raise AnalysisError("the table needs the columns base and payload")
                return AnalyzeResult(T.StructType([f for f in given.fields if f.name != "payload"] + own))
            if len(arguments) != 2 or any(a.isTable for a in arguments):
                raise AnalysisError("give a table, or base and payload")
            return AnalyzeResult(T.StructType(own))

        def eval(self, *arguments) -> Iterator[tuple]:
            if len(arguments) == 2:
                yield from _results(function, *arguments)
                return
            row = arguments[0]
            kept = [row[c] for c in row.__fields__ if c != "payload"]
            for found in _results(function, row["base"], row["payload"]):
                yield (*kept, *found)

    return F.udtf(Check)


def run_checks(inputs: DataFrame, function: CheckFunction = default_check) -> DataFrame:
    """A user's check as a table function: every input row (base, payload and more) gives a good
    base row and the check's own rows, or one bad base row with the error when the check raises.
    Adds name, ok, data. Runs in Arrow batches where the rows are."""
    kept = [c for c in inputs.columns if c != "payload"]
    schema = T.StructType(
        [inputs.schema[c] for c in kept]
        + T.StructType.fromDDL("name string, ok boolean, data map<string,string>").fields
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            base, payload = (batch.column(names.index(c)).to_pylist() for c in ("base", "payload"))
            found = [_results(function, b, p) for b, p in zip(base, payload)]
            repeat = [i for i, rows in enumerate(found) for _ in rows]
            flat = [row for rows in found for row in rows]
            table = batch.select(kept).take(pa.array(repeat, pa.int64()))
            own = [
                pa.array([r[0] for r in flat], pa.string()),
                pa.array([r[1] for r in flat], pa.bool_()),
                pa.array([list(r[2].items()) for r in flat], pa.map_(pa.string(), pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(
                [*table.columns, *own], names=[*kept, "name", "ok", "data"]
            )

    return inputs.mapInArrow(run, schema)


def checked(inputs: DataFrame, function: CheckFunction = default_check) -> DataFrame:
    """The rows of `run_checks`, kept in a checkpoint: later steps look at them several times (to find hot keys, to
    order them), and a check, which may have effects of its own, runs once for each input."""
    return materialize(run_checks(inputs, function))


def streaks(
    results: DataFrame, keys: list[str], order: list[str], cuts: Cuts | None = None
) -> DataFrame:
    """`verdict` per result: failed when the last fail_count are bad, resolved when a failed check
    has its last resolve_count good, else other; failure is tested first and repeats.
    Rows carry ok, fail_count, resolve_count (both at least 1)."""
    columns = results.columns
    rows = OrderedRows(results, keys, order, cuts).runs(_ok=F.col("ok"))
    streak = F.col("_ok_length")
    rows = rows.with_columns(
        _bad=~F.col("ok") & (streak >= F.col("fail_count")),
        _good=F.col("ok") & (streak >= F.col("resolve_count")),
    )
    rows = rows.last_known(_failed=F.when(F.col("_bad"), True).when(F.col("_good"), False))
    verdict = (
        F.when(F.col("_bad"), "failed")
        .when(F.col("_failed") & F.col("_good"), "resolved")
        .otherwise("other")
    )
    return rows.df.select(*columns, verdict.alias("verdict"))


def code_text() -> Column:
    return F.coalesce(F.col("status_code").cast("string"), F.lit("failed-fetch"))


def history_text(
    results: DataFrame, keys: list[str], order: list[str], cuts: Cuts | None = None
) -> DataFrame:
    """`history`: the last max(fail_count, resolve_count) codes of a check joined by ", ". The window is
    as long as the largest such number in the table."""
    columns = results.columns
    longest = results.agg(F.max(F.greatest("fail_count", "resolve_count"))).first()[0] or 1
    rows = OrderedRows(results, keys, order, cuts).recent(int(longest), _codes=code_text())
    size = F.least(F.greatest("fail_count", "resolve_count"), F.size("_codes"))
    kept = F.slice("_codes", F.size("_codes") - size + 1, size)
    return rows.df.select(*columns, F.array_join(kept, ", ").alias("history"))


def latest_values(
    results: DataFrame, keys: list[str], order: list[str], cuts: Cuts | None = None
) -> DataFrame:
    """Most recent body and most recent error, each looked up on its own."""
    return OrderedRows(results, keys, order, cuts).last_known(
        inclusive=True, last_body="body", last_error="error"
    ).df


def keep_last(results: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows per key; each task passes on at most n per key."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return results.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def suppressed() -> Column:
    """Alert withheld: the flag is set and the latest error is an ignorable fetch error."""
    return F.coalesce(
        F.col("ignore_failed_fetch") & F.col("last_error").isin(*IGNORABLE_ERRORS), F.lit(False)
    )


def failure_details(df: DataFrame) -> DataFrame:
    """`details` of failing rows that carry history, last_body, last_error and uri."""
    details = F.struct(
        mask_user_info("uri").alias("uri"),
        F.col("definition").alias("check definition"),
        F.col("history").alias("status history"),
        trim_body("last_body").alias("body"),
        F.col("last_error").alias("exception"),
        F.when(F.size("data") > 0, F.col("data")).alias("check data"),
    )
    return df.withColumn("details", F.to_json(details))


def response_view(results: DataFrame) -> DataFrame:
    """Per result: success with status and body, or no success with the reason."""
    ok = F.col("error").isNull()
    return results.withColumns(
        {
            "success": ok,
            "reason": F.col("error"),
            "status": F.when(ok, F.col("status_code")),
            "response_body": F.when(ok, F.col("body")),
        }
    )


def ping_metrics(results: DataFrame) -> DataFrame:
    """`get` = -1 and `latency` = milliseconds for each result."""
    dims = F.create_map(
        F.lit("pingServiceName"), F.array("name"),
        F.lit("pingStatusCode"), F.array(code_text()),
        F.lit("pingGroup"), F.array("group"),
        F.lit("pingResult"), F.array(F.col("ok").cast("string")),
    )
    pair = F.array(
        F.struct(F.lit("get").alias("metric"), F.lit(-1.0).alias("value")),
        F.struct(F.lit("latency").alias("metric"), F.col("latency_ms").cast("double").alias("value")),
    )
    return results.select(F.explode(pair).alias("m"), dims.alias("dims"), "ts").select(
        "m.metric", "m.value", "dims", F.col("ts").alias("created")
    )
