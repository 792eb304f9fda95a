"""User checks as table functions in SQL, and run once per input."""

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import checks

ROWS = [("b1", "1|ok|3", 7, "x"), ("b2", "2|error|0", 8, None), ("b3", "3|ok|80", 9, "y"), (None, None, 10, "z")]
SCHEMA = "base string, payload string, run_id int, note string"


def scripted(payload):
    number, kind, value = payload.split("|")
    if kind == "error":
        raise ValueError("check failed")
    return [(f"{number}/{kind}", float(value) < 50, {"value": value})]


@pytest.fixture
def inputs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    df.createOrReplaceTempView("inputs")
    spark.udtf.register("scripted", checks.check_table_function(scripted))
    return df


def rows(df):
    return sorted((tuple(r.asDict().items()) for r in df.withColumn("data", F.to_json("data")).collect()), key=str)


def test_a_table_in_sql_equals_the_dataframe_form(spark, inputs):
    found = spark.sql("SELECT * FROM scripted(TABLE(inputs))")
    want = checks.run_checks(inputs, scripted)
    assert found.columns == want.columns and rows(found) == rows(want)
    assert sum(not r["ok"] for r in found.collect()) == 3  # a value above the limit, a raise, and a null payload


def test_lateral_rows(spark, inputs):
    found = spark.sql("SELECT run_id, name, ok, data FROM inputs, LATERAL scripted(base, payload)")
    want = checks.run_checks(inputs, scripted).select("run_id", "name", "ok", "data")
    assert rows(found) == rows(want)


def test_arguments_that_do_not_fit(spark, inputs):
    for call in ("scripted(TABLE(SELECT 1 AS base))", "scripted('a')", "scripted()"):
        with pytest.raises(Exception, match="base and payload"):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_checks_run_once_per_input(spark, inputs):
    calls = spark.sparkContext.accumulator(0)

    def counted(payload):
        calls.add(1)
        return scripted(payload)

    done = checks.checked(inputs.withColumns({"ts": F.lit(0).cast("timestamp"), "fail_count": F.lit(1), "resolve_count": F.lit(1)}), counted)
    out = checks.streaks(done, ["name"], ["ts", "run_id"])
    assert out.count() == len(out.collect()) and calls.value == len(ROWS)
