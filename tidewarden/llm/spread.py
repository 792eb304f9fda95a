"""Batches of bounded size, joins that stay even when a key holds a large part of all rows, and groups read from sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose rows are about to go to Python: in Arrow batches of a few megabytes, unless the session has
    set a limit of its own. Texts are walked in slices of that size anyway."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, "67108864b") == "67108864b":
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def attach(
    left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner", counts: DataFrame | None = None
) -> DataFrame:
    """left joined with right on keys that are not null. Keys with more than a thousandth of left's rows, of
    which there are at most a thousand, are salted by `spread_by`: each is dealt out in lots of a thousandth,
    and right's rows of that key are repeated for each lot, at most two thousand in total per row of a key.
    `left` is read twice, so it should be cheap or a checkpoint, unless `counts` gives the rows `_n` of its
    keys; a column `_salt` in it is not allowed."""
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    lot = max(total // HEAVY_SHARE, 16)
    lots = F.ceil(F.col("_n") / lot).cast("int")
    heavy = F.broadcast(counts.filter(F.col("_n") > lot).select(*keys, lots.alias("_lots")))
    dealt = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_lots")).cast("int"), F.lit(0))
    salted = left.join(heavy, keys, "left").withColumn("_salt", dealt).drop("_lots")
    repeated = right.join(heavy, keys, "left")
    repeated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_lots"), F.lit(1)) - 1)))
    return salted.join(repeated.drop("_lots"), [*keys, "_salt"], how).drop("_salt")


def sorted_groups(df: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """df dealt out by key and sorted, for `groups` to walk."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, one key after the other, from sorted batches. Holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        begin = 0
        for i, key in enumerate(zip(*columns, strict=True)):
            if key != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, begin, last = [], i, key
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
