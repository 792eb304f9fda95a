"""Bounded samples of labelled documents for fitting models on the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def one_per_id(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys and text) for each id: the one whose text hashes lowest, so a repeated id is one row of a sample."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("_least")
    return rows.groupBy(*keys).agg(least).select(*keys, F.col("_least.text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column | None = None) -> DataFrame:
    """At most `rows` documents with a label, the same ones on every run: those whose ids hash lowest.

    The sample of ids has at most `rows` rows, so it is broadcast. Several labels of one id count as their
    largest; labels without id or value count as none; of rows that repeat an id one counts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if keep is not None:
        known = known.filter(keep)
    ids = (
        known.groupBy("doc_id")
        .agg(F.max(label).cast("long").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return one_per_id(found, ["doc_id", "_label"])


def broadcast_json(spark, model: dict):
    return spark.sparkContext.broadcast(json.dumps(model))
