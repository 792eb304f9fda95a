"""Audit of five text filters: what each removes, in every order, on its own and in the mean over all orders.

Filters, by letter; a document fails
  A  with under 200 words
  B  if its distinct words are less than 50 percent of its words
  C  if letters A-Z are more than 3 percent of its code points
  D  if it holds one of # $ % & * |
  E  if its text equals that of a row with a smaller doc_id, anywhere in the table, removed or not
Words are maximal runs of bytes other than space and 0x09-0x0D and are told apart by case; a null text is empty.

1. A byte transducer reads each text once. Its table gives, for a state (within a word or not) and a class of bytes,
   the next state and marks: a word begins, a word has ended, capital, code point, symbol. Whatever the state, a class
   leads to one next state, so a slice of many texts is run at once: the state before a byte follows from the byte
   before. Word spans go into an open-addressed hash table, keyed by text and hash, in which every hit is verified on
   the bytes; the places that were taken new are the distinct words.
2. Filter E: rows are known by the sha256 of their text. Counts and the smallest id per text, part and label come from
   aggregates with partial sums, so a text that a third of all rows hold is no large group anywhere.
3. What is left are counts by part (language) and the set of failed filters, at most 32 per part; orders and steps are
   laid over those.

Defined cases: null and empty texts are the same text; a null language is the part ''; a row without doc_id never
counts as a later copy and has no labels; rows that repeat an id with the same text count each, and none is a copy of
the other; several labels of an id count as their largest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.segments import materialize
from . import arrays
from .spread import attach, small_batches

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SYMBOLS = b"#$%&*|"

_SPACE, _CAPITAL, _SYMBOL, _OTHER, _INNER = range(5)
_OUT, _IN = range(2)
WORD, END, CAPITAL, POINT, SYMBOL = (1 << i for i in range(5))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte, next state by class, and marks by state and class."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[0x80:0xC0] = _INNER  # bytes of a code point behind its first
    kind[[0x20, *range(0x09, 0x0E)]] = _SPACE
    kind[ord("A") : ord("Z") + 1] = _CAPITAL
    kind[list(SYMBOLS)] = _SYMBOL
    after = np.full(5, _IN, np.uint8)
    after[_SPACE] = _OUT
    marks = np.zeros((2, 5), np.uint8)
    marks[:, [_SPACE, _CAPITAL, _SYMBOL, _OTHER]] |= POINT
    marks[:, _CAPITAL] |= CAPITAL
    marks[:, _SYMBOL] |= SYMBOL
    marks[_OUT, [_CAPITAL, _SYMBOL, _OTHER, _INNER]] |= WORD
    marks[_IN, _SPACE] |= END
    return kind, after, marks


_KIND, _AFTER, _MARKS = _tables()


def transduce(part: arrays.Part) -> tuple[np.ndarray, arrays.Spans]:
    """Marks of each byte, and the spans of the words."""
    n = len(part.data)
    kind = _KIND[part.data]
    state = np.empty(n, np.uint8)
    state[1:] = _AFTER[kind[:-1]]
    first = part.bounds[:-1]
    state[first[first < n]] = _OUT
    marks = _MARKS.ravel()[state * np.uint8(5) + kind]
    start = np.flatnonzero(marks & WORD)
    filled = part.bounds[1:][part.bounds[1:] > part.bounds[:-1]]
    last = filled[_AFTER[kind[filled - 1]] == _IN]  # words that go on to the end of their text
    end = np.sort(np.concatenate((np.flatnonzero(marks & END), last)))
    return marks, arrays.Spans(start, end, np.searchsorted(start, part.bounds))


def distinct_words(part: arrays.Part, words: arrays.Spans) -> np.ndarray:
    """Number of distinct words of each text, by a hash table whose hits are verified on the bytes."""
    n = len(words.start)
    if not n:
        return np.zeros(len(part), np.int64)
    owner = words.owner()
    keys = arrays.mix(arrays.hashes(part, words) ^ arrays.mix(owner.astype(np.uint64)))
    size = 1 << (2 * n - 1).bit_length()
    table = np.full(size, -1, np.int64)
    slot = (keys & np.uint64(size - 1)).astype(np.int64)
    new = np.zeros(n, bool)
    left = np.arange(n)
    while len(left):
        free = left[table[slot[left]] < 0]
        table[slot[free]] = free  # of several, one stays
        holder = table[slot[left]]
        new[left[holder == left]] = True
        same = (owner[holder] == owner[left]) & (keys[holder] == keys[left])
        same[same] = arrays.same_bytes(part, words, holder[same], left[same])
        left = left[~same]
        slot[left] = (slot[left] + 1) & (size - 1)
    return arrays.sums(new, words.bounds)


def counts(part: arrays.Part) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text."""
    marks, words = transduce(part)
    found = {name: arrays.sums((marks & bit) > 0, part.bounds) for name, bit in (("capitals", CAPITAL), ("points", POINT), ("symbols", SYMBOL))}
    return {"words": words.counts(), "distinct": distinct_words(part, words), **found}


def _failed(n: dict[str, np.ndarray]) -> np.ndarray:
    """Filters A to D that each text fails, as bits."""
    fails = (
        n["words"] < MIN_WORDS,
        100 * n["distinct"] < MIN_DISTINCT_PERCENT * n["words"],
        100 * n["capitals"] > MAX_CAPITAL_PERCENT * n["points"],
        n["symbols"] > 0,
    )
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and failed (bits of A to D) of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.parts(batch.column("text")):
                own = [batch.column(c).slice(part.first, len(part)) for c in ("doc_id", "part", "digest")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(_failed(counts(part)))], ["doc_id", "part", "digest", "failed"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"),
    )
    return small_batches(rows).mapInArrow(measure, "doc_id long, part string, digest binary, failed int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of A to E), n, good and toxic: rows with just those failures, and how many are labelled so."""
    keys = ["digest", "part", "failed"]
    rows = materialize(measured(docs).groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("n")))
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = attach(rows, told, ["doc_id"], ["digest", "part"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    named = F.col("doc_id").isNotNull()
    groups = rows.groupBy(*keys, "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(named, F.lit(0)).otherwise(F.col("n"))).alias("unnamed"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("first", first)
    own = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    either = F.array(
        F.struct(F.col("failed"), own.alias("n")),
        F.struct((F.col("failed") + (1 << LETTERS.index("E"))).alias("failed"), (F.col("n") - own).alias("n")),
    )
    split = groups.select("part", "good", "toxic", F.inline(either)).filter("n > 0")
    return split.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley, the removals of the step's filter summed over all orders."""
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(LETTERS))), ",")
    laid = cells(docs, labels).withColumn("filter_order", F.explode(orders))
    laid = laid.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    laid = laid.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    before = "substring(filter_order, 1, step - 1)"
    laid = laid.withColumn("earlier", F.expr(" + ".join(f"IF(instr({before}, '{c}') > 0, {1 << i}, 0)" for i, c in enumerate(LETTERS))))
    laid = laid.withColumn("bit", F.expr(f"shiftleft(1, instr('{LETTERS}', letter) - 1)"))
    fails, gone = F.expr("failed & bit > 0"), F.expr("failed & earlier > 0")

    def total(condition, column: str, name: str):
        return F.sum(F.when(condition, F.col(column)).otherwise(0)).alias(name)

    found = laid.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone, "n", "kept"),
        total(fails & ~gone, "n", "removed"),
        total(fails & gone, "n", "redundant"),
        total(F.col("failed") == F.col("bit"), "n", "unique_fails"),
        total(fails & ~gone, "good", "good_lost"),
        total(fails & ~gone, "toxic", "toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return found.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley
    )


SQL = """
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), told AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flags AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {
        'A': len(words) < 200,
        'B': 100 * len(list_distinct(words)) < 50 * len(words),
        'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)
    } AS fails FROM docs LEFT JOIN told USING (doc_id)
), cells AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), laid AS (
    SELECT part, filter_order, s.step, n, good, toxic, filter_order[s.step] AS letter, fails[filter_order[s.step]] AS failing,
        len(list_filter(string_split(filter_order[1:s.step - 1], ''), lambda x: x <> '' AND fails[x])) > 0 AS gone,
        len(list_filter(map_values(fails), lambda x: x)) AS failures
    FROM cells, orders, (SELECT unnest(range(1, 6)) AS step) s
), found AS (
    SELECT part, filter_order, step, letter, sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN failing AND failures = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
    FROM laid GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM found
"""
