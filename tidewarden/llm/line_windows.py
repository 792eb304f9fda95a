"""Line dedup with overlapping windows of three lines, in DataFrame functions only.

A text is split at line feeds. Every three consecutive lines are a window, known by 96 bits of hashes of its
lines. A window that stands at several places of the corpus stays at the first one, in the order of doc_id
(null last), text hash and place; at every later place it covers its three lines, and lines covered by any
window go. Overlapping windows merge by their covered positions, so a repeated passage of any length from
three lines on goes as a whole.

One pass over the texts writes the windows of each document (a checkpoint, as they are read again). Repeated
windows come from a partial aggregation. They are joined back in two ways: windows with more than a
thousandth of all rows, of which there can be no more than a thousand, are broadcast; the rest are joined by
a shuffle on the window, where no key is large. Only covered positions are gathered per document.

Defined cases: a null text stays null and has no lines; an empty text is one empty line; texts of fewer than
three lines have no window and stay as they are; blank lines are lines like others; rows with the same doc_id
and the same text are one document: they get the same result and do not cover each other; null doc_ids come
last; an empty table gives no rows; further columns are carried in a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.segments import materialize

WIDTH = 3
HEAVY_SHARE = 1000  # a window with more than 1 / HEAVY_SHARE of all windows is broadcast


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column, width: int) -> Column:
    """The two hashes of each window of a text's lines; lines are bound once, not split again per window."""
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b")))

    def window(all_lines: Column, i: Column) -> Column:
        own = [F.get(all_lines, i + j) for j in range(width)]
        return F.struct(F.xxhash64(*[x["a"] for x in own]).alias("a"), F.hash(*[x["b"] for x in own]).alias("b"))

    def all_windows(all_lines: Column) -> Column:
        n = F.size(all_lines)
        starts = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: window(all_lines, i))

    return F.get(F.transform(F.array(hashed), all_windows), 0)


def covered_positions(docs: DataFrame, width: int = WIDTH, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """_id, _text (hash of the text) and _at, the starts of covering windows, of the documents that have any."""
    chosen = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "text")
    per_doc = chosen.filter(F.col("text").isNotNull()).select(
        "_id", "_text", _windows(split_lines(F.col("text")), width).alias("_w")
    )
    per_doc = materialize(per_doc.filter(F.size("_w") > 0))
    windows = per_doc.select("_id", "_text", F.posexplode("_w").alias("_at", "_x"))
    windows = windows.select("_id", "_text", "_at", F.col("_x.a").alias("_a"), F.col("_x.b").alias("_b"))
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_text").alias("text"), F.col("_at").alias("at"))
    counted = windows.groupBy("_a", "_b").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = materialize(counted.filter(F.col("_n") > 1))
    total = per_doc.agg(F.sum(F.size("_w"))).first()[0] or 0
    limit = max(total // heavy_share, 1)
    heavy, light = repeated.filter(F.col("_n") > limit), repeated.filter(F.col("_n") <= limit)
    found = windows.join(F.broadcast(heavy), ["_a", "_b"])
    rest = windows.join(F.broadcast(heavy.select("_a", "_b")), ["_a", "_b"], "left_anti")
    found = found.unionByName(rest.join(light, ["_a", "_b"]))
    later = found.filter(
        ~(F.col("_id").eqNullSafe(F.col("_first.id")) & (F.col("_text") == F.col("_first.text")) & (F.col("_at") == F.col("_first.at")))
    )
    return later.groupBy("_id", "_text").agg(F.collect_set("_at").alias("_at"))


def _kept(lines: Column, starts: Column, width: int) -> Column:
    """Positions of the lines that no window covers, in order."""
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + width - 1))))
    return F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)


def trimmed(docs: DataFrame, width: int = WIDTH, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """row (a struct of the document's columns), text without its covered lines, n_lines and n_removed."""
    covered = covered_positions(docs, width, heavy_share)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = rows["row.doc_id"].eqNullSafe(covered["_id"]) & (F.xxhash64(rows["row.text"]) == covered["_text"])
    joined = rows.join(covered, same, "left").select("row", "_at")

    def cut(lines: Column) -> Column:
        def result(kept: Column) -> Column:
            text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
            return F.struct(text.alias("text"), F.size(lines).alias("n_lines"), (F.size(lines) - F.size(kept)).alias("n_removed"))

        return F.get(F.transform(F.array(_kept(lines, F.col("_at"), width)), result), 0)

    text = F.col("row.text")
    changed = F.get(F.transform(F.array(split_lines(text)), cut), 0)
    plain = F.struct(
        text.alias("text"), F.when(text.isNull(), 0).otherwise(F.size(split_lines(text))).alias("n_lines"), F.lit(0).alias("n_removed")
    )
    found = joined.select("row", F.when(F.col("_at").isNull(), plain).otherwise(changed).alias("_new"))
    return found.select("row", "_new.text", "_new.n_lines", "_new.n_removed")


def dedup(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """The documents with their columns and what is left of their texts; those of which only white space is
    left after lines went are copies as a whole and go."""
    found = trimmed(docs)
    if drop_emptied:
        found = found.filter((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:  # the length follows the text
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(kind)
        new["n_chars"] = length.alias("n_chars")
    return found.select(*(new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns))


SQL = """
WITH lines AS (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
    FROM documents WHERE text IS NOT NULL
), windows AS (
    SELECT doc_id, pos, line, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
    SELECT doc_id, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, pos) AS n FROM windows WHERE third IS NOT NULL
    ) WHERE n > 1
), covered AS (
    SELECT DISTINCT doc_id, pos + j AS pos FROM later, (VALUES (0), (1), (2)) AS steps(j)
)
SELECT d.doc_id, coalesce(k.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text,
    CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN (
    SELECT lines.doc_id, string_agg(line, chr(10) ORDER BY lines.pos) FILTER (covered.pos IS NULL) AS text,
        count(*) AS n_lines, count(covered.pos) AS n_removed
    FROM lines LEFT JOIN covered ON lines.doc_id = covered.doc_id AND lines.pos = covered.pos GROUP BY lines.doc_id
) k ON d.doc_id = k.doc_id
"""
