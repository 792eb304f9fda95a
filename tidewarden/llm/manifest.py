"""Merkle manifest of a dataset: a leaf per row, a tree per source, a root over the sources, and proofs.

H is lowercase hex sha256 of inputs one after the other. A leaf is H of doc_id, source, lang, n_chars and text, each
`-` if null, else its UTF-8 byte count, `:` and the value. Leaves of a source ascend by doc_id; every three nodes in
a row (the last run may be shorter) become their H until one is left, the subroot. Subroots in order of source (null
first, by UTF-8 bytes) become the root in the same way. A proof holds the siblings of each level, from the leaf to the
root; folding a leaf with them gives the root again if nothing was changed.

The tree is built by slot pivots: conditional aggregates per parent spread its children into one column per slot;
all of them one after the other give the parent, all but the own slot the siblings. Nodes are shuffled once per
`DEPTH` levels, dealt out in blocks of FANOUT ** DEPTH places: within a block each level is a window over a prefix of
the digits of the place, and all levels use the same sort. The roots of the blocks, 729 times fewer, are the nodes of
the next round. Proofs come back down: the path of a source joins its last round of nodes, a block's path joins its
nodes, which are still dealt out by block, so long paths never move but with block roots.

Defined cases: a null text, source, language, length or id is `-` and null ids come first; rows with the same id are
ordered by their leaf, and equal rows in any order, so they get proofs of their own (rows are told apart by leaf only
where they are equal in everything); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.segments import materialize
from .ranks import ranked

FANOUT = 3
DEPTH = 6

_STEP = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """Unambiguous text of a value: length and value, or `-`."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def _block(nodes: DataFrame, group: str, fanout: int, depth: int) -> DataFrame:
    """nodes (group, h, pos, n) with `_block`, `_in` (the place there), `steps`, the siblings left and right at each
    level of the block, and `top`, the block's root. A group's levels end where one node is left."""
    names = [f"`{c}`" for c in nodes.columns]
    size = fanout**depth
    digits = [f"_d{i}" for i in range(depth)]
    places = [f"int(pos % {size} div {fanout**i} % {fanout}) AS {d}" for i, d in enumerate(digits)]
    dealt = nodes.selectExpr(*names, f"pos div {size} AS _block", f"pos % {size} AS _in", "h AS top", *places)
    dealt = dealt.repartition(group, "_block").sortWithinPartitions(group, "_block", *reversed(digits))
    slots, steps = [f"_c{slot}" for slot in range(fanout)], []
    for level, own in enumerate(digits):
        run = ", ".join([f"`{group}`", "_block", *reversed(digits[level + 1 :])])
        spread = [f"max(CASE WHEN {own} = {i} THEN top END) OVER (PARTITION BY {run}) AS {c}" for i, c in enumerate(slots)]
        left = ", ".join(f"CASE WHEN {own} > {i} THEN {c} END" for i, c in enumerate(slots))
        right = ", ".join(f"CASE WHEN {own} < {i} THEN {c} END" for i, c in enumerate(slots))
        kept = [*names, "_block", "_in", *digits[level + 1 :], *steps]
        more = f"n > {fanout**level}"  # else this level is the top of its group
        dealt = dealt.selectExpr(*kept, own, "top", *spread).selectExpr(
            *kept,
            f"CASE WHEN {more} THEN named_struct('l', concat_ws('', {left}), 'r', concat_ws('', {right})) END AS _s{level}",
            f"CASE WHEN {more} THEN sha2(concat_ws('', {', '.join(slots)}), 256) ELSE top END AS top",
        )
        steps.append(f"_s{level}")
    return dealt.selectExpr(*names, "_block", "_in", "top", f"filter(array({', '.join(steps)}), s -> s IS NOT NULL) AS steps")


def tree(nodes: DataFrame, group: str, crown: Callable[[DataFrame], DataFrame], fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """nodes (group, without nulls; h, pos, n and others) with `path`, the siblings of each level, and what `crown` adds:
    it gets the root of each group (group, top) and returns the group with `up`, the path from there on, and further
    columns. Columns that start with `_` are not allowed in nodes, nor `top`, `steps` and `up`."""
    size = fanout**depth
    most = nodes.agg(F.max("n")).first()[0] or 0
    built = _block(nodes, group, fanout, depth)
    heads = materialize(built.filter("_in = 0").select(group, "top", F.col("_block").alias("pos"), F.ceil(F.col("n") / size).alias("n")))
    if most <= size:
        above, on = crown(heads.select(group, "top")), [group]
        further = [c for c in above.columns if c not in (group, "up")]
    else:
        above = tree(heads.withColumnRenamed("top", "h"), group, crown, fanout, depth)
        further = [c for c in above.columns if c not in (group, "h", "pos", "n", "path")]
        above, on = above.select(group, F.col("pos").alias("_block"), F.col("path").alias("up"), *further), [group, "_block"]
    return built.join(above, on).select(*nodes.columns, F.concat("steps", "up").alias("path"), *further)


def _roots(tops: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The tree over the roots of the groups (key, top): key, up, subroot and root."""
    nodes = ranked(tops.select(F.lit(0).alias("all"), "key", F.col("top").alias("h")), ["all"], ["key"])

    def end(top: DataFrame) -> DataFrame:
        return top.select("all", F.array().cast(_STEP).alias("up"), F.col("top").alias("root"))

    found = tree(materialize(nodes), "all", end, fanout, depth)
    return materialize(found.select("key", F.col("path").alias("up"), F.col("h").alias("subroot"), "root"))


def proof(path: Column) -> Column:
    """H of all siblings of a path."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(path, lambda s: F.array(s["l"], s["r"])))), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def manifest(docs: DataFrame, tampered: Column, changed: Column, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root and verified of every row. Where `tampered` holds, the root is
    recomputed from a leaf whose text is `changed` (both over columns of docs), and from the leaf itself elsewhere."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), "").otherwise(F.concat(F.lit("s"), source))  # null first, no nulls
    rows = docs.select(
        "doc_id", key.alias("key"), leaf(*own, F.col("text")).alias("h"), F.when(tampered, leaf(*own, changed)).alias("changed")
    )
    leaves = materialize(ranked(rows, ["key"], ["doc_id", "h"]))
    found = tree(leaves, "key", lambda tops: _roots(tops, fanout, depth), fanout, depth)
    found = found.withColumn("folded_root", fold(F.coalesce("changed", "h"), F.col("path")))
    return found.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def without_feeds(docs: DataFrame) -> DataFrame:
    """The manifest in which rows with an even crc32 of their id lost the line feeds of their text."""
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    found = manifest(docs, even, F.replace("text", F.lit("\n"), F.lit("")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


#: The same by levels held as lists: a list of all nodes of a source per level, siblings by place, folding by recursion.
SQL = """
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), docs AS (
    SELECT d.*, row_number() OVER () AS row_id, xor(4294967295, list_reduce(list_prepend(4294967295,
        list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 2 = 0 AS even FROM documents d, crc
), leaves AS (
    SELECT row_id, doc_id, source, even, {leaf_text} AS leaf, {leaf_changed} AS changed FROM docs
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1 AS pos FROM leaves
), levels AS (
    SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM ordered GROUP BY source
    UNION ALL
    SELECT source, level + 1, list_transform(range((len(nodes) + 2) // 3),
        lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM levels WHERE len(nodes) > 1
), subroots AS (
    SELECT source, nodes[1] AS subroot, level AS height,
        row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1
), tops AS (
    SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, list_transform(range((len(nodes) + 2) // 3),
        lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM tops WHERE len(nodes) > 1
), steps AS (
    SELECT o.row_id, l.level, o.pos // CAST(power(3, l.level) AS BIGINT) AS spot, l.nodes
    FROM ordered o JOIN levels l ON l.source IS NOT DISTINCT FROM o.source WHERE len(l.nodes) > 1
    UNION ALL
    SELECT o.row_id, s.height + t.level, s.place // CAST(power(3, t.level) AS BIGINT), t.nodes
    FROM ordered o JOIN subroots s ON s.source IS NOT DISTINCT FROM o.source JOIN tops t ON len(t.nodes) > 1
), siblings AS (
    SELECT row_id, level, array_to_string(nodes[spot - spot % 3 + 1:spot], '') AS l,
        array_to_string(nodes[spot + 2:spot - spot % 3 + 3], '') AS r FROM steps
), proofs AS (
    SELECT row_id, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM siblings GROUP BY row_id
), folded AS (
    SELECT row_id, 0 AS level, CASE WHEN even THEN changed ELSE leaf END AS h FROM ordered
    UNION ALL
    SELECT f.row_id, f.level + 1, sha256(s.l || f.h || s.r) FROM folded f JOIN siblings s ON s.row_id = f.row_id AND s.level = f.level
), folds AS (
    SELECT row_id, arg_max(h, level) AS h FROM folded GROUP BY row_id
)
SELECT o.doc_id, o.leaf, s.subroot, r.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root,
    f.h = r.root AS verified
FROM ordered o JOIN subroots s ON s.source IS NOT DISTINCT FROM o.source JOIN folds f USING (row_id)
    LEFT JOIN proofs p USING (row_id), (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1) r
"""


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


SQL = SQL.replace("{leaf_text}", _leaf_sql("text")).replace("{leaf_changed}", _leaf_sql("replace(text, chr(10), '')"))
