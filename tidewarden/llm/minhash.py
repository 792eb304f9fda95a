"""Near-duplicate documents by b-bit MinHash, with links confirmed on the full shingle sets.

Words are runs of characters other than space and 0x09-0x0D with A-Z lowered, shingles are runs of `shingle`
words; a text with fewer words is one shingle, a text without words has none and is linked with nothing.
Documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles; the result
is the components of these links.

1. One pass over whole texts takes 160 minima per document. The low four bits of each are kept, packed into
   80 bytes; five minima at a time make the key of one of 32 bands.
2. Documents with equal sets (known by 128 bits) are one class, and only classes go on.
3. Classes that share a band are candidates. Each is linked to the smallest class of its band, which is
   linear in their number, and the components of those links hold all candidate pairs.
4. Within a component, similarity is estimated from the packed bits: bit counts of the exclusive or give the
   share of equal minima, corrected for chance collisions (1/16). Pairs below the limit less five standard
   errors are out, and the component falls into smaller ones. No pairs are written, only part numbers.
5. Only what is left with a partner fetches its text, and each part confirms links on full sets, walking from
   class to class; it returns one link per class.
6. A component too large for a task (`MOST_CLASSES`, `MOST_SHINGLES`) is not taken whole: its bands are, and a
   band too large is cut into blocks, every two of which meet in a task of bounded size. The links found are
   united by another round of components. This is exact as well, as every candidate pair shares a band.

A pair at 85 percent shares no band with probability (1 - 0.85^5)^32 < 1e-8, and falls below the estimate's
limit with less than 1e-6. Sets are compared by 64-bit hashes of their shingles.

Defined cases: a null or blank text has no shingles, is its own component and is kept; a row without doc_id
cannot be named, is linked with nothing and kept; rows with the same doc_id are one node, and with the same
text they get the same result; empty tables give no rows; other columns are not read here, and `dedup`, which tells
rows apart as rows, carries them in a struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.segments import materialize
from . import arrays
from .components import components
from .ranks import ranked
from .spread import attach, groups, small_batches, sorted_groups

BANDS = 32
ROWS = 5
LANE_BITS = 4
MOST_CLASSES = 4096
MOST_SHINGLES = 1 << 22
SHINGLE = 3
PERCENT = 85

_U = np.uint64
_MINIMA = BANDS * ROWS
_FACTORS = arrays.random_words(_MINIMA, 21) | _U(1)
_SHIFTS = arrays.random_words(_MINIMA, 22)
_LANES = _U(0x1111111111111111)


def shingles(part: arrays.Part, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text, and their bounds."""
    words = arrays.words(part)
    codes = arrays.hashes(part, words, lower=True)
    out, bounds = arrays.runs(codes, words.bounds, k)
    few = np.flatnonzero((words.counts() > 0) & (words.counts() < k))
    if not len(few):
        return out, bounds
    single = []
    for i in few:
        own = codes[words.bounds[i] : words.bounds[i + 1]]
        single.append(arrays.runs(own, np.array([0, len(own)]), len(own))[0][0] ^ _U(len(own)))
    counts = np.diff(bounds)
    new = np.zeros(len(out) + len(few), _U)
    counts[few] = 1
    new_bounds = np.concatenate(([0], np.cumsum(counts)))
    place = np.ones(len(new), bool)
    place[new_bounds[few]] = False
    new[place], new[~place] = out, np.array(single, _U)
    return new, new_bounds


def distinct(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of each text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    return codes[first], np.searchsorted(owner[first], np.arange(len(bounds)))


def _sketch(part: arrays.Part, k: int) -> dict[str, np.ndarray]:
    codes, bounds = shingles(part, k)
    beyond, _ = arrays.repeats(np.repeat(np.arange(len(part)), np.diff(bounds)), codes)
    single = codes[~beyond]
    counts = arrays.sums(~beyond, bounds)
    ends = np.concatenate(([0], np.cumsum(counts)))
    some = np.flatnonzero(counts)
    minima = np.zeros((len(part), _MINIMA), _U)
    with np.errstate(over="ignore"):
        if len(some):
            starts = ends[:-1][some]
            for j in range(_MINIMA):
                minima[some, j] = np.minimum.reduceat((single ^ _SHIFTS[j]) * _FACTORS[j], starts)
        keys = np.zeros((len(part), 2), _U)
        for j in (0, 1):
            total = np.concatenate(([_U(0)], np.cumsum(arrays.mix(single ^ _SHIFTS[j]))))
            keys[:, j] = total[ends[1:]] - total[ends[:-1]]
        bands = np.tile(arrays.random_words(BANDS, 23), (len(part), 1))
        for j in range(ROWS):
            bands = arrays.mix(bands + minima[:, j::ROWS])
    lanes = (minima & _U((1 << LANE_BITS) - 1)).astype(np.uint8)
    return {"n": counts, "keys": keys.view(np.int64), "bands": bands.view(np.int64), "bits": lanes[:, ::2] | (lanes[:, 1::2] << 4)}


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (which set it is), bands and bits of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.parts(batch.column("text")):
                found = _sketch(part, shingle)
                n = len(part)
                columns = [
                    batch.column("doc_id").slice(part.first, n),
                    pa.array(found["n"].astype(np.int64)),
                    pa.array(found["keys"][:, 0]),
                    pa.array(found["keys"][:, 1]),
                    arrays.list_column(found["bands"].ravel(), np.arange(n + 1) * BANDS, pa.int64()),
                    pa.array([row.tobytes() for row in found["bits"]], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "k1", "k2", "bands", "bits"])

    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, bits binary"
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(sketch, schema)


def estimates(bits: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of packed bits (as 64-bit numbers) with one other."""
    x = bits ^ one
    x = (x | (x >> _U(1)) | (x >> _U(2)) | (x >> _U(3))) & _LANES
    equal = 1 - np.bitwise_count(x).sum(1, dtype=np.int64) / _MINIMA
    chance = 1 / (1 << LANE_BITS)
    return (equal - chance) / (1 - chance)


def estimate_limit(percent: int) -> float:
    """The similarity less five standard errors of its estimate."""
    similarity, chance = percent / 100, 1 / (1 << LANE_BITS)
    equal = similarity + (1 - similarity) * chance
    return similarity - 5 * (equal * (1 - equal) / _MINIMA) ** 0.5 / (1 - chance)


def _walk(n: int, near) -> np.ndarray:
    """Part of each of n things, named by its first one; near(i, others) tells which others i is linked to."""
    part = np.arange(n)
    left = np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            others = np.flatnonzero(left)
            if not len(others):
                return part
            found = others[near(i, others)]
            part[found], left[found] = root, False
            todo.extend(found.tolist())
    return part


def _bit_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def split_by_estimate(table: pa.Table, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with an estimated partner in the component, and the smallest node of their part."""
    nodes = table["node"].to_numpy()
    order = np.argsort(nodes)
    nodes, bits = nodes[order], _bit_rows(table["bits"].combine_chunks())[order]
    part = _walk(len(nodes), lambda i, others: estimates(bits[others], bits[i]) >= limit)
    several = np.bincount(part, minlength=len(nodes))[part] > 1
    return nodes[several], nodes[part[several]]


def confirm(table: pa.Table, limit: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its part) among the nodes of a table, confirmed on full sets."""
    nodes = table["node"].to_numpy()
    _, first = np.unique(nodes, return_index=True)
    versions = len(first) < len(nodes)  # rows of one node: linked with each other
    order = np.argsort(nodes, kind="stable")
    nodes, bits = nodes[order], _bit_rows(table["bits"].combine_chunks())[order]
    sets = table["codes"].combine_chunks().take(pa.array(order))
    counts = np.diff(sets.offsets.to_numpy())
    bounds = np.concatenate(([0], np.cumsum(counts)))
    _, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    seen = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        out = estimates(bits[others], bits[i]) >= limit
        maybe = others[out]
        if not len(maybe):
            return out | (versions & (nodes[others] == nodes[i]))
        own = codes[bounds[i] : bounds[i + 1]]
        seen[own] = True
        size = counts[maybe]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(ends[-1]) + np.repeat(bounds[maybe] - ends[:-1], size)
        both = arrays.sums(seen[codes[at]], ends)
        seen[own] = False
        out[out] = 100 * both >= percent * (size + counts[i] - both)
        return out | (versions & (nodes[others] == nodes[i]))

    part = _walk(len(nodes), near)
    linked = nodes[part] != nodes
    return nodes[linked], nodes[part[linked]]


def _sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"))


def _blocked(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, node, n_shingles, ...) with `_task`, such that any two nodes of a group meet in some task
    and no task is larger than the limits (but for single documents). A group of b blocks has a task for every
    two of them; a group within the limits has one."""
    sizes = materialize(_sizes(rows, group))
    blocks = F.ceil(F.greatest(F.col("_n") * 2 / MOST_CLASSES, F.col("_s") * 2 / MOST_SHINGLES)).cast("int")
    cut = sizes.select(group, F.when(blocks <= 2, 1).otherwise(blocks).alias("_blocks"))
    dealt = attach(rows, cut, [group], ["node"], counts=sizes.select(group, "_n"))
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    paired = dealt.withColumn("_own", own).withColumn("_other", other)
    task = F.struct(F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    paired = paired.withColumn("_task", task)
    alone = (F.col("_own") == F.col("_other")) & (F.col("_blocks") > 1)  # met in the tasks with other blocks
    return paired.filter(~alone).withColumn("_task", F.xxhash64(group, "_task.i", "_task.j")).drop("_own", "_other", "_blocks")


def _links(rows: DataFrame, key: str, limit: float, percent: int) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, [key]):
            a, b = confirm(table, limit, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return sorted_groups(rows.select(key, "node", "bits", "codes"), [key]).mapInArrow(check, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and codes (its distinct shingles) of the given nodes, from their whole texts."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.select("node"), "node")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.parts(batch.column("text")):
                codes, bounds = distinct(*shingles(part, shingle))
                columns = [batch.column("node").slice(part.first, len(part)), arrays.list_column(codes.view(np.int64), bounds, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "codes"])

    return chosen.mapInArrow(take, "node long, codes array<long>")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    limit = estimate_limit(percent)
    sketched = materialize(sketches(docs, shingle))
    usable = sketched.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(
        usable.groupBy("k1", "k2").agg(
            F.min("doc_id").alias("node"),
            F.count(F.lit(1)).alias("n_rows"),
            *(F.first(c).alias(c) for c in ("n_shingles", "bands", "bits")),
        )
    )
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center"))
    shared = materialize(shared.filter(F.col("n") > 1))
    counts = shared.select("band", F.col("n").alias("_n"))
    members = materialize(attach(banded, shared.select("band", "center"), ["band"], ["node"], counts=counts))
    coarse = components(members.select(F.col("node").alias("a"), F.col("center").alias("b")))
    named = coarse.select("node", "component").unionByName(coarse.select(F.col("component").alias("node"), "component").distinct())
    rows = classes.select("node", "n_shingles", "bits").join(named, "node")
    rows = materialize(rows)
    sizes = materialize(_sizes(rows, "component"))
    too_large = (F.col("_n") > MOST_CLASSES) | (F.col("_s") > MOST_SHINGLES)
    told = sizes.select("component", too_large.alias("large"))
    rows = materialize(attach(rows, told, ["component"], ["node"], counts=sizes.select("component", "_n")))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["component"]):
            a, b = split_by_estimate(table, limit)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["node", "part"])

    small = sorted_groups(rows.filter(~F.col("large")).select("component", "node", "bits"), ["component"])
    parts = materialize(small.mapInArrow(refine, "node long, part long").distinct())
    large = rows.filter("large").select("node", "n_shingles", "bits")
    wanted = parts.select("node").unionByName(large.select("node")).distinct()
    sets = materialize(_sets(docs, wanted, shingle))
    full = rows.select("node", "n_shingles", "bits").join(sets, "node")
    links = _links(parts.join(full, "node"), "part", limit, percent)
    if not large.isEmpty():
        # bands of large components, each node once in a band, cut into tasks of bounded size
        of_large = materialize(members.select("node", "band").join(large, "node").distinct())
        tasks = materialize(_blocked(of_large, "band").select("_task", "node", "bits"))
        held = attach(tasks, sets, ["node"], ["_task"])
        links = links.unionByName(_links(held, "_task", limit, percent))
    united = components(links)
    return _results(sketched, classes, united)


def _results(sketched: DataFrame, classes: DataFrame, united: DataFrame) -> DataFrame:
    named = classes.select("k1", "k2", "node").join(united, "node", "left")
    named = named.select("k1", "k2", F.coalesce("component", "node").alias("component"))
    rows = sketched.select("doc_id", "n_shingles", "k1", "k2")
    counts = classes.select("k1", "k2", F.col("n_rows").alias("_n"))
    found = attach(rows.filter("n_shingles > 0"), named, ["k1", "k2"], ["doc_id"], "left", counts)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.unionByName(none).withColumn("kept", kept)


def dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id. Rows are told apart as
    rows: of rows that repeat an id with one text one stays, rows that repeat an id with different texts are judged each
    for itself, and rows without id count as coming last."""
    known = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*known).alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL OR n > 1")
    if not repeated.isEmpty():  # numbers in the order of ids take their place
        keyed = rows.select(
            F.lit(0).alias("all"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text", "row"
        )
        rows = materialize(ranked(keyed, ["all"], ["last", "id", "h"]).select("row", "text", F.col("pos").alias("doc_id")))
    judged = near_duplicates(rows.select("doc_id", "text"), shingle, percent)
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return rows.join(gone, rows["doc_id"] == gone["_gone"], "left_anti").select("row.*")
