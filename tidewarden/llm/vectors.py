"""Near-duplicate vectors by Euclidean p-stable hashing, with every link decided by the exact cosine.

Vectors are taken at length one. Two of them are linked if their cosine, in double precision, is `cosine` or more.

1. Equal vectors (by a digest) are one class with a weight, and only classes go on.
2. A table of the index has `k` Gaussian projections, shifted at random and cut into cells of width `WIDTH`; the k cell
   numbers are the bucket. Two vectors at distance d share a cell with a probability p(d) that is known, and a bucket
   with p(d)^k. `shape` sets k so that a vector has `STRANGERS` chance partners per bucket at right angles, and the
   number of tables so that a pair just at the limit shares no bucket with a probability of at most `MISS`. Both follow
   from the number of classes: tables grow with its power of 0.19.
3. Each member of a bucket is compared with the bucket's smallest member, which is linear; a pair that meets in several
   tables is compared once. Components of those links are groups.
4. Members of one bucket that are neither its smallest nor of one group are compared with each other in blocks of
   bounded size. What is found there only says which groups belong together, so no pairs are written.
5. Each group is then compared with itself, in blocks of bounded size, which gives exact numbers of links: a link between
   two vectors of a group counts even if they share no bucket. Only sums per vector leave the blocks. The work is the
   square of the distinct vectors in a group, as the numbers of links ask for it.

A pair is lost only if it shares no bucket and no chain of other links joins its ends.

Defined cases: a null or empty vector, one with null or non-finite components, and one of zeros is linked with nothing;
so is a row without vec_id, which is kept. Vectors of different lengths are not compared. Rows that repeat an id are
vectors of their own, linked like others. Equal vectors are linked with each other. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.segments import materialize
from . import arrays
from .components import components
from .spread import attach, groups, sorted_groups

COSINE = 0.95
WIDTH = 2.0
STRANGERS = 0.05
MISS = 0.005
SEED = 41
SLICE_ROWS = 1024
#: Rows of a block: small groups are cut finely, so that many tasks share a hot one; large ones at the upper size.
FINE_ROWS, MOST_BLOCKS, BLOCK_ROWS = 256, 16, 8192

_U = np.uint64


def shared_cell(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at a distance fall into one cell of a Gaussian projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Projections per table and number of tables for n vectors."""
    near, far = shared_cell(math.sqrt(2 - 2 * cosine)), shared_cell(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=4)
def _projections(size: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, size])
    return rng.standard_normal((size, tables * k)), rng.uniform(0, WIDTH, tables * k)


def buckets(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The bucket of each row in each table, as 64-bit numbers that differ between tables and lengths."""
    directions, shifts = _projections(x.shape[1], k, tables)
    cells = np.floor((x @ directions + shifts) / WIDTH).astype(np.int64).astype(_U).reshape(len(x), tables, k)
    keys = np.tile(arrays.mix(arrays.random_words(tables, SEED) ^ _U(x.shape[1])), (len(x), 1))
    with np.errstate(over="ignore"):
        for j in range(k):
            keys = arrays.mix(keys + cells[:, :, j])
    return keys.view(np.int64)


def _usable(v: str) -> str:
    finite = f"forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return f"{v} IS NOT NULL AND {finite} AND exists({v}, x -> x <> 0)"


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, v and digest, which is null for vectors that are linked with nothing."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    known = F.expr(f"vec_id IS NOT NULL AND coalesce({_usable('v')}, false)")
    plain = F.transform("v", lambda x: x + F.lit(0).cast("float" if single else "double"))  # -0 is 0
    return rows.withColumn("digest", F.when(known, F.unhex(F.sha2(F.to_json(plain), 256))))


def classes_of(rows: DataFrame) -> DataFrame:
    """node, digest, low (smallest id), n (rows) and v of every distinct vector."""
    found = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")
    )
    return materialize(found).withColumn("node", F.monotonically_increasing_id())


def _keyed(classes: DataFrame, k: int, tables: int) -> DataFrame:
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                for at in range(0, len(own), SLICE_ROWS):
                    some = batch.take(pa.array(own[at : at + SLICE_ROWS]))
                    keys = buckets(unit_rows(some.column("v")), k, tables)
                    ends = np.arange(len(keys) + 1) * tables
                    yield pa.RecordBatch.from_arrays(
                        [some.column("node"), arrays.list_column(keys.ravel(), ends, pa.int64())], ["node", "keys"]
                    )

    return classes.select("node", "v").mapInArrow(key, "node long, keys array<long>")


def _compared(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose cosine is large enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column("va"), batch.column("vb")
            sizes = np.diff(one.offsets.to_numpy())
            good = np.zeros(len(sizes), bool)
            same = sizes == np.diff(other.offsets.to_numpy())
            for size in np.unique(sizes):
                own = np.flatnonzero(same & (sizes == size))
                if len(own):
                    take = pa.array(own)
                    good[own] = np.einsum("ij,ij->i", unit_rows(one.take(take)), unit_rows(other.take(take))) >= cosine
            yield batch.select(["a", "b"]).filter(pa.array(good))

    own = classes.select(F.col("node").alias("a"), F.col("v").alias("va"))
    other = classes.select(F.col("node").alias("b"), F.col("v").alias("vb"))
    held = attach(attach(pairs, own, ["a"], ["b"]), other, ["b"], ["a"], counts=pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n")))
    return held.select("a", "b", "va", "vb").mapInArrow(compare, "a long, b long")


def _blocked(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, node, ...) with `task`, such that any two nodes of a group meet in exactly one task (or, of one block,
    in the task of that block alone), with `own`, the row's block, and `one`, whether the task has one block only."""
    sizes = materialize(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")))
    fine = F.least(F.ceil(F.col("_n") / FINE_ROWS), F.lit(MOST_BLOCKS))
    cut = sizes.select(group, F.greatest(fine, F.ceil(F.col("_n") / BLOCK_ROWS)).cast("int").alias("_blocks"))
    dealt = attach(rows, cut, [group], ["node"], counts=sizes)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    task = F.xxhash64(group, F.least("own", "_other"), F.greatest("own", "_other"))
    return dealt.withColumns({"task": task, "one": F.col("own") == F.col("_other")}).drop("_other", "_blocks")


def _block_rows(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """For each length of vectors in a task: places in the table of the two sides, their vectors, whether both are one."""
    one = bool(table["one"][0].as_py())
    own = table["own"].to_numpy()
    v = table["v"].combine_chunks()
    sizes = np.diff(v.offsets.to_numpy())
    for size in np.unique(sizes):
        fits = sizes == size
        a = np.flatnonzero(fits & (own == own.min()))
        b = a if one else np.flatnonzero(fits & (own != own.min()))
        if len(a) and len(b):
            left = unit_rows(v.take(pa.array(a)))
            yield a, b, left, left if one else unit_rows(v.take(pa.array(b))), one


def _tiles(left: np.ndarray, right: np.ndarray, cosine: float) -> Iterator[tuple[int, int, np.ndarray]]:
    for i in range(0, len(left), SLICE_ROWS):
        for j in range(0, len(right), SLICE_ROWS):
            yield i, j, left[i : i + SLICE_ROWS] @ right[j : j + SLICE_ROWS].T >= cosine


def _across(members: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """Groups (a, b) that hold linked members of one bucket. members: bucket, node, group; none is its bucket's smallest."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["task"]):
            group = table["group"].to_numpy()
            found = set()
            for a, b, left, right, _ in _block_rows(table):
                for i, j, near in _tiles(left, right, cosine):
                    x, y = group[a[i : i + SLICE_ROWS]], group[b[j : j + SLICE_ROWS]]
                    rows, columns = np.nonzero(near & (x[:, None] != y[None, :]))
                    found.update(zip(x[rows].tolist(), y[columns].tolist(), strict=True))
            if found:
                a, b = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    spans = members.groupBy("bucket").agg(F.min("group").alias("_low"), F.max("group").alias("_high"), F.count(F.lit(1)).alias("_n"))
    mixed = materialize(spans.filter("_low < _high"))
    members = attach(members, mixed.select("bucket"), ["bucket"], ["node"], counts=mixed.select("bucket", "_n"))
    tasks = _blocked(materialize(members), "bucket").select("task", "own", "one", "node", "group")
    held = attach(materialize(tasks), classes.select("node", "v"), ["node"], ["task"])
    held = held.select("task", "own", "one", "group", "v")
    return sorted_groups(held, ["task"]).mapInArrow(check, "a long, b long")


def _counted(members: DataFrame, cosine: float) -> DataFrame:
    """node and links, the rows of other classes that it is linked with, from members (group, node, n, v)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["task"]):
            weight = table["n"].to_numpy()
            links = np.zeros(len(weight), np.int64)
            for a, b, left, right, one in _block_rows(table):
                for i, j, near in _tiles(left, right, cosine):
                    x, y = a[i : i + SLICE_ROWS], b[j : j + SLICE_ROWS]
                    near &= x[:, None] != y[None, :]
                    links[x] += near @ weight[y]
                    if not one:
                        links[y] += weight[x] @ near
            yield pa.RecordBatch.from_arrays([table["node"].combine_chunks(), pa.array(links)], ["node", "links"])

    tasks = _blocked(members, "group").select("task", "own", "one", "node", "n", "v")
    found = sorted_groups(tasks, ["task"]).mapInArrow(count, "node long, links long")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def near_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    rows = _rows(vectors)
    classes = classes_of(rows)
    k, tables = shape(classes.count(), cosine)
    banded = materialize(_keyed(classes, k, tables)).select("node", F.explode("keys").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("center"))
    shared = materialize(shared.filter("_n > 1"))
    members = materialize(attach(banded, shared.select("bucket", "center"), ["bucket"], ["node"], counts=shared.select("bucket", "_n")))

    pairs = materialize(members.filter("node > center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct())
    links = materialize(_compared(pairs, classes, cosine))
    named = _groups(links)
    rest = members.filter("node > center").select("bucket", "node")
    rest = rest.join(named, "node", "left").select("bucket", "node", F.coalesce("group", "node").alias("group"))
    joint = materialize(_across(rest, classes, cosine))
    if not joint.isEmpty():
        named = _groups(links.unionByName(joint))

    grouped = materialize(named.join(classes.select("node", "n", "low", "v"), "node"))
    found = grouped.select("node", "group").join(_counted(grouped.select("group", "node", "n", "v"), cosine), "node")
    lows = grouped.groupBy("group").agg(F.min("low").alias("component"))
    found = attach(materialize(found), lows, ["group"], ["node"]).select("node", "links", "component")
    told = classes.join(found, "node", "left").select(
        "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component_id")
    )
    counts = classes.select("digest", F.col("n").alias("_n"))
    ids = rows.select("vec_id", "digest")
    out = attach(ids.filter("digest IS NOT NULL"), told, ["digest"], ["vec_id"], counts=counts)
    alone = ids.filter("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _groups(links: DataFrame) -> DataFrame:
    """node and group (its smallest node) of all nodes that links name."""
    found = components(links)
    heads = found.select(F.col("component").alias("node"), F.col("component").alias("group")).distinct()
    return materialize(found.select("node", F.col("component").alias("group")).unionByName(heads))


SQL = """
WITH RECURSIVE plain AS (
    SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), good AS (
    SELECT * FROM plain WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
    SELECT r AS node, vec_id AS id FROM plain UNION SELECT l.a, reach.id FROM reach JOIN links l ON l.b = reach.node
), roots AS (
    SELECT node, min(id) AS component_id FROM reach GROUP BY node
), counts AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM plain JOIN roots ON node = r LEFT JOIN counts ON a = r
"""
