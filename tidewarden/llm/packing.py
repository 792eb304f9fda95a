"""Best-fit packing: documents as pieces of token ids, placed into as few sequences as possible.

`pieces` tokenizes every whole text, adds the end id and cuts what is longer than a sequence; the first
piece of such a document takes the odd length. `pack` places pieces by large-item matching. Pieces longer
than a third of a sequence go at most two to a sequence: from the longest down, each is matched with the
longest one left that still fits beside it. Shorter pieces, from the longest down, go where the smallest
sufficient gap is, and only then open new sequences.

Which piece goes where depends on lengths alone, so the plan is made from the histogram of lengths (at most
`capacity` numbers, the only thing that reaches the driver): every step fills a whole class of equal gaps
with a whole class of equal lengths, and is written down as a run "ranks r to r + n of length L go to
sequences s to s + n at offset o". The numbers of runs depends on the capacity, not on the data. Pieces are
ranked within their length by windows over (length, slice); the number of slices of a length follows its
count, so that a length with a third of all rows is ranked by many tasks. Runs and slice totals are bounded
(see `SLICES`) and broadcast.

Defined cases: a null text is an empty one, and an empty text is one piece with the end id alone; texts are
tokenized whole; equal rows are different pieces, with equal columns in some order; a null doc_id is a
document like any other; an empty table gives no rows; other columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.segments import materialize
from . import arrays
from .memo import Memo
from .spread import small_batches

CAPACITY = 1024
END_ID = 2
SLICES = 1 << 16  # of all lengths together, besides one for each length
ENCODED_AT_ONCE = 2048
SLICE = 1 << 19
REMEMBERED = 400_000  # cuttings, in each worker process
SLICE_ROWS = 4096  # a slice is not made smaller than this

_RUN = "length long, first long, n long, sequence long, offset long"


class Tokens:
    """Token ids of texts. A token never reaches over the start of white space behind a character that is
    none, so texts are cut there; each distinct cutting is tokenized once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would hold memory each
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(REMEMBERED)
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, part: arrays.Part) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the part's texts one after the other, and the bounds of each text."""
        cuts = cuttings(part)
        keys, first, which = np.unique(arrays.hashes(part, cuts), return_index=True, return_inverse=True)
        rows = self.memo.find(keys)
        new = np.flatnonzero(rows < 0)
        stay = self.memo.n, len(self.begin)
        self._add(part, cuts.start[first[new]], cuts.end[first[new]])
        rows[new] = stay[1] + np.arange(len(new))
        if self.memo.room(len(new)):
            self.memo.add(keys[new])
        rows = rows[which]
        length = self.length[rows]
        bounds = np.concatenate(([0], np.cumsum(length)))
        at = np.arange(bounds[-1]) + np.repeat(self.begin[rows] - bounds[:-1], length)
        ids = self.flat[at]
        if self.memo.n == stay[0]:  # no room: what came last is not remembered
            self.begin, self.length = self.begin[: stay[1]], self.length[: stay[1]]
        return ids, bounds[cuts.bounds]

    def _add(self, part: arrays.Part, start: np.ndarray, end: np.ndarray) -> None:
        """Tokenize some stretches of a part and append their ids."""
        raw = part.data.tobytes()
        begin, length = [self.begin], [self.length]
        used = int(self.begin[-1] + self.length[-1]) if len(self.begin) else 0
        for low in range(0, len(start), ENCODED_AT_ONCE):
            few = zip(start[low : low + ENCODED_AT_ONCE].tolist(), end[low : low + ENCODED_AT_ONCE].tolist(), strict=True)
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in few]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            more = int(sizes.sum())
            if used + more > len(self.flat):
                self.flat = np.concatenate((self.flat[:used], np.zeros(max(used, more), np.int32)))
            self.flat[used : used + more] = np.fromiter(chain.from_iterable(found), np.int32, more)
            begin.append(used + np.cumsum(sizes) - sizes)
            length.append(sizes)
            used += more
        self.begin, self.length = np.concatenate(begin), np.concatenate(length)


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_MARK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~")] = True


def cuttings(part: arrays.Part) -> arrays.Spans:
    """Texts cut before each ASCII white space that follows a visible ASCII character or a character of two
    bytes from U+00C0 on (none is white space), and before each ASCII mark that follows a letter. The bar is
    left out, as the name of a special token stands before one."""
    data = part.data
    if not len(data):
        return arrays.Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int64))
    seen = (data > 32) & (data < 127)
    seen[1:] |= (data[1:] >= 128) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    edge = np.zeros(len(data) + 1, bool)
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 128) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    edge[1:-1] = (arrays._SPACE[data[1:]] & seen[:-1]) | (_MARK[data[1:]] & letter[:-1])
    edge[part.bounds] = True
    at = np.flatnonzero(edge)
    return arrays.Spans(at[:-1], at[1:], np.searchsorted(at[:-1], part.bounds))


_TOKENS: dict[str, Tokens] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece, with `ids` also its token ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _TOKENS:  # kept by the worker process for its later tasks
            _TOKENS[tokenizer_path] = Tokens(tokenizer_path)
        tokens = _TOKENS[tokenizer_path]
        for batch in batches:
            for part in arrays.parts(batch.column("text"), SLICE):
                flat, bounds = tokens.of(part)
                rows: list[tuple[int, int, int, int, int]] = []
                held: list[np.ndarray] = []
                for i in range(len(part)):
                    own = np.concatenate((flat[bounds[i] : bounds[i + 1]], np.array([end_id], np.int32)))
                    at, piece = 0, 0
                    while at < len(own):
                        n = (len(own) - at) % capacity or capacity
                        one = own[at : at + n]
                        rows.append((part.first + i, piece, at, n, zlib.crc32(one.astype("<u4").tobytes())))
                        if ids:
                            held.append(one)
                        at, piece = at + n, piece + 1
                whose, *numbers = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                columns = [batch.column("doc_id").take(whose), *numbers]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in held])))
                    columns.append(arrays.list_column(np.concatenate(held), ends, pa.int32()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return small_batches(docs.select("doc_id", "text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, n, first sequence, offset) that place all pieces of a histogram."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    ranks = [0] * (capacity + 1)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # sequences (first, n) by gap
    runs = []
    opened = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, ranks[length], n, sequence, offset))
        ranks[length] += n
        left[length] -= n

    def fill(length: int, sequence: int, n: int, gap: int, each: int) -> None:
        for i in range(each):
            put(length, n, sequence, capacity - gap + i * length)
        gaps[gap - each * length].append((sequence, n))

    third = capacity // 3
    for long in range(capacity, third, -1):
        while left[long]:
            other = min(long, capacity - long)
            while other > third and not (left[other] > (other == long)):
                other -= 1
            if other <= third:
                n = left[long]
                put(long, n, opened, 0)
                gaps[capacity - long].append((opened, n))
            else:
                n = left[long] // 2 if other == long else min(left[long], left[other])
                put(long, n, opened, 0)
                put(other, n, opened, long)
                gaps[capacity - long - other].append((opened, n))
            opened += n
    for short in range(third, 0, -1):
        gap = short
        while left[short]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                each = min(capacity // short, left[short])
                n = left[short] // each
                gaps[capacity].append((opened, n))
                opened, gap = opened + n, capacity
            sequence, there = gaps[gap].pop()
            each = min(gap // short, left[short])
            n = min(there, left[short] // each)
            if n < there:
                gaps[gap].append((sequence + n, there - n))
            fill(short, sequence, n, gap, each)
            gap = short
    return runs


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. `found` needs length (1 to capacity) and columns that order
    equal lengths; it is cut off by a checkpoint, as the histogram and the placement must see the same rows."""
    names = found.columns
    found = materialize(found)
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    slice_rows = max(SLICE_ROWS, -(-total // SLICES))
    slices = spark.createDataFrame([(k, -(-n // slice_rows)) for k, n in counts.items()], "length long, _slices long")
    order = [c for c in names if c not in ("length", "ids")]
    sliced = found.join(F.broadcast(slices), "length").withColumn(
        "_slice", F.pmod(F.xxhash64(*order), F.col("_slices"))
    )
    sizes = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order)) - 1
    ranked = sliced.withColumn("_place", place).join(F.broadcast(sizes), ["length", "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_place"))
    runs = spark.createDataFrame(plan(counts, capacity), _RUN).withColumnsRenamed({"length": "_length", "offset": "_offset"})
    rank = F.col("_rank")
    within = (F.col("length") == F.col("_length")) & (rank >= F.col("first")) & (rank < F.col("first") + F.col("n"))
    return ranked.join(F.broadcast(runs), within).select(
        *names, (F.col("sequence") + rank - F.col("first")).alias("sequence_id"), F.col("_offset").alias("offset")
    )


def assemble(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and its token ids in order. `placed` has the column ids; no group
    is larger than one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
