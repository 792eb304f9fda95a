"""Benchmark decontamination: item-sized windows of documents, SimHash, and exact weighted similarity.

Words are runs of characters other than space and 0x09-0x0D with A-Z lowered; shingles are five consecutive
words (all words of an item that has fewer). A shingle weighs ln(1 + N / (1 + items that hold it)). For every
benchmark item of n words the windows of n words of each text are looked at, at the ends of a text also the
parts of windows that lie in it. A window can only be similar if it holds a shingle of some item, so windows
without one are passed over; this loses nothing. The others get a 64-bit SimHash of their weighted shingles.

Items' fingerprints lie in a multi-index: five blocks of 12 or 13 bits, each entered under all values that
differ in up to floor(radius / 5) bits. By the pigeonhole rule a fingerprint within the radius agrees with an
entry in at least one block, so every pair within the radius is found; its distance is then counted, and the
weighted Jaccard similarity of the two multisets of shingles decides, exactly.

The benchmark is the stated query set: it is read in blocks of about `BLOCK_ITEMS` items, and each block's
index is broadcast and compared with all documents in one pass without a shuffle. N and the items that hold a
shingle are counted over the whole benchmark once; with more than one block, the numbers of items of all its
shingles (two sorted arrays) are broadcast with every block, so weights do not depend on blocks. Defined cases: null and blank items match nothing; null and blank texts hold nothing; texts are
read whole; equal items are all reported; rows with equal or null ids are judged each for itself, links
carry the ids as they are; empty tables give no links; other columns are carried apart from the working
columns, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .spread import small_batches

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = (13, 13, 13, 13, 12)
BLOCK_ITEMS = 4096
STRETCH = 8192
_BITS = 1 << 20
_U = np.uint64


def word_codes(part: arrays.Part) -> tuple[np.ndarray, np.ndarray]:
    words = arrays.words(part)
    return arrays.hashes(part, words, lower=True), words.bounds


def _signs(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view("<u8").ravel()


class Length:
    """The items of one number of words, with their multi-index."""

    def __init__(self, words: int, items: list[int], prints: np.ndarray, radius: int):
        self.words, self.items, self.prints, self.radius = words, np.array(items), prints, radius
        self.index = []
        low = 0
        for bits in BLOCKS:
            value = ((prints >> _U(low)) & _U((1 << bits) - 1)).astype(np.int64)
            masks = [sum(1 << b for b in c) for k in range(radius // len(BLOCKS) + 1) for c in combinations(range(bits), k)]
            entry = (value[:, None] ^ np.array(masks)[None, :]).ravel()
            owner = np.repeat(np.arange(len(prints)), len(masks))
            order = np.argsort(entry, kind="stable")
            starts = np.searchsorted(entry[order], np.arange((1 << bits) + 1))
            self.index.append((low, bits, starts.astype(np.int32), owner[order].astype(np.int16)))
            low += bits

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) within the radius."""
        found = []
        for low, bits, starts, owner in self.index:
            value = ((prints >> _U(low)) & _U((1 << bits) - 1)).astype(np.int64)
            counts = starts[value + 1] - starts[value]
            bounds = np.concatenate(([0], np.cumsum(counts)))
            at = np.arange(bounds[-1]) + np.repeat(starts[value] - bounds[:-1], counts)
            found.append(np.repeat(np.arange(len(prints)), counts) * len(self.items) + owner[at])
        pairs = np.unique(np.concatenate(found))
        window, item = pairs // len(self.items), pairs % len(self.items)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
        return window[close], item[close]


def _bags(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, int, Counter]]:
    """Number, words, shingle size and shingles of each text that has words."""
    for part in arrays.parts(column):
        codes, bounds = word_codes(part)
        for i in range(len(part)):
            own = codes[bounds[i] : bounds[i + 1]]
            if len(own):
                k = min(shingle, len(own))
                yield part.first + i, len(own), k, Counter(arrays.runs(own, np.array([0, len(own)]), k)[0].tolist())


class Weights:
    """Weights of shingles, from the number of items and sorted shingles with the items that hold each."""

    def __init__(self, n: int, shingles: np.ndarray, held: np.ndarray):
        self.n, self.shingles = n, shingles
        self.values = np.log1p(n / (1 + held))
        self.new = float(np.log1p(n))

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingles), self.new)
        place = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[place] == shingles, self.values[place], self.new)


class Benchmark:
    """Items as shingles, weights and one multi-index per number of words. Without `weights`, which are those
    of the whole benchmark, the items are all there are."""

    def __init__(self, ids: list, texts: list[str | None], shingle: int = SHINGLE, radius: int = RADIUS, weights: Weights | None = None):
        self.ids, self.bags, self.sizes = [], [], []
        for i, size, k, bag in _bags(pa.array([t or "" for t in texts], pa.string()), shingle):
            self.ids.append(ids[i])
            self.sizes.append(size)
            self.bags.append((k, bag))
        held = Counter(s for _, bag in self.bags for s in bag)
        self.n = len(self.bags)
        own = np.array(sorted(held), _U)
        self.all = weights or Weights(self.n, own, np.array([held[s] for s in own.tolist()], np.int64))
        self.weights = dict(zip(own.tolist(), self.all.of(own).tolist(), strict=True))
        self.new_weight = self.all.new
        self.totals = [sum(self.weights[s] * c for s, c in bag.items()) for _, bag in self.bags]
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, list[Length]]] = {}
        for k in sorted({k for k, _ in self.bags}):
            known = np.unique(np.array([s for kk, bag in self.bags if kk == k for s in bag], _U))
            seen = np.zeros(_BITS, bool)
            seen[(known & _U(_BITS - 1)).astype(np.int64)] = True
            lengths = []
            for n in sorted({n for n, (kk, _) in zip(self.sizes, self.bags, strict=True) if kk == k}):
                items = [i for i in range(self.n) if self.sizes[i] == n and self.bags[i][0] == k]
                sums = np.stack([self._sum(self.bags[i][1]) for i in items])
                lengths.append(Length(n, items, _pack(sums), radius))
            self.groups[k] = (known, seen, lengths)

    def _sum(self, bag: Counter) -> np.ndarray:
        keys = np.array(list(bag), _U)
        weight = np.array([self.weights[s] * c for s, c in bag.items()])
        return (_signs(keys) * weight[:, None]).sum(0)

    def similarity(self, item: int, shingles: list[int]) -> float:
        bag, own = self.bags[item][1], Counter(shingles)
        of_own = self.all.of(np.array(list(own), _U)).tolist()
        total = sum(w * c for w, c in zip(of_own, own.values(), strict=True))
        both = sum(self.weights[s] * min(c, bag[s]) for s, c in own.items() if s in bag)
        return both / (total + self.totals[item] - both)

    def search(self, part: arrays.Part, at_least: float) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity) of the best window of each similar pair."""
        codes, bounds = word_codes(part)
        best: dict[tuple[int, int], tuple] = {}
        for k, (known, seen, lengths) in self.groups.items():
            shingles, ends = arrays.runs(codes, bounds, k)
            maybe = np.flatnonzero(seen[(shingles & _U(_BITS - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)
            hits = maybe[known[place] == shingles[maybe]]
            if not len(hits):
                continue
            texts, first = np.unique(np.searchsorted(ends, hits, "right") - 1, return_index=True)
            for text, own_hits in zip(texts.tolist(), np.split(hits, first[1:]), strict=True):
                own = shingles[ends[text] : ends[text + 1]]
                self._text(text, own, own_hits - ends[text], k, lengths, at_least, best)
        return [(text, item, *found) for (text, item), found in sorted(best.items())]

    def _text(self, text, shingles, hits, k, lengths, at_least, best) -> None:
        longest = max(x.words for x in lengths)
        for low, high in _stretches(hits, longest, len(shingles)):
            own = shingles[low:high]
            weight = self.all.of(own)
            total = np.concatenate((np.zeros((1, 64)), np.cumsum(_signs(own) * weight[:, None], 0)))
            near = hits[(hits >= low) & (hits < high)] - low
            for length in lengths:
                size = length.words - k + 1  # shingles of a window
                reach = np.zeros(len(own) + size + 1, np.int64)
                np.add.at(reach, near, 1)  # starts are counted from -(size - 1)
                np.add.at(reach, near + size, -1)
                start = np.flatnonzero(np.cumsum(reach)[:-1] > 0) - (size - 1)
                inner = (start >= 0) & (start + size <= len(own))
                edge = ((start < 0) & (low == 0)) | ((start + size > len(own)) & (high == len(shingles)))
                start = start[inner | edge]
                first, last = np.maximum(start, 0), np.minimum(start + size, len(own))
                window, item = length.near(_pack(total[last] - total[first]))
                for w, i in zip(window.tolist(), length.items[item].tolist(), strict=True):
                    a, b = int(first[w]), int(last[w])
                    same = self.similarity(i, own[a:b].tolist())
                    if same >= at_least and same > best.get((text, i), (0, 0, 0.0))[2]:
                        best[text, i] = (low + a, b - a + k - 1, same)


def _stretches(hits: np.ndarray, longest: int, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of shingles that hold all windows around the hits; long ones are cut, and overlap there."""
    begin = 0
    for i in range(1, len(hits) + 1):
        if i == len(hits) or hits[i] - hits[i - 1] > 2 * longest or hits[i] - hits[begin] > STRETCH:
            yield max(int(hits[begin]) - longest, 0), min(int(hits[i - 1]) + longest + 1, n)
            begin = i


def _weights(items: DataFrame) -> Weights:
    """Weights over the whole benchmark."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, bag in _bags(batch.column("text"), SHINGLE):
                codes = np.array([0, *bag], _U).view(np.int64)
                item = np.arange(len(codes)) == 0  # a row for the item, and one for each of its shingles
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(item)], ["shingle", "item"])

    rows = small_batches(items.select("text")).mapInArrow(emit, "shingle long, item boolean")
    counts = rows.groupBy("item", "shingle").agg(F.count(F.lit(1)).alias("n")).toArrow()
    item = counts["item"].to_numpy(zero_copy_only=False)
    shingles, n = counts["shingle"].to_numpy()[~item].view(_U), counts["n"].to_numpy()
    order = np.argsort(shingles)
    return Weights(int(n[item].sum()), shingles[order], n[~item][order])


def _blocks(benchmark: DataFrame, size: int) -> Iterator[Benchmark]:
    """The benchmark's items in blocks of about `size`, in the order of a hash."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    n = -(-items.count() // size)
    weights = _weights(items) if n > 1 else None
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        found = Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows], weights=weights)
        if found.n:
            yield found


def links(docs: DataFrame, benchmark: DataFrame, at_least: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, start_word, n_words and similarity of the best window of each similar pair."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, start_word long, n_words long, similarity double"
    spark = docs.sparkSession
    out = None
    for block in _blocks(benchmark, block_items):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for part in arrays.parts(batch.column("text")):
                    rows = items.search(part, at_least)
                    if rows:
                        text, item, start, n, same = zip(*rows, strict=True)
                        columns = [
                            batch.column("doc_id").take(pa.array([part.first + t for t in text])),
                            pa.array([items.ids[i] for i in item]),
                            pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(same, pa.float64()),
                        ]
                        names = ["doc_id", "item_id", "start_word", "n_words", "similarity"]
                        yield pa.RecordBatch.from_arrays(columns, names)

        found = small_batches(docs.select("doc_id", "text")).mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, at_least: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents without a window similar to an item, with all their columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index("text")]
    out = docs.toDF(*names)
    for block in _blocks(benchmark, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {
                    part.first + row[0] for part in arrays.parts(batch.column(at)) for row in shared.value.search(part, at_least)
                }
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))

        out = small_batches(out).mapInArrow(keep, out.schema)
    return out.toDF(*docs.columns)
