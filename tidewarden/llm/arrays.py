"""Words, lines and their hashes for a whole Arrow batch of texts at once.

A batch's text column is one byte buffer. Words are maximal runs of bytes other than space and 0x09-0x0D,
lines are the parts between line feeds; both can be found on bytes, because bytes of longer UTF-8
characters never take those values. Hashes are 64 bits wide and chained over steps of 8 bytes, all words of
a slice at once. Callers walk a batch in slices of half a megabyte, which bounds the memory: a dozen arrays with
eight bytes for each byte of text are held at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: glibc's call for it; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

SLICE_BYTES = 1 << 19
SLICE_TEXTS = 1 << 13
_BLOCK = 256
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values over all bits."""
    x = np.asarray(x, _U).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0xD1342543DE82EF95
_SEED = 0x5851F42D4C957F2D


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is an empty one."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), bounds


def give_back() -> None:
    """Hand freed memory back to the system. Workers live as long as their executor, and allocators keep what
    large arrays of earlier batches took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


@dataclass(frozen=True)
class Part:
    """Some consecutive texts of a batch: their bytes, offsets into them, and the first one's number."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def parts(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Part]:
    """Slices of a batch with about `size` bytes of text each, one text at least and `SLICE_TEXTS` at most."""
    data, bounds = text_buffer(column)
    low, n = 0, len(bounds) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + size, "right")) - 1)
        high = min(high, low + SLICE_TEXTS)
        yield Part(low, data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
        low = high
    give_back()


@dataclass(frozen=True)
class Spans:
    """Byte ranges in a part in order of place; those of text i are bounds[i] to bounds[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def words(part: Part) -> Spans:
    if not len(part.data):
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int64))
    solid = ~_SPACE[part.data]
    edge = np.zeros(len(solid) + 1, bool)
    edge[part.bounds] = True
    start = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate(([False], solid[:-1]))))
    end = np.flatnonzero(solid & (edge[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    return Spans(start, end, np.searchsorted(start, part.bounds))


def lines(part: Part) -> Spans:
    """The parts between line feeds; an empty text is one empty line."""
    feeds = np.flatnonzero(part.data == 10)
    n = len(part)
    start = np.concatenate((part.bounds[:-1], feeds + 1))
    end = np.concatenate((feeds, part.bounds[1:]))
    owner = np.concatenate((np.arange(n), np.searchsorted(part.bounds, feeds, "right") - 1))
    last = np.concatenate((owner[n:], np.arange(n)))
    start = start[np.lexsort((start, owner))]
    end = end[np.lexsort((end, last))]
    counts = np.bincount(owner, minlength=n)
    return Spans(start, end, np.concatenate(([0], np.cumsum(counts))))


#: Masks of the first n bytes of a number, n from 0 to 8.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def _step(state: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """The next state of a hash; one to one in either argument, and linear in none."""
    chunk ^= state
    chunk *= _U(_BASE)
    chunk ^= chunk >> _U(29)
    chunk *= _U(_SEED)
    chunk ^= chunk >> _U(32)
    return chunk


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data on as a number, as a view; behind the end are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashes(part: Part, spans: Spans, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; with `lower`, A-Z count as a-z. Spans are taken in steps of 8
    bytes, each mixed into the state before the next one; spans over `_BLOCK` bytes by xxh3."""
    data = _LOWER[part.data] if lower else part.data
    length = spans.end - spans.start
    words = eight_bytes(data)
    with np.errstate(over="ignore"):
        out = length.astype(_U)
        out *= _U(_BASE)
        first = words[spans.start] & _KEEP[np.minimum(length, 8)]
        out = _step(out, first)
        left = np.flatnonzero((length > 8) & (length <= _BLOCK))
        at, size, state = spans.start[left], length[left], out[left]
        while len(left):
            at, size = at + 8, size - 8
            state = _step(state, words[at] & _KEEP[np.minimum(size, 8)])
            done = size <= 8
            out[left[done]] = state[done]
            on = ~done
            left, at, size, state = left[on], at[on], size[on], state[on]
    for i in np.flatnonzero(length > _BLOCK):
        out[i] = xxhash.xxh3_64_intdigest(data[spans.start[i] : spans.end[i]].data, _SEED)
    return mix(out)


def same_bytes(part: Part, spans: Spans, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans a[i] and b[i] hold the same bytes."""
    length = spans.end - spans.start
    same = length[a] == length[b]
    words = eight_bytes(part.data)
    left = np.flatnonzero(same)
    x, y, size = spans.start[a[left]], spans.start[b[left]], length[a[left]]
    while len(left):
        equal = (words[x] ^ words[y]) & _KEEP[np.minimum(size, 8)] == 0
        same[left[~equal]] = False
        on = equal & (size > 8)
        left, x, y, size = left[on], x[on] + 8, y[on] + 8, size[on] - 8
    return same


def runs(codes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive codes that lie in one text, and the bounds of each text's hashes."""
    counts = np.maximum(np.diff(bounds) - (k - 1), 0)
    new = np.concatenate(([0], np.cumsum(counts)))
    if not new[-1]:
        return np.zeros(0, _U), new
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) - k + 1, _U)
        for j, factor in enumerate(random_words(k, 11) | _U(1)):
            total += codes[j : len(codes) - k + 1 + j] * factor
    at = np.arange(new[-1]) + np.repeat(bounds[:-1] - new[:-1], counts)
    return mix(total[at]), new


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; of a mask, the number of places that are set."""
    if values.dtype == bool:
        return np.diff(np.searchsorted(np.flatnonzero(values), bounds))
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def char_counts(part: Part, spans: Spans) -> np.ndarray:
    """Code points in each span."""
    inner = np.flatnonzero((part.data & 0xC0) == 0x80)
    if not len(inner):
        return spans.end - spans.start
    return spans.end - spans.start - (np.searchsorted(inner, spans.end) - np.searchsorted(inner, spans.start))


def repeats(owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code: whether it is beyond the one that each group of equal codes of a text is allowed (any
    one of them), and whether an equal code stands elsewhere in the text."""
    keys = codes ^ mix(owner.astype(_U))
    order = np.argsort(keys)
    keys = keys[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    beyond, any_other = np.zeros(len(order), bool), np.zeros(len(order), bool)
    beyond[order] = same[:-1]
    any_other[order] = same[:-1] | same[1:]
    return beyond, any_other


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array column from flat values and the bounds of its rows."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
