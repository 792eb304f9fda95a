"""Token counts: greedy longest-match word-piece lengths from an automaton, without building the pieces.

A word stands for its bytes behind one space, as vocabularies with a leading word mark write it. From the
left, the longest vocabulary entry is cut off again and again. `Automaton.build` puts the vocabulary into a
trie; each node gets a failure link to the node of what is left over when the pieces that are certain by
then are popped, and the number of those pieces. Matching follows one edge per byte and adds popped counts
along failure links, so it is linear in the text and never steps back. All distinct words of a part are
matched in step, byte by byte, in numpy; counts of words seen before come from a bounded memory.

The automaton is built on the driver from a vocabulary file (size fixed by that file, not by the data) and
broadcast. A word with a byte that no entry continues counts as one unknown piece. Defined cases: a null or
blank text has no words and no pieces; texts are read whole, a few megabytes at a time, and a word may be as
long as its text; rows with equal or null ids are counted each for itself; an empty table gives no rows;
other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import json
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays
from .memo import Memo
from .spread import small_batches

_UNKNOWN = 1 << 40


def vocabulary(path: str) -> list[bytes]:
    """The entries of a rank file (base64 and number) or of a byte-level tokenizer file, as bytes."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_byte = {chr(b): b for b in shown}
    as_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [bytes(as_byte[c] for c in e) for e in entries if all(c in as_byte for c in e)]


@dataclass(frozen=True)
class Automaton:
    """Edges as sorted numbers node * 256 + byte with their targets; failure link (-1: none) and popped
    pieces of each node. Node 0 is the root."""

    edges: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    popped: np.ndarray

    @staticmethod
    def build(entries: Iterable[bytes]) -> Automaton:
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for entry in entries:
            node = 0
            for byte in entry:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    whole.append(False)
                node = children[node][byte]
            whole[node] = node != 0
        link, popped = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent].items():
                queue.append(node)
                if whole[node]:
                    link[node], popped[node] = 0, 1
                    continue
                pieces, at = popped[parent], link[parent]
                while at >= 0 and byte not in children[at]:
                    pieces, at = pieces + popped[at], link[at]
                if at >= 0:
                    link[node], popped[node] = children[at][byte], pieces
        edges = np.array([n * 256 + b for n, c in enumerate(children) for b in c], np.int64)
        targets = np.array([t for c in children for t in c.values()], np.int64)
        order = np.argsort(edges)
        return Automaton(edges[order], targets[order], np.array(link), np.array(popped))

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node along an edge, -1 where there is none."""
        if not len(self.edges):
            return np.full(len(node), -1)
        wanted = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
        return np.where(self.edges[at] == wanted, self.targets[at], -1)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of a space and data[start:end] for each range."""
        order = np.argsort(start - end)  # the longest first: those still at work are a prefix
        start, length = start[order], (end - start)[order]
        pieces = np.zeros(len(start), np.int64)
        node = np.zeros(len(start), np.int64)
        longest = int(length[0]) if len(length) else -1
        active = np.searchsorted(-length, -np.arange(longest + 2), "right") if longest < 4096 else None
        for t in range(longest + 1):
            n = int(active[t]) if active is not None else int(np.searchsorted(-length, -t, "right"))
            byte = data[start[:n] + t - 1] if t else np.full(n, 32, np.uint8)
            at, todo = node[:n].copy(), np.flatnonzero(pieces[:n] < _UNKNOWN)
            while len(todo):
                next_node = self.step(at[todo], byte[todo])
                moved = next_node >= 0
                at[todo[moved]] = next_node[moved]
                todo = self._fall(at, pieces, todo[~moved])
            node[:n] = at
        todo = np.flatnonzero((node > 0) & (pieces < _UNKNOWN))
        while len(todo):
            todo = self._fall(node, pieces, todo)
            todo = todo[node[todo] > 0]
        out = np.empty(len(start), np.int64)
        out[order] = np.where(pieces >= _UNKNOWN, 1, pieces)
        return out

    def _fall(self, node: np.ndarray, pieces: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Follow failure links; words without one are unknown and drop out."""
        link = self.link[node[todo]]
        pieces[todo] += self.popped[node[todo]]
        pieces[todo[link < 0]] = _UNKNOWN
        todo, link = todo[link >= 0], link[link >= 0]
        node[todo] = link
        return todo


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.build(vocabulary(vocabulary_path)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memo, known = shared.value, Memo(), np.zeros(0, np.int64)
        for batch in batches:
            for part in arrays.parts(batch.column("text"), 1 << 22):
                words = arrays.words(part)
                keys, first, which = np.unique(arrays.hashes(part, words), return_index=True, return_inverse=True)
                rows = memo.find(keys)
                new = np.flatnonzero(rows < 0)
                at = first[new]
                found = np.empty(len(keys), np.int64)
                found[rows >= 0] = known[rows[rows >= 0]]
                found[new] = automaton.counts(part.data, words.start[at], words.end[at])
                if memo.room(len(new)):
                    memo.add(keys[new])
                    known = np.concatenate((known, found[new]))
                n_tokens = arrays.sums(found[which], words.bounds)
                ids = batch.column("doc_id").slice(part.first, len(part))
                columns = [ids, pa.array(words.counts()), pa.array(n_tokens)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
