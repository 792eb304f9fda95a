"""Quality rules: gradient-boosted trees over document statistics.

`statistics` counts what the rules look at in every whole text. `fit` boosts small histogram trees with the
logistic loss on a bounded sample of labelled documents (`SAMPLE_ROWS`, those whose ids hash lowest) and
flattens them into node arrays. `verdicts` walks all trees for a batch of documents at once in numpy. More
symbols, repeated lines or repeated words can never raise the probability of a good document: splits that
would break this are refused, and the values below a split stay on their side of its middle.

Words are runs of characters other than space and 0x09-0x0D. Defined cases: a null text has no words and one
empty line; empty and short texts fail the base rule; texts of any length are read whole, a few megabytes at
a time; repeated rows and rows with a null id are judged each for itself; an empty table gives no rows;
other columns are not read, so their names cannot clash. Without labelled rows of both kinds there is no
model, and the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, sampling
from .spread import small_batches

SAMPLE_ROWS = 8192
TREES = 40
DEPTH = 3
BINS = 64
RATE = 0.2
KEEP_ABOVE = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "mean_word_chars", "symbol_share", "dup_line_share", "repeat_word_share",
    "words_per_line", "distinct_word_share", "digit_share", "upper_share", "stop_mark_share",
    "bar_share", "one_char_word_share",
)
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_word_share": -1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def _measure(part: arrays.Part) -> tuple[np.ndarray, np.ndarray]:
    """The counts and the features of the texts of a part."""
    data = part.data
    words, lines = arrays.words(part), arrays.lines(part)
    codes = arrays.hashes(part, words)
    n_words = words.counts()
    chars = arrays.char_counts(part, words)
    word_chars = arrays.sums(chars, words.bounds)
    n_symbols = arrays.sums(_SYMBOL[data], part.bounds)

    worded = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    owner = lines.owner()
    later = np.zeros(len(owner), bool)
    later[worded], _ = arrays.repeats(owner[worded], arrays.hashes(part, lines)[worded])
    n_dup_lines = arrays.sums(later, lines.bounds)

    windows, window_bounds = arrays.runs(codes, words.bounds, 5)
    window_owner = np.repeat(np.arange(len(part)), np.diff(window_bounds))
    _, doubled = arrays.repeats(window_owner, windows)
    at = np.flatnonzero(doubled)
    at = at - window_bounds[window_owner[at]] + words.bounds[window_owner[at]]
    steps = np.zeros(len(codes) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + 5, -1)
    n_repeat_words = arrays.sums(np.cumsum(steps[:-1]) > 0, words.bounds)
    counts = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], 1).astype(np.int64)

    word_owner = words.owner()
    again, _ = arrays.repeats(word_owner, codes)
    all_chars = np.maximum(arrays.sums((data & 0xC0) != 0x80, part.bounds), 1)
    n_lines = np.maximum(arrays.sums(worded, lines.bounds), 1)
    some = np.maximum(n_words, 1)
    digits = arrays.sums((data >= 48) & (data <= 57), part.bounds)
    upper = arrays.sums((data >= 65) & (data <= 90), part.bounds)
    features = np.stack(
        [
            word_chars / some,
            n_symbols / all_chars,
            n_dup_lines / n_lines,
            n_repeat_words / some,
            n_words / n_lines,
            1 - arrays.sums(again, words.bounds) / some,
            digits / all_chars,
            upper / all_chars,
            arrays.sums(_STOP[data], part.bounds) / some,
            arrays.sums(data == ord("|"), part.bounds) / some,
            arrays.sums(chars == 1, words.bounds) / some,
        ],
        1,
    )
    return counts, features


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.parts(batch.column("text")):
            _, features = _measure(part)
            label = batch.column("_label").slice(part.first, len(part))
            bounds = np.arange(len(part) + 1) * features.shape[1]
            columns = [label, arrays.list_column(features.ravel(), bounds, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "features"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict | None:
    """Boost the trees on at most `rows` labelled documents; None without documents of both kinds."""
    sample = sampling.labelled(docs, labels, "quality", rows).select("text", "_label")
    table = small_batches(sample).mapInArrow(_statistics, "label long, features array<double>").toPandas()
    y = table["label"].to_numpy(np.int64) if len(table) else np.zeros(0, np.int64)
    if not (0 < (y > 0).sum() < len(y)):
        return None
    return boost(np.stack(table["features"].to_list()), y > 0)


def boost(x: np.ndarray, good: np.ndarray) -> dict:
    """Histogram boosting with the logistic loss; both labels weigh the same in total."""
    order = np.lexsort((*x.T, good))
    x, good = x[order], good[order]  # the same model in whatever order the rows arrive
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(x.shape[1])], 1)
    signs = [MONOTONE.get(name, 0) for name in FEATURES]
    score = np.zeros(len(x))
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots = []

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = slope[rows].sum(), curve[rows].sum()
        value = float(np.clip(g / (h + 1.0), low, high))
        me = len(nodes["value"])
        for key, v in zip(nodes, (0, 0.0, me, me, RATE * value), strict=True):
            nodes[key].append(v)
        best = None
        for j in range(x.shape[1]) if depth < DEPTH else ():
            gs = np.bincount(bins[rows, j], slope[rows], len(edges[j]) + 1).cumsum()[:-1]
            hs = np.bincount(bins[rows, j], curve[rows], len(edges[j]) + 1).cumsum()[:-1]
            left, right = np.clip(gs / (hs + 1), low, high), np.clip((g - gs) / (h - hs + 1), low, high)
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            allowed = (hs > 2) & (h - hs > 2) & ((right - left) * signs[j] >= 0)
            gain = np.where(allowed, gain, 0)
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k, (left[k] + right[k]) / 2)
        if best is None:
            step[rows] = RATE * value
            return me
        _, j, k, middle = best
        goes_left = bins[rows, j] <= k
        halves = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        lower, upper = halves.get(signs[j], ((low, high), (low, high)))
        nodes["feature"][me], nodes["cut"][me] = j, float(edges[j][k])
        nodes["left"][me] = grow(rows[goes_left], depth + 1, *lower)
        nodes["right"][me] = grow(rows[~goes_left], depth + 1, *upper)
        return me

    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-score))
        slope, curve = weight * (good - chance), weight * chance * (1 - chance)
        step = np.zeros(len(x))
        roots.append(grow(np.arange(len(x)), 0, -4.0, 4.0))
        score += step
    return {"roots": roots, **nodes}


def evaluate(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of a good document for each row of features."""
    feature, left, right = (np.asarray(model[k], np.int64) for k in ("feature", "left", "right"))
    cut, value = np.asarray(model["cut"]), np.asarray(model["value"])
    at = np.tile(np.asarray(model["roots"], np.int64), (len(x), 1))
    rows = np.arange(len(x))[:, None]
    for _ in range(DEPTH):
        at = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
    return 1 / (1 + np.exp(-value[at].sum(1)))


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def verdicts(docs: DataFrame, model: dict | None, keep_above: float = KEEP_ABOVE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts, base_failed, score (null without a model) and kept for each document; `carry`
    names further columns of `docs` that are passed on, whatever they are called."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passed = [F.col(f"`{c}`").alias(f"_carry{i}") for i, c in enumerate(carry)]
    chosen = docs.select("doc_id", "text", *passed)
    kept_fields = [f for f in chosen.schema.fields if f.name.startswith("_carry")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for part in arrays.parts(batch.column("text")):
                counts, features = _measure(part)
                failed = base_failed(counts[:, 0], counts[:, 4])
                score = evaluate(trees, features) if trees else np.full(len(part), np.nan)
                kept = ~failed & (score > keep_above) if trees else ~failed
                columns = [batch.column("doc_id").slice(part.first, len(part))]
                columns += [pa.array(counts[:, i]) for i in range(len(COUNTS))]
                columns += [pa.array(failed), pa.array(score, from_pandas=True), pa.array(kept)]
                columns += [batch.column(f.name).slice(part.first, len(part)) for f in kept_fields]
                names = ["doc_id", *COUNTS, "base_failed", "score", "kept", *(f.name for f in kept_fields)]
                yield pa.RecordBatch.from_arrays(columns, names)

    out = f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}"
    out += "".join(f", {c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    out += "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept_fields)
    return small_batches(chosen).mapInArrow(judge, out)


def keep_good(docs: DataFrame, model: dict | None) -> DataFrame:
    """The documents with a good verdict, with all their columns."""
    judged = verdicts(docs, model, carry=tuple(docs.columns)).filter("kept")
    return judged.select(*(F.col(f"_carry{i}").alias(c) for i, c in enumerate(docs.columns)))
