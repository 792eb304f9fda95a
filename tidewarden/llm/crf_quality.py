"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line is described by counts of its own and of the lines before and after it (`LINE_FEATURES` each). The
field has one weight per feature for the label good and one weight per pair of neighbouring labels. It is
fitted by gradient ascent on the driver, on a bounded sample of labelled documents (`SAMPLE_DOCS`, those
whose ids hash lowest, and a stretch of `SAMPLE_LINES` lines of each), where every line has its document's
label and every document the same weight. Scoring runs forward and backward over all lines of a text; the
score of a document is the mean of its lines' probabilities to be good, weighted by their lengths, mapped
by a line fitted on the same sample so that it is a probability of a good document.

Two labels make the messages log odds, one number per line, so all texts of a part are walked in step.
Defined cases: a null text is an empty one; an empty text is one empty line and has a score like any other;
texts are scored whole, a few megabytes at a time; rows with equal or null ids are scored each for itself; an
empty table gives no rows; other columns are not read, so their names cannot clash; without labelled
documents of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, sampling
from .spread import small_batches

SAMPLE_DOCS = 6000
SAMPLE_LINES = 48
GOOD_ABOVE = 0.7
STEPS = 150
RIDGE = 1e-3

LINE_FEATURES = (
    "log_chars", "log_words", "mean_word_chars", "digit_share", "upper_share", "space_share", "mark_share",
    "symbol_share", "bar_share", "exclamation_share", "ends_with_stop", "repeated_in_text", "repeated_words",
    "blank", "short",
)

_MARK, _SYMBOL, _BAR, _CLOSING = (np.zeros(256, bool) for _ in range(4))
_MARK[list(b".,;:!?'\"()-")] = True
_SYMBOL[list(b"#*$%&<>@^~=+{}[]\\/_")] = True
_BAR[ord("|")] = True
_CLOSING[list(b".!?:;\"')")] = True


def describe(part: arrays.Part) -> tuple[arrays.Spans, np.ndarray]:
    """The lines of a part and their own features."""
    data = part.data
    lines, words = arrays.lines(part), arrays.words(part)
    owner, n = lines.owner(), len(lines.start)
    length = lines.end - lines.start
    some = np.maximum(length, 1)
    inner = arrays.Spans(lines.start, lines.end, lines.bounds)

    def share(mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        return (np.searchsorted(at, inner.end) - np.searchsorted(at, inner.start)) / some

    first = np.searchsorted(words.start, lines.start)
    n_words = np.searchsorted(words.start, lines.end) - first
    beyond, _ = arrays.repeats(owner, arrays.hashes(part, lines))
    line_of_word = np.searchsorted(lines.start, words.start, "right") - 1
    again, _ = arrays.repeats(line_of_word, arrays.hashes(part, words, lower=True))
    repeated = np.bincount(line_of_word, again, n)
    last = np.zeros(n, bool)
    filled = n_words > 0
    last[filled] = _CLOSING[data[words.end[first[filled] + n_words[filled] - 1] - 1]]
    features = np.stack(
        [
            np.log1p(length),
            np.log1p(n_words),
            np.where(filled, np.minimum(length / np.maximum(n_words, 1), 50), 0),
            share((data >= 48) & (data <= 57)),
            share((data >= 65) & (data <= 90)),
            share(arrays._SPACE[data]),
            share(_MARK[data]),
            share(_SYMBOL[data]),
            share(_BAR[data]),
            share(data == ord("!")),
            last,
            beyond & filled,
            repeated / np.maximum(n_words, 1),
            ~filled,
            n_words < 4,
        ],
        1,
    ).astype(np.float64)
    return lines, features


def neighbours(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Features of each line with those of the lines before and after it (zeros at a text's ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    edge = np.zeros((len(own), 2))
    edge[bounds[:-1], 0] = 1
    edge[bounds[1:] - 1, 1] = 1
    return np.concatenate((own, before, after, edge, np.ones((len(own), 1))), 1)


def _steps(bounds: np.ndarray) -> Iterator[np.ndarray]:
    """For t = 0, 1, ...: the texts with more than t lines, longest first."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    n = len(order)
    for t in range(int(length[0]) if n else 0):
        while n and length[n - 1] <= t:
            n -= 1
        yield order[:n]


def messages(emission: np.ndarray, pair: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds (with the line's own emission) and backward log odds (without) of each line.
    pair[a, b] is the weight of label b behind label a; 1 is good."""
    forward, backward = emission.copy(), np.zeros_like(emission)
    for t, texts in enumerate(_steps(bounds)):
        if t:
            at = bounds[texts] + t
            x = forward[at - 1]
            forward[at] += np.logaddexp(x + pair[1, 1], pair[0, 1]) - np.logaddexp(x + pair[1, 0], pair[0, 0])
            at = bounds[texts + 1] - 1 - t
            x = backward[at + 1] + emission[at + 1]
            backward[at] = np.logaddexp(x + pair[1, 1], pair[1, 0]) - np.logaddexp(x + pair[0, 1], pair[0, 0])
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def document_means(marginal: np.ndarray, lines: arrays.Spans) -> np.ndarray:
    weight = (lines.end - lines.start + 1).astype(np.float64)
    return arrays.sums(marginal * weight, lines.bounds) / arrays.sums(weight, lines.bounds)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(own: np.ndarray, lines: arrays.Spans, good: np.ndarray) -> dict:
    """Fit the field: `good` has a label per text. Adam on the mean log likelihood of the texts."""
    bounds = lines.bounds
    middle, spread = own.mean(0), own.std(0) + 1e-6
    x = neighbours((own - middle) / spread, bounds)
    owner, y = lines.owner(), good[lines.owner()].astype(np.float64)
    n_lines = np.diff(bounds)
    share = np.where(good, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9))
    weight = (share / np.maximum(n_lines, 1) / len(good))[owner]
    linked = np.ones(len(own), bool)
    linked[bounds[1:] - 1] = False
    here = np.flatnonzero(linked)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        pair = theta[-4:].reshape(2, 2)
        emission = x @ theta[:-4]
        forward, backward = messages(emission, pair, bounds)
        marginal = _sigmoid(forward + backward)
        gradient = np.zeros_like(theta)
        gradient[:-4] = x.T @ (weight * (y - marginal))
        # probabilities of the labels of neighbouring lines: a before b
        a, b = forward[here], (emission + backward)[here + 1]
        joint = np.stack([i * a + j * b + pair[i, j] for i in (0, 1) for j in (0, 1)], 1)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint /= joint.sum(1, keepdims=True)
        seen = (2 * y[here] + y[here + 1])[:, None] == np.arange(4)
        gradient[-4:] = (weight[here, None] * (seen - joint)).sum(0)
        gradient -= RIDGE * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = {"middle": middle, "spread": spread, "theta": theta, "scale": (1.0, 0.0)}
    model["scale"] = _calibrate(_log_odds(marginals(model, own, lines)), good)
    return model


def _calibrate(x: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds that fit the labels best (Newton steps, slightly held back)."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * x + shift)
        w = p * (1 - p) + 1e-6
        g = np.array([((good - p) * x).sum() - 0.1 * (slope - 1), (good - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = max(slope + d[0], 0.05), shift + d[1]
    return slope, shift


def marginals(model: dict, own: np.ndarray, lines: arrays.Spans) -> np.ndarray:
    """The weighted mean over a text's lines of their probabilities to be good."""
    x = neighbours((own - model["middle"]) / model["spread"], lines.bounds)
    forward, backward = messages(x @ model["theta"][:-4], model["theta"][-4:].reshape(2, 2), lines.bounds)
    return document_means(_sigmoid(forward + backward), lines)


def score(model: dict | None, part: arrays.Part) -> np.ndarray:
    if model is None:
        return np.full(len(part), 0.5)
    lines, own = describe(part)
    slope, shift = model["scale"]
    return np.round(_sigmoid(slope * _log_odds(marginals(model, own, lines)) + shift), 9)  # the same in any batch


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, rows: int = SAMPLE_DOCS) -> dict | None:
    """Fit on at most `rows` labelled documents among those that `learn_from` (on the labels) admits."""

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.parts(batch.column("text")):
                lines, own = describe(part)
                counts = np.minimum(lines.counts(), SAMPLE_LINES)
                skip = (lines.counts() - counts) // 2
                bounds = np.concatenate(([0], np.cumsum(counts)))
                at = np.arange(bounds[-1]) + np.repeat(lines.bounds[:-1] + skip - bounds[:-1], counts)
                values = np.concatenate((own[at], (lines.end - lines.start)[at, None]), 1)
                flat = arrays.list_column(values.ravel(), bounds * values.shape[1], pa.float64())
                label = batch.column("_label").slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([label, flat], ["label", "lines"])

    sample = sampling.labelled(docs, labels, "quality", rows, learn_from).select("text", "_label")
    table = small_batches(sample).mapInArrow(stretch, "label long, lines array<double>").toArrow().combine_chunks()
    if not table.num_rows:
        return None
    good = table["label"].to_numpy() > 0
    if not (0 < good.sum() < len(good)):
        return None
    held = [np.asarray(x.values).reshape(-1, len(LINE_FEATURES) + 1) for x in table["lines"]]
    order = sorted(range(len(held)), key=lambda i: (good[i], len(held[i]), held[i].tobytes()))
    held, good = [held[i] for i in order], good[order]  # the same model in whatever order the rows arrive
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in held])))
    values = np.concatenate(held)
    length = values[:, -1].astype(np.int64)
    end = np.cumsum(length)
    return train(values[:, :-1], arrays.Spans(end - length, end, bounds), good)


def scores(docs: DataFrame, model: dict | None, good_above: float = GOOD_ABOVE) -> DataFrame:
    """doc_id, score and predicted (1 from `good_above` on) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.parts(batch.column("text")):
                found = score(shared.value, part)
                ids = batch.column("doc_id").slice(part.first, len(part))
                predicted = pa.array((found >= good_above).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found), predicted], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(judge, f"doc_id {kind}, score double, predicted int")
