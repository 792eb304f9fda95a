"""Language identification by hierarchical discrimination.

A text is described by hashed counts of its words and of the runs of one to three bytes in them, with white
space, digits and ASCII marks as one blank and ASCII letters in lower case; each kind of run is a share of
all runs of its kind. First linear support vector machines tell the families of languages apart; then, within
the family that wins, one-versus-one machines separate its languages by votes, margins breaking ties. The
machines have the squared hinge loss and are fitted on the driver on a bounded sample: `PER_LANGUAGE` whole
documents of each language, those whose ids hash lowest.

Scoring needs no counts: the weights of all machines are looked up for every run and added up per text, in
numpy, a few megabytes of text at a time. The weights (a fixed number of buckets times the machines) are
broadcast; their size depends on the number of languages, not on the documents.

Defined cases: a null text or one without a letter is `und` with score 0; texts are read whole; rows with
equal or null ids are judged each for itself; equal votes and margins go to the first name; documents
without a language are not learned from; without any language every result is `und`; with one language
that one is the answer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays, sampling
from .spread import small_batches

PER_LANGUAGE = 600
BUCKETS = 1 << 14  # for each kind of run
KINDS = 4
STEPS = 40
UNKNOWN = "und"

#: Language families by ISO 639-1 code; a code that is not listed is a family by itself.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _FOLD[_c - 32] = _c
_ODD = np.uint32(2654435761)


def runs(part: arrays.Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of run, the buckets of all runs and each text's bounds among them."""
    code = _FOLD[part.data]
    n = len(code)
    for k in (1, 2, 3):
        whole = code[: max(n - k + 1, 0)].copy()
        for j in range(1, k):
            whole = whole * np.uint32(256) + code[j : len(whole) + j]
        inside = np.ones(len(whole), bool)
        if k > 1:  # not over the border of two texts, and not two blanks in a row
            for j in range(1, k):
                at = part.bounds[1:-1] - j
                inside[at[(at >= 0) & (at < len(whole))]] = False
        inside &= whole != {1: 32, 2: 0x2020, 3: 0x202020}[k]
        place = np.flatnonzero(inside)
        bucket = (whole[place] * _ODD) >> np.uint32(18)
        yield bucket.astype(np.int64) + (k - 1) * BUCKETS, np.searchsorted(place, part.bounds)
    words = arrays.words(part)
    codes = arrays.hashes(part, words, lower=True)
    yield (codes >> np.uint64(50)).astype(np.int64) + 3 * BUCKETS, words.bounds


def features(part: arrays.Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of a part: bucket and value of each text's distinct runs, and the bounds of texts."""
    owners, buckets, values = [], [], []
    for bucket, bounds in runs(part):
        counts = np.diff(bounds)
        owner = np.repeat(np.arange(len(part)), counts)
        keys, times = np.unique(owner * (KINDS * BUCKETS) + bucket, return_counts=True)
        owners.append(keys // (KINDS * BUCKETS))
        buckets.append(keys % (KINDS * BUCKETS))
        values.append(times / counts[owners[-1]])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(part) + 1))
    return np.concatenate(buckets)[order], np.concatenate(values)[order], bounds


class _Sample:
    """Sparse rows for fitting."""

    def __init__(self, bucket, value, bounds):
        self.bucket, self.value, self.bounds = bucket, value, bounds
        self.owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def rows(self, chosen: np.ndarray) -> _Sample:
        counts = np.diff(self.bounds)[chosen]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1][chosen] - bounds[:-1], counts)
        return _Sample(self.bucket[at], self.value[at], bounds)

    def times(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.value * weight[self.bucket], len(self.bounds) - 1)

    def back(self, factor: np.ndarray) -> np.ndarray:
        return np.bincount(self.bucket, self.value * factor[self.owner], KINDS * BUCKETS)


def machine(sample: _Sample, positive: np.ndarray) -> np.ndarray:
    """A linear machine with the squared hinge loss, both sides weighing the same: weights and a bias.
    Accelerated gradient steps on rows scaled to length one."""
    y = np.where(positive, 1.0, -1.0)
    length = np.sqrt(np.bincount(sample.owner, sample.value**2, len(y))) + 1e-12
    share = np.where(positive, 0.5 / max(positive.mean(), 1e-9), 0.5 / max(1 - positive.mean(), 1e-9)) / len(y)
    w = np.zeros(KINDS * BUCKETS)
    bias, old_w, old_bias = 0.0, w, 0.0
    for step in range(STEPS):
        pull = step / (step + 3)
        at_w, at_bias = w + pull * (w - old_w), bias + pull * (bias - old_bias)
        slack = np.maximum(0, 1 - y * (sample.times(at_w) / length + at_bias))
        push = 2 * share * y * slack
        old_w, old_bias = w, bias
        w = at_w + 0.25 * (sample.back(push / length) - 1e-4 * at_w)
        bias = at_bias + 0.25 * push.sum()
    # scoring adds unscaled rows: the mean length brings the margins back
    return np.append(w / length.mean(), bias)


def train(sample: _Sample, language: np.ndarray, family_of: dict[str, str]) -> dict:
    names = sorted(set(language.tolist()))
    family = np.array([family_of.get(x, x) for x in language.tolist()])
    families = sorted(set(family.tolist()))
    weights, inside = [], {}
    if len(families) > 1:
        weights = [machine(sample, family == f) for f in families]
    for f in families:
        own = [x for x in names if family_of.get(x, x) == f]
        rows = np.flatnonzero(family == f)
        pairs = []
        for a, b in combinations(own, 2):
            two = rows[np.isin(language[rows], (a, b))]
            pairs.append((a, b, len(weights)))
            weights.append(machine(sample.rows(two), language[two] == a))
        inside[f] = (own, pairs)
    table = np.stack(weights, 1) if weights else np.zeros((KINDS * BUCKETS + 1, 0))
    return {"families": families, "inside": inside, "table": table.astype(np.float32)}


def fit(docs: DataFrame, learn_from: Column | None = None, per_language: int = PER_LANGUAGE, families=None) -> dict | None:
    """Fit on at most `per_language` documents of each language among those that `learn_from` admits; None
    if there are none. `families` maps a family's name to its language codes."""
    family_of = {code: f for f, codes in (families or FAMILIES).items() for code in codes}
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn_from is not None:
        known = known.filter(learn_from)
    # ids below a hash that leaves about twice as many as are wanted of a language, so that no task ranks more
    hashed = F.xxhash64("doc_id")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(hashed).alias("_ids"))
    share = F.least(F.lit(2.0 * per_language) / F.col("_ids") + 64 / F.col("_ids"), F.lit(1.0))
    limits = counts.select("lang", (share * 2.0**63).alias("_limit"))
    near = known.select("doc_id", "lang", hashed.alias("_h")).join(F.broadcast(limits), "lang")
    near = near.filter((F.col("_h").cast("double") / 2 + 2.0**62) <= F.col("_limit")).select("doc_id", "lang", "_h").distinct()
    lowest = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ids = near.withColumn("_n", F.row_number().over(lowest)).filter(F.col("_n") <= per_language).select("doc_id", "lang")
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
    sample = sampling.one_per_id(sample, ["doc_id", "lang"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.parts(batch.column("text")):
                bucket, value, bounds = features(part)
                columns = [
                    batch.column("lang").slice(part.first, len(part)),
                    arrays.list_column(bucket.astype(np.int32), bounds, pa.int32()),
                    arrays.list_column(value.astype(np.float32), bounds, pa.float32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "value"])

    schema = "lang string, bucket array<int>, value array<float>"
    table = small_batches(sample.select("lang", "text")).mapInArrow(describe, schema).toArrow().combine_chunks()
    if not table.num_rows:
        return None
    language = np.array(table["lang"].to_pylist(), object)
    counts = np.array([len(x) for x in table["bucket"]])
    bounds = np.concatenate(([0], np.cumsum(counts)))
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table["bucket"], table["value"])]
    bucket, value = (c.flatten().to_numpy() for c in flat)
    rows = _Sample(bucket.astype(np.int64), value.astype(np.float64), bounds)
    # the same model in whatever order the rows arrive
    sums = np.bincount(rows.owner, rows.value * np.sin(rows.bucket + 1.0), len(counts))
    order = np.lexsort((sums, counts, language.astype(str)))
    return train(rows.rows(order), language[order], family_of)


def predict(model: dict | None, part: arrays.Part) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a part."""
    n = len(part)
    lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
    raw = part.data.tobytes()
    bounds = part.bounds
    lettered = np.array(
        [_LETTER.search(raw[bounds[i] : bounds[i + 1]].decode("utf-8", "replace")) is not None for i in range(n)], bool
    )
    if model is None or not lettered.any():
        return lang, score
    table = model["table"]
    margin = np.zeros((n, table.shape[1])) + table[-1]
    for bucket, ends in runs(part) if table.shape[1] else ():
        count = np.maximum(np.diff(ends), 1)
        for j in range(table.shape[1]):
            margin[:, j] += arrays.sums(table[:, j][bucket], ends) / count
    margin = np.round(margin, 9)  # the same in any batch
    families = model["families"]
    best = margin[:, : len(families)].argmax(1) if len(families) > 1 else np.zeros(n, np.int64)
    chance = _share(margin[:, : len(families)]).max(1) if len(families) > 1 else np.ones(n)
    for k, f in enumerate(families):
        own, pairs = model["inside"][f]
        rows = np.flatnonzero(lettered & (best == k))
        votes = np.zeros((len(rows), len(own)))
        for a, b, j in pairs:
            m = margin[rows, j]
            votes[:, own.index(a)] += (m >= 0) + 0.4 * np.tanh(m) / len(own)
            votes[:, own.index(b)] += (m < 0) - 0.4 * np.tanh(m) / len(own)
        win = votes.argmax(1)
        lang[rows] = np.array(own, object)[win]
        sure = np.ones(len(rows))
        for a, b, j in pairs:
            m = np.where(win == own.index(a), 1, np.where(win == own.index(b), -1, 0)) * margin[rows, j]
            sure = np.where(m != 0, np.minimum(sure, 1 / (1 + np.exp(-3 * np.clip(m, -50, 50)))), sure)
        score[rows] = np.round(chance[rows] * sure, 9)
    return lang, score


def _share(margin: np.ndarray) -> np.ndarray:
    x = np.exp(3 * np.clip(margin - margin.max(1, keepdims=True), -50, 0))
    return x / x.sum(1, keepdims=True)


def languages(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.parts(batch.column("text")):
                lang, score = predict(shared.value, part)
                ids = batch.column("doc_id").slice(part.first, len(part))
                columns = [ids, pa.array(lang.tolist(), pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double")
