"""Mail digests: mails of a subject are gathered, sent after growing waits, and cut in the middle.

The send times of a subject depend only on where its mails leave gaps longer than the shortest
wait, because any wait within a dense stretch finds mail. So the mails are first reduced, in
parallel, to stretches (start, end); the timers then run over the stretches of a subject, whose
number is bounded by time and not by mail volume; and the mails are finally assigned to digests.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import period_millis
from .ordered import OrderedRows
from .segments import Cuts, find_cuts, position

SEPARATOR = "\n\n---\n\n"
#: Mails that a task gathers before it cuts them to the ends of their digests.
BUFFER_ROWS, BUFFER_BYTES = 1 << 16, 32 << 20


def waits_micros(backoff: str) -> list[int]:
    """Waits of a setting such as "PT3S PT5M PT1H"; the last one repeats."""
    return [period_millis(p) * 1000 for p in backoff.split()]


def stretches(mails: DataFrame, shortest: int, cuts: Cuts | None = None) -> DataFrame:
    """Maximal runs of a subject's mails with no gap longer than `shortest` microseconds."""
    rows = OrderedRows(
        mails.select("subject", "arrival", position(mails, "ts").alias("at")),
        ["subject"],
        ["at", "arrival"],
        cuts,
    )
    rows = rows.previous(_before="at")
    fresh = F.col("_before").isNull() | (F.col("at") - F.col("_before") > shortest)
    rows = rows.last_known(inclusive=True, start=F.when(fresh, F.col("at")))
    return rows.df.groupBy("subject", "start").agg(F.max("at").alias("end"))


def run_timers(
    starts: list[int], ends: list[int], waits: list[int], outages: list[tuple[int, int]], stop: int
) -> list[tuple[int, int, bool]]:
    """Digests (from, sent, flushed) of one subject; `from` inclusive, `sent` exclusive."""

    def next_mail(at: int) -> int | None:
        """First moment from `at` on that surely has mail before the next timer, or none."""
        i = bisect_right(starts, at) - 1
        if i >= 0 and at <= ends[i]:
            return at
        return starts[i + 1] if i + 1 < len(starts) else None

    def sending_fails(at: int) -> bool:
        return any(a <= at < b for a, b in outages)

    digests = []
    opened = starts[0] if starts else None
    while opened is not None:
        step, begin, due, holding = 0, opened, opened + waits[0], True
        opened = None
        while due <= stop:
            if not holding:
                mail = next_mail(begin)
                if mail is None or mail >= due:
                    i = bisect_left(starts, due)
                    opened = starts[i] if mail is not None and i < len(starts) else None
                    break
            if sending_fails(due):
                holding = True
                due += waits[step]
                continue
            digests.append((begin, due, False))
            begin, holding = due, False
            step = min(step + 1, len(waits) - 1)
            due += waits[step]
        else:
            mail = begin if holding else next_mail(begin)
            if mail is not None and mail <= stop:
                digests.append((begin, stop + 1, True))
    return digests


def digest_spans(
    mails: DataFrame,
    backoff: str,
    stop: Column,
    outages: list[tuple[int, int]] | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    """subject, digest, from_us, to_us, flushed: which mails go into which digest.
    `outages`: intervals in microseconds during which sending fails and is retried. `stop` is the
    moment at which all buffers are flushed; mails after it are not looked at."""
    waits = waits_micros(backoff)
    outages = outages or []

    def per_subject(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        spans = run_timers(
            pdf["start"].tolist(), pdf["end"].tolist(), waits, outages, int(pdf["stop"].iloc[0])
        )
        return pd.DataFrame(
            {
                "subject": pdf["subject"].iloc[0],
                "digest": range(len(spans)),
                "from_us": [s[0] for s in spans],
                "to_us": [s[1] for s in spans],
                "flushed": [s[2] for s in spans],
            }
        )

    limit = F.unix_micros(stop)
    seen = mails.filter(position(mails, "ts") <= limit)
    found = stretches(seen, min(waits), cuts).withColumn("stop", limit)
    return found.groupBy("subject").applyInPandas(
        per_subject, "subject string, digest bigint, from_us bigint, to_us bigint, flushed boolean"
    )


def mail_digest(
    mails: DataFrame,
    backoff: str,
    cutoff: int,
    stop: Column,
    outages: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """Digests with their text. Mails: subject, body, ts, arrival."""
    cuts = find_cuts(mails, ["subject"], ["ts", "arrival"])
    spans = digest_spans(mails, backoff, stop, outages, cuts)
    seen = mails.select(
        "subject",
        position(mails, "ts").alias("at"),
        F.lit(1).alias("kind"),
        "arrival",
        "body",
        F.lit(None).cast("long").alias("digest"),
        F.lit(None).cast("long").alias("to_us"),
        F.lit(None).cast("boolean").alias("flushed"),
    ).filter(F.col("at") <= F.unix_micros(stop))
    marks = spans.select(
        "subject",
        F.col("from_us").alias("at"),
        F.lit(0).alias("kind"),
        F.col("digest").alias("arrival"),
        F.lit(None).cast("string").alias("body"),
        "digest",
        "to_us",
        "flushed",
    )
    rows = OrderedRows(seen.unionByName(marks), ["subject"], ["at", "kind", "arrival"], cuts)
    span = F.struct("digest", "to_us", "flushed")
    rows = rows.last_known(
        inclusive=True, _span=F.when(F.col("digest").isNotNull(), span)
    )
    assigned = rows.df.filter(F.col("kind") == 1).select(
        "subject", "at", "arrival", "body", "_span.digest", "_span.to_us", "_span.flushed"
    )
    return digest_parts(assigned, ["subject", "digest", "to_us", "flushed"], ["at", "arrival"], cutoff)


def _ends(table: pa.Table, keys: list[str], order: list[str], head: int, tail: int) -> pa.Table:
    """The first `head` and last `tail` rows of each digest of a table; the first one stands for all rows dropped."""
    ascending = [(c, "ascending") for c in [*keys, *order]]
    table = table.take(pc.sort_indices(table, sort_keys=ascending, null_placement="at_start")).combine_chunks()
    n = table.num_rows
    new = np.ones(n, dtype=bool)
    for key in keys:
        column = table[key]
        mine, before = column.slice(1), column.slice(0, n - 1)
        same = pc.if_else(pc.is_null(mine), pc.is_null(before), pc.fill_null(pc.equal(mine, before), False))
        new[1:] |= ~same.to_numpy()
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    rank = np.arange(n) - np.repeat(starts, sizes)
    weights = np.zeros(n, dtype=np.int64)
    weights[starts] = np.add.reduceat(table["_n"].to_numpy(), starts)
    table = table.set_column(table.schema.get_field_index("_n"), table.schema.field("_n"), pa.array(weights))
    return table.filter(pa.array((rank < head) | (np.repeat(sizes, sizes) - rank <= tail)))


def _two_ended(keys: list[str], order: list[str], head: int, tail: int):
    """mapInArrow body: a two-ended buffer per digest. Rows are gathered up to a bound and cut to their ends; what is
    left after a cut and still large is passed on, so the buffer does not grow with the digests of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BUFFER_ROWS and sum(b.nbytes for b in held) < BUFFER_BYTES:
                continue
            cut = _ends(pa.Table.from_batches(held), keys, order, head, tail)
            held = cut.to_batches()
            if cut.num_rows * 2 > BUFFER_ROWS or cut.nbytes * 2 > BUFFER_BYTES:
                yield from held
                held = []
        if sum(b.num_rows for b in held):
            yield from _ends(pa.Table.from_batches(held), keys, order, head, tail).to_batches()

    return run


def digest_parts(mails: DataFrame, keys: list[str], order: list[str], cutoff: int) -> DataFrame:
    """Per digest: count and the text of the first ceil(cutoff/2) and last floor(cutoff/2) bodies. One pass and one
    shuffle: each task keeps a two-ended buffer per digest and passes on no more than `cutoff` bodies of it, with the
    number of mails they stand for; the buffers of all tasks are merged by the same rule."""
    if cutoff < 2:
        raise ValueError("cutoff must be at least 2")
    head, tail = (cutoff + 1) // 2, cutoff // 2
    rows = mails.select(*keys, *order, "body", F.lit(1).cast("long").alias("_n"))
    kept = rows.mapInArrow(_two_ended(keys, order, head, tail), rows.schema)
    merged = kept.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*order, "body"))).alias("_b"), F.sum("_n").alias("mails")
    )
    texts = F.transform("_b", lambda b: b["body"])
    omitted = F.format_string("... (%d omitted)", F.col("mails") - F.lit(cutoff))
    last = F.slice(texts, F.size("_b") - F.lit(tail - 1), F.lit(tail))
    parts = F.when(F.col("mails") <= cutoff, texts).otherwise(F.concat(F.slice(texts, 1, head), F.array(omitted), last))
    return merged.select(*keys, "mails", F.array_join(parts, SEPARATOR).alias("text"))
