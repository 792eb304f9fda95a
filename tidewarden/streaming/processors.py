"""Stateful stream operators on `transformWithStateInPandas`."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.configs import new_keys
from .keyed import watchdog
from .rules import Rule

STATE = "state string"


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    """A key's rows of one micro-batch in order; bounded by the source's rate limit."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return []
    rows = pd.concat(frames).sort_values(order, kind="stable")
    return rows.astype(object).where(rows.notna(), None).to_dict("records")


class RuleProcessor(StatefulProcessor):
    """Applies a transition rule to every row of a key; `fields` are the output columns."""

    def __init__(self, rule: Rule, keys: list[str], order: list[str], fields: list[str]):
        self.rule, self.keys, self.order, self.fields = rule, keys, order, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rule", STATE)

    def handleInputRows(self, key, rows, timerValues):
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out = []
        for row in _rows(rows, self.order):
            state, found = self.rule(state, row)
            for item in found:
                out.append({**dict(zip(self.keys, key)), **row, **item})
        self.state.update((json.dumps(state),))
        if out:
            yield pd.DataFrame([{f: o.get(f) for f in self.fields} for o in out])

    def close(self) -> None:
        pass


def apply_rule(
    df: DataFrame, rule: Rule, keys: list[str], order: list[str], output: str
) -> DataFrame:
    """A stateful stream by `rule`. `at` and other instants must be long microseconds; `output` is
    the schema of key, row and rule fields to emit."""
    fields = [part.split()[0] for part in output.split(", ")]
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=RuleProcessor(rule, keys, order, fields),
        outputStructType=output,
        outputMode="Append",
        timeMode="None",
    )


def configuration_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows agent, kind for the watchdog from two configurations: added and removed agents. The same
    configuration again gives no rows."""
    gone = new_keys(after, before, "agent").withColumn("kind", F.lit("removed"))
    return new_keys(before, after, "agent").withColumn("kind", F.lit("config")).unionByName(gone)


def silence_watchdog(df: DataFrame, period_ms: int) -> DataFrame:
    """Actions for silent agents from rows agent and kind (`keyed.Watchdog`)."""
    return watchdog(df, period_ms)


class MailDigest(StatefulProcessor):
    """Gathers mails per subject and emits digests after growing waits; an empty wait drops the
    buffer. Only the first and last bodies up to the cutoff are kept in state."""

    def __init__(self, waits_ms: list[int], cutoff: int):
        if cutoff < 2:
            raise ValueError("cutoff must be at least 2")
        self.waits, self.cutoff = waits_ms, cutoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("mail", "step int, mails bigint, top array<string>, bottom array<string>")

    def handleInputRows(self, key, rows, timerValues):
        frames = [b for b in rows if len(b)]
        if not frames:
            return
        bodies = pd.concat(frames).sort_values("arrival", kind="stable")["body"]
        bodies = bodies.astype(object).where(bodies.notna(), None).tolist()
        if self.state.exists():
            step, mails, top, bottom = self.state.get()
        else:
            step, mails, top, bottom = 0, 0, [], []
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.waits[0])
        head, tail = (self.cutoff + 1) // 2, self.cutoff // 2
        more = head - len(top)
        top, bottom = [*top, *bodies[:more]], [*bottom, *bodies[more:]][-tail:]
        self.state.update((step, mails + len(bodies), top, bottom))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        step, mails, top, bottom = self.state.get()
        if mails == 0:
            self.state.clear()
            return
        due = expiredTimerInfo.getExpiryTimeInMs()
        step = min(step + 1, len(self.waits) - 1)
        self.handle.registerTimer(due + self.waits[step])
        self.state.update((step, 0, [], []))
        middle = [f"... ({mails - self.cutoff} omitted)"] if mails > self.cutoff else []
        text = "\n\n---\n\n".join(x for x in [*top, *middle, *bottom] if x is not None)
        yield pd.DataFrame({"subject": [key[0]], "mails": [mails], "sent_ms": [due], "text": [text]})

    def close(self) -> None:
        pass


def mail_digests(df: DataFrame, waits_ms: list[int], cutoff: int) -> DataFrame:
    """Rows subject, body, arrival."""
    return df.groupBy("subject").transformWithStateInPandas(
        statefulProcessor=MailDigest(waits_ms, cutoff),
        outputStructType="subject string, mails bigint, sent_ms bigint, text string",
        outputMode="Append",
        timeMode="ProcessingTime",
    )
