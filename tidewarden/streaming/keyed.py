"""Stateful stream operators with typed keyed state.

State is held in columns (value state, and for partitions of a topic map state), so that the state data source shows
it as a table. A key's rows of a micro-batch are put in order and worked on as arrays; between micro-batches only the
few values below are kept. Keys that are not seen for the time to live are forgotten; as that goes by the clock, such a
query runs a batch at every trigger, with rows or without. A time to live of None keeps keys for ever.

Instants are long microseconds. The batch operators over a whole history give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A month: far beyond any probe period.
TIME_TO_LIVE_MS = 31 * 24 * 3_600_000


def _sorted(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame | None:
    frames = [b for b in batches if len(b)]
    return pd.concat(frames).sort_values(order, kind="stable").reset_index(drop=True) if frames else None


def _before(values: np.ndarray, marks: np.ndarray, first):
    """For each place the value at the last marked place before it, `first` where there is none."""
    last = np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))
    last = np.concatenate(([-1], last[:-1]))
    return np.where(last >= 0, values[np.maximum(last, 0)], first)


def _held(values: np.ndarray, marks: np.ndarray, first):
    """As `_before`, a marked place counting for itself."""
    last = np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))
    return np.where(last >= 0, values[np.maximum(last, 0)], first)


class Keyed(StatefulProcessor):
    """A processor with one value state. `state` is its schema; subclasses turn a key's sorted rows and the state
    (a tuple, None for a new key) into the new state and rows to emit, with `emits` as their columns."""

    state = ""
    emits = ""

    def __init__(self, keys: list[str], order: list[str], carried: list[str], time_to_live_ms: int | None = TIME_TO_LIVE_MS):
        self.keys, self.order, self.carried, self.time_to_live_ms = keys, order, carried, time_to_live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state, self.time_to_live_ms)

    def handleInputRows(self, key, rows, timerValues):
        frame = _sorted(rows, self.order)
        if frame is None:
            return
        before = tuple(self.value.get()) if self.value.exists() else None
        after, found = self.step(frame, before)
        if after is None:
            self.value.clear()
        else:
            self.value.update(after)
        if len(found):
            out = found.assign(**dict(zip(self.keys, key, strict=True)))
            yield out[[*self.keys, *[c for c in self.carried if c not in self.keys], *[e.split()[0] for e in self.emits.split(", ")]]]

    def step(self, frame: pd.DataFrame, state: tuple | None) -> tuple[tuple | None, pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Streaks(Keyed):
    """Verdicts of probes: `failed` from the fail_count-th failure in a row on, `resolved` once after as many successes
    as resolve_count, else `other`. Rows: ok, fail_count, resolve_count."""

    state = "ok boolean, run bigint, failed boolean"
    emits = "verdict string"

    def step(self, frame, state):
        ok, run, failed = state or (None, 0, False)
        now = frame["ok"].to_numpy(bool)
        n = len(now)
        turned = np.ones(n, bool)
        turned[1:] = now[1:] != now[:-1]
        turned[0] = ok is None or now[0] != ok
        began = np.maximum.accumulate(np.where(turned, np.arange(n), -1))
        length = np.where(began >= 0, np.arange(n) - began + 1, run + np.arange(n) + 1)
        fails = ~now & (length >= frame["fail_count"].to_numpy())
        passes = now & (length >= frame["resolve_count"].to_numpy())
        was = _before(fails, fails | passes, failed)
        verdict = np.where(fails, "failed", np.where(passes & was, "resolved", "other"))
        ends = bool(_held(fails, fails | passes, failed)[-1])
        return (bool(now[-1]), int(length[-1]), ends), frame.assign(verdict=verdict)


class LoadGrace(Keyed):
    """Rows whose load has been above zero for longer than `grace_us`. Rows: at, load."""

    state = "started bigint"
    emits = "since bigint"

    def __init__(self, grace_us: int, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.grace_us = grace_us

    def step(self, frame, state):
        at, loaded = frame["at"].to_numpy(np.int64), frame["load"].to_numpy() > 0
        before = np.concatenate(([state is not None], loaded[:-1]))
        since = _held(at, loaded & ~before, state[0] if state else at[0])
        late = loaded & (since + self.grace_us < at)
        return (int(since[-1]),) if loaded[-1] else None, frame.assign(since=since)[late]


class Counters(Keyed):
    """Rows on which a counter of the same broker is higher than on the row before. Rows: broker, reading."""

    state = "broker bigint, reading bigint"
    emits = "increase bigint"

    def step(self, frame, state):
        broker, reading = frame["broker"].to_numpy(np.int64), frame["reading"].to_numpy(np.int64)
        first = state or (broker[0], reading[0])  # a first reading is no rise
        earlier = np.concatenate(([first[1]], reading[:-1]))
        rose = (np.concatenate(([first[0]], broker[:-1])) == broker) & (reading > earlier)
        return (int(broker[-1]), int(reading[-1])), frame.assign(increase=reading - earlier)[rose]


class Sightings(Keyed):
    """Rows that come at least `gap_us` after the key's row before, or first. Rows: at. The time to live may be as short
    as the gap, where rows arrive about when they were made."""

    state = "at bigint"
    emits = "quiet_us bigint"

    def __init__(self, gap_us: int, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.gap_us = gap_us

    def step(self, frame, state):
        at = frame["at"].to_numpy(np.int64)
        quiet = np.diff(at, prepend=state[0] if state else at[0] - self.gap_us)
        return (int(at[-1]),), frame.assign(quiet_us=quiet)[quiet >= self.gap_us]


class Partitions(Keyed):
    """Per topic: since when each partition is offline (no replica in sync) or under-replicated (an assigned one is
    not in sync). Rows: partition (null: all of the topic), kind (assigned, isr, removed), ids, at. One state entry per
    partition, so a row touches its own partition only."""

    emits = "partition int, offline bigint, under bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState(
            "partitions", "partition int", "assigned array<int>, isr array<int>, offline bigint, under bigint", self.time_to_live_ms
        )

    def handleInputRows(self, key, rows, timerValues):
        frame = _sorted(rows, self.order)
        if frame is None:
            return
        held: dict[int, tuple | None] = {}  # partitions that this batch touches; None: removed
        offline, under = np.full(len(frame), None, object), np.full(len(frame), None, object)
        shown = np.ones(len(frame), bool)
        columns = (frame["partition"], frame["kind"], frame["ids"], frame["at"])
        for i, (partition, kind, ids, at) in enumerate(zip(*columns, strict=True)):
            if kind == "removed":
                shown[i] = False
                gone = [int(partition)] if pd.notna(partition) else [*held, *(p[0] for p in self.parts.keys())]
                held.update(dict.fromkeys(gone))
                continue
            partition = int(partition)
            if partition not in held:
                held[partition] = tuple(self.parts.getValue((partition,))) if self.parts.containsKey((partition,)) else None
            assigned, isr, *since = held[partition] or ([], [], None, None)
            assigned, isr = ([int(x) for x in ids], isr) if kind == "assigned" else (assigned, [int(x) for x in ids])
            flags = (not isr, bool(set(assigned) - set(isr)))
            offline[i], under[i] = ((int(at) if s is None else s) if f else None for f, s in zip(flags, since, strict=True))
            held[partition] = (list(assigned), list(isr), offline[i], under[i])
        for partition, value in held.items():
            if value is not None:
                self.parts.updateValue((partition,), value)
            elif self.parts.containsKey((partition,)):
                self.parts.removeKey((partition,))
        found = frame.assign(offline=pd.array(offline, "Int64"), under=pd.array(under, "Int64"))[shown]
        if len(found):
            out = found.assign(**dict(zip(self.keys, key, strict=True)))
            out["partition"] = out["partition"].astype("int32")
            yield out[[*self.keys, *self.carried, "partition", "offline", "under"]]


def keyed(df: DataFrame, processor: Keyed) -> DataFrame:
    """The rows that a processor emits: keys, carried columns of the input, and its own."""
    kinds = dict(df.dtypes)
    fields = [f"`{c}` {kinds[c]}" for c in dict.fromkeys([*processor.keys, *processor.carried])]
    return df.groupBy(*processor.keys).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=", ".join([*fields, processor.emits]),
        outputMode="Append",
        timeMode="ProcessingTime" if processor.time_to_live_ms else "None",
    )


class Watchdog(StatefulProcessor):
    """Pages when an expected agent is silent for longer than a period, resolves when it is back.

    Rows: agent, kind, epoch, seq. `heartbeat` rows count for agents of the configuration only. A `config` row says that
    the agent is in the configuration with that epoch: a higher epoch than the one kept starts the agent's clock anew,
    whatever it showed, and leaves a down flag as it is; the same epoch again does nothing. `removed` says that the
    agent is not in the configuration of that epoch any more: its clock ends, but if it was down it stays so, and is
    resolved by the first heartbeat after it has come back. Rows of one micro-batch take effect in order of seq; rows
    without seq in the order configuration, heartbeats, removals. A row of an older epoch than the one kept has no
    effect. A configuration row without epoch starts a clock only if there is none, a removal without epoch always
    counts."""

    def __init__(self, period_ms: int):
        self.period_ms = period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("agent", "seen bigint, down boolean, epoch bigint")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat([b for b in rows if len(b)])
        rank = frame["kind"].map({"config": 0, "heartbeat": 1, "removed": 2})
        frame = frame.assign(rank=rank).sort_values(["seq", "rank"], kind="stable")
        seen, down, epoch = self.value.get() if self.value.exists() else (None, False, None)
        now = timerValues.getCurrentProcessingTimeInMs()
        resolved = 0
        kinds = frame["kind"].to_numpy()
        control = np.flatnonzero(kinds != "heartbeat")
        epochs = frame["epoch"].to_numpy()[control]
        for i, (place, end) in enumerate(zip([-1, *control], [*control, len(kinds)], strict=True)):
            if i:
                own = None if pd.isna(epochs[i - 1]) else int(epochs[i - 1])
                current = own is None or epoch is None or own > epoch
                if kinds[place] == "removed":
                    seen = None if current else seen
                elif own is None:
                    seen = now if seen is None else seen
                elif current:
                    seen = now
                epoch = own if current and own is not None else epoch
            if end > place + 1 and seen is not None:  # heartbeats before the next change
                seen, resolved, down = now, resolved + bool(down), False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if seen is not None and not down:
            self.handle.registerTimer(seen + self.period_ms + 1)
        if seen is None and not down:
            self.value.clear()
        else:
            self.value.update((seen, bool(down), epoch))
        if resolved:
            yield pd.DataFrame({"agent": [key[0]], "action": ["resolve"], "at_ms": [now]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.value.exists():
            return
        seen, down, epoch = self.value.get()
        if seen is not None and not down:
            self.value.update((seen, True, epoch))
            yield pd.DataFrame({"agent": [key[0]], "action": ["trigger"], "at_ms": [seen + self.period_ms]})

    def close(self) -> None:
        pass


def watchdog(df: DataFrame, period_ms: int) -> DataFrame:
    """Actions from rows agent and kind, and optionally epoch and seq."""
    optional = {c: F.col(c).cast("long") if c in df.columns else F.lit(None).cast("long") for c in ("epoch", "seq")}
    return df.select("agent", "kind", *[c.alias(n) for n, c in optional.items()]).groupBy("agent").transformWithStateInPandas(
        statefulProcessor=Watchdog(period_ms),
        outputStructType="agent string, action string, at_ms bigint",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def configuration_epoch(before: DataFrame, after: DataFrame, epoch: int) -> DataFrame:
    """Rows agent, kind, epoch for the watchdog when configuration `after` takes the place of `before` (one column
    agent each): every agent of the new one, whose clock starts anew, and those that are gone. None if both hold the
    same agents."""
    old, new = before.select("agent").distinct(), after.select("agent").distinct()
    gone, come = old.join(new, "agent", "left_anti"), new.join(old, "agent", "left_anti")
    rows = new.withColumn("kind", F.lit("config")).unionByName(gone.withColumn("kind", F.lit("removed")))
    rows = rows.withColumn("epoch", F.lit(epoch).cast("long"))
    return rows.limit(0) if gone.isEmpty() and come.isEmpty() else rows
