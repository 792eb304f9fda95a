"""Transition rules of the stateful operators, one observation at a time.

A rule is `(state, row) -> (state, outputs)`; state is a JSON-able dict, empty for a new key, and
instants are long microseconds. The batch forms in `operators` give the same results over a whole
history; these rules are what a stream applies to each new row of a key.
"""

from __future__ import annotations

from collections.abc import Callable

Rule = Callable[[dict, dict], tuple[dict, list[dict]]]


def greedy(gap: int, strict: bool = True, start: int | None = None) -> Rule:
    def rule(state, row):
        t, last = row["at"], state.get("last", start)
        quiet = last is not None and (t <= last + gap if strict else t < last + gap)
        return (state, []) if quiet else ({"last": t}, [{"action": "trigger"}])

    return rule


def session(gap: int) -> Rule:
    def rule(state, row):
        seen = state.get("seen")
        fire = seen is None or seen + gap <= row["at"]
        return {"seen": row["at"]}, [{"action": "trigger"}] if fire else []

    return rule


def edge(state: dict, row: dict):
    flag = state.get("flag", False)
    if row["failing"] == flag:
        return state, []
    return {"flag": row["failing"]}, [{"action": "trigger" if row["failing"] else "resolve"}]


def every(state: dict, row: dict):
    if row["failing"]:
        return {"flag": True}, [{"action": "trigger"}]
    return {"flag": False}, [{"action": "resolve"}] if state.get("flag") else []


def streak(state: dict, row: dict):
    run = state.get("run", 0) + 1 if state.get("ok") == row["ok"] else 1
    failed = state.get("failed", False)
    if not row["ok"] and run >= row["fail_count"]:
        verdict, failed = "failed", True
    elif failed and row["ok"] and run >= row["resolve_count"]:
        verdict, failed = "resolved", False
    else:
        verdict = "other"
    return {"ok": row["ok"], "run": run, "failed": failed}, [{"action": verdict}]


def stale(gap: int) -> Rule:
    """Throttled alert while failing; the throttle clock survives a resolve."""

    def rule(state, row):
        last = state.get("last")
        if row["failing"]:
            if last is None or row["at"] > last + gap:
                return {"last": row["at"], "flag": True}, [{"action": "trigger"}]
            return state, []
        return {"last": last, "flag": False}, [{"action": "resolve"}] if state.get("flag") else []

    return rule


def backlog(gap: int) -> Rule:
    """Rows carry `oldest` (earliest work) and `period`, both in microseconds."""

    def rule(state, row):
        t, last, period = row["at"], state.get("last"), row["period"]
        if period != 0 and row["oldest"] < t - period:
            if last is None or t > last + gap:
                return {"last": t}, [{"action": "trigger"}]
            return state, []
        if row["oldest"] >= t - period and last is not None:
            return {}, [{"action": "resolve"}]
        return state, []

    return rule


def failed_jobs(state: dict, row: dict):
    """One row per environment and probe with `jobs`, a list of [job, throttle]."""
    now_failing, after, out = {j: g for j, g in row["jobs"]}, {}, []
    for job, (_, paged) in state.items():
        if paged and job not in now_failing:
            out.append({"action": "resolve", "job": job})
    for job, throttle in now_failing.items():
        if job not in state:
            after[job] = [row["at"], False]
            continue
        seen, paged = state[job]
        if throttle > 0 and (not paged or row["at"] - seen > throttle):
            out.append({"action": "trigger", "job": job})
            after[job] = [row["at"], True]
        else:
            after[job] = [seen, paged]
    return after, out


def counter(state: dict, row: dict):
    out = []
    if state and state["broker"] == row["broker"] and row["reading"] > state["reading"]:
        out = [{"action": "trigger", "increase": row["reading"] - state["reading"]}]
    return {"broker": row["broker"], "reading": row["reading"]}, out


def load_grace(grace: int) -> Rule:
    def rule(state, row):
        if row["load"] <= 0:
            return {}, []
        begun = state.get("start", row["at"])
        late = begun + grace < row["at"]
        return {"start": begun}, [{"action": "alert", "since": begun}] if late else []

    return rule


def partitions(state: dict, row: dict):
    """Keyed by topic: assigned and in-sync replicas per partition, and since when each is offline
    or under-replicated. `partition` None removes the whole topic."""
    after = dict(state)
    if row["kind"] == "removed":
        gone = [str(row["partition"])] if row["partition"] is not None else list(after)
        for name in gone:
            after.pop(name, None)
        return after, []
    name = str(row["partition"])
    p = dict(after.get(name, {"assigned": [], "isr": [], "offline": None, "under": None}))
    p[row["kind"]] = [int(i) for i in row["ids"]]
    for flag, holds in (
        ("offline", not p["isr"]),
        ("under", bool(set(p["assigned"]) - set(p["isr"]))),
    ):
        p[flag] = (p[flag] if p[flag] is not None else row["at"]) if holds else None
    after[name] = p
    return after, [
        {"action": "state", "partition": row["partition"], "offline": p["offline"], "under": p["under"]}
    ]
