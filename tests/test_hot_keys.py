"""Ordered operators and folds against plain loops, on data where one key holds a third of all
rows, with and without splitting of hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewarden.functions.times import at
from tidewarden.operators import checks, digest, incidents, silence, throttle
from tidewarden.operators.ordered import OrderedRows
from tidewarden.operators.segments import Cuts, find_cuts

BASE = 1_700_000_000_000_000
SECOND = 1_000_000


def _stamp(us):
    return dt.datetime.fromtimestamp(us / SECOND, dt.timezone.utc)


def _rows(seed, n=240, dense=False):
    """(key, at, id, bad), a third of them with key `hot`; instants may tie."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(6)}"
        step = rng.randrange(600 if dense else 6000)
        rows.append((key, BASE + step * SECOND, i, rng.random() < 0.5))
    return rows


def _frame(spark, rows):
    data = [(k, _stamp(t), i, b) for k, t, i, b in rows]
    return spark.createDataFrame(data, "key string, ts timestamp, id bigint, bad boolean")


def _by_key(rows):
    keys = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        keys.setdefault(row[0], []).append(row)
    return keys


@pytest.fixture(params=["whole", "split"])
def mode(request):
    if request.param == "split":
        request.getfixturevalue("split")
    return request.param


def test_hot_keys_are_cut(spark, split):
    cuts = find_cuts(_frame(spark, _rows(1)), ["key"], ["ts", "id"])
    assert cuts.split and cuts.segments > 5
    marked = cuts.mark(_frame(spark, _rows(1)), ["ts", "id"])
    assert marked.count() == 240
    sizes = marked.filter("_hot").groupBy("key", "_seg").count()
    assert sizes.agg(F.max("count")).first()[0] < 30


def _same_instant(seed):
    """Two thirds of the hot key's rows at one instant."""
    return [
        (k, BASE + 3000 * SECOND if k == "hot" and i % 9 else t, i, b) for k, t, i, b in _rows(seed)
    ]


def test_a_hot_instant_is_cut_by_the_tie_break(spark, split):
    df = _frame(spark, _same_instant(1))
    cuts = find_cuts(df, ["key"], ["ts", "id"])
    sizes = cuts.mark(df, ["ts", "id"]).filter("_hot and key = 'hot'").groupBy("_seg").count()
    assert sizes.agg(F.max("count")).first()[0] < 20
    together = cuts.mark(df, ["ts", "bad"]).filter("key = 'hot'").groupBy("ts")
    assert together.agg(F.countDistinct("_seg").alias("n")).agg(F.max("n")).first()[0] == 1


def test_work_over_a_hot_instant(spark, mode):
    rows = _same_instant(2)
    out = OrderedRows(_frame(spark, rows), ["key"], ["ts", "id"])
    out = out.previous(before="id").running(n=F.lit(1)).runs(bad="bad").df
    fired = throttle.greedy_throttle(_frame(spark, rows), ["key"], ["ts", "id"], F.lit(60 * SECOND))
    want, fires = {}, set()
    for group in _by_key(rows).values():
        last, run = None, None
        for j, (_, t, i, bad) in enumerate(group):
            run = (bad, 1 + (run[1] if run and run[0] == bad else 0))
            want[i] = (group[j - 1][2] if j else None, j + 1, run[1])
            if last is None or t > last + 60 * SECOND:
                fires.add(i)
                last = t
    assert {r["id"]: (r["before"], r["n"], r["bad_length"]) for r in out.collect()} == want
    assert {r["id"] for r in fired.collect()} == fires


def test_small_tables_are_not_scanned(spark):
    assert not find_cuts(_frame(spark, _rows(1)), ["key"], ["ts", "id"]).split


def test_neighbours_known_values_and_totals(spark, mode):
    rows = _rows(2)
    df = _frame(spark, rows)
    out = OrderedRows(df, ["key"], ["ts", "id"])
    out = out.previous(before="id").following(after="id")
    out = out.last_known(seen=F.when(F.col("bad"), F.col("id")))
    out = out.last_known(inclusive=True, now=F.when(F.col("bad"), F.col("id")))
    out = out.running(n=F.lit(1), total=F.col("id"))
    want = {}
    for group in _by_key(rows).values():
        seen, total = None, 0
        for j, (_, _, i, bad) in enumerate(group):
            before = group[j - 1][2] if j else None
            after = group[j + 1][2] if j + 1 < len(group) else None
            held, total = seen, total + i
            seen = i if bad else seen
            want[i] = (before, after, held, seen, j + 1, total)
    got = {r["id"]: (r.before, r.after, r.seen, r.now, r.n, r.total) for r in out.df.collect()}
    assert got == want


def test_null_keys_form_one_group(spark, mode):
    df = _frame(spark, _rows(3)).withColumn("key", F.when(F.col("key") != "hot", F.col("key")))
    out = OrderedRows(df, ["key"], ["ts", "id"]).running(n=F.lit(1)).df
    assert out.filter(F.col("key").isNull()).agg(F.max("n")).first()[0] == 80


@pytest.mark.parametrize("share", [0.1, 0.5, 0.97])
def test_runs(spark, mode, share):
    """Runs within and across segments, up to runs over many whole segments, with null states."""
    rng = random.Random(share)
    rows = [(k, t, i, rng.random() < share) for k, t, i, _ in _rows(4)]
    state = F.when(F.col("id") % 9 != 0, F.col("bad"))
    out = OrderedRows(_frame(spark, rows), ["key"], ["ts", "id"]).runs(a=state, b="bad").df
    want = {}
    for group in _by_key(rows).values():
        open_run = {"a": None, "b": None}
        for _, t, i, bad in group:
            found = ()
            for name, value in (("a", bad if i % 9 else None), ("b", bad)):
                run = open_run[name]
                run = (value, t, 1) if run is None or run[0] != value else (value, run[1], run[2] + 1)
                open_run[name] = run
                found += run[1:]
            want[i] = found
    us = [F.unix_micros("a_start").alias("at"), F.unix_micros("b_start").alias("bt")]
    got = out.select("id", "a_length", "b_length", *us).collect()
    assert {r["id"]: (r["at"], r["a_length"], r["bt"], r["b_length"]) for r in got} == want


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("gap", [1, 30, 400, 100_000])
def test_greedy_throttle(spark, mode, strict, dense, gap):
    rows = _rows(gap, dense=dense)
    got = throttle.greedy_throttle(
        _frame(spark, rows), ["key"], ["ts", "id"], F.lit(gap * SECOND), strict
    )
    want = set()
    for group in _by_key(rows).values():
        last = None
        for _, t, i, _ in group:
            if last is None or (t > last + gap * SECOND if strict else t >= last + gap * SECOND):
                want.add(i)
                last = t
    assert {r["id"] for r in got.collect()} == want


def test_a_gap_over_a_hundred_segments(spark, monkeypatch):
    """No row and no group grows with the gap: entries and jumps are narrow rows, groups are segments."""
    spark.conf.set("spark.tidewarden.rowsPerSegment", "6")
    rng = random.Random(11)
    rows = [("hot", BASE + rng.randrange(3_000_000) * SECOND // 10, i, False) for i in range(1800)]
    rows += [("k", BASE + i * SECOND, 5000 + i, False) for i in range(5)]
    sizes, entries = [], throttle._segment_entries

    def watched(strict):
        inner = entries(strict)

        def run(pdf):
            out = inner(pdf)
            return out.assign(_exit=out["_exit"]) if len(pdf) <= 60 else 1 / 0  # a group is a segment

        return run

    doubled = throttle._orbits

    def counted(points, jumps):
        sizes.append(max(len(r.asDict()) for r in jumps.limit(1).collect()))
        assert {t for _, t in jumps.dtypes} == {"bigint"}  # no arrays
        return doubled(points, jumps)

    monkeypatch.setattr(throttle, "_segment_entries", watched)
    monkeypatch.setattr(throttle, "_orbits", counted)
    try:
        cuts = find_cuts(_frame(spark, rows), ["key"], ["ts", "id"])
        assert cuts.segments > 200
        for gap, strict in ((150_000, True), (20_000, False)):  # over half and over a fifteenth of all segments
            got = throttle.greedy_throttle(_frame(spark, rows), ["key"], ["ts", "id"], F.lit(gap * SECOND), strict, cuts=cuts)
            want = set()
            for group in _by_key(rows).values():
                last = None
                for _, t, i, _ in group:
                    if last is None or (t > last + gap * SECOND if strict else t >= last + gap * SECOND):
                        want.add(i)
                        last = t
            assert {r["id"] for r in got.collect()} == want
        assert sizes == [3] * 2
    finally:
        spark.conf.unset("spark.tidewarden.rowsPerSegment")


def test_starts_in_the_middle_of_a_hot_key(spark, mode):
    rows, gap = _rows(6), 500 * SECOND
    for start, strict in ((BASE + 2500 * SECOND, True), (BASE + 5400 * SECOND, False)):
        got = throttle.greedy_throttle(_frame(spark, rows), ["key"], ["ts", "id"], F.lit(gap), strict, F.lit(start))
        want = set()
        for group in _by_key(rows).values():
            last = start
            for _, t, i, _ in group:
                if t > last + gap if strict else t >= last + gap:
                    want.add(i)
                    last = t
        assert {r["id"] for r in got.collect()} == want


def test_recent_values(spark, mode):
    rows = _rows(12)
    for n in (4, 30):
        out = OrderedRows(_frame(spark, rows), ["key"], ["ts", "id"])
        out = out.recent(n, ids="id", odd=F.when(F.col("id") % 2 == 1, F.col("id"))).df
        want = {}
        for group in _by_key(rows).values():
            ids = [r[2] for r in group]
            for j, i in enumerate(ids):
                own = ids[max(0, j - n + 1) : j + 1]
                want[i] = (own, [x if x % 2 else None for x in own])
        assert {r["id"]: (r["ids"], r["odd"]) for r in out.withColumnRenamed("id", "id").select(F.element_at("ids", -1).alias("id"), "ids", "odd").collect()} == want


def test_history_of_five_hundred_codes_is_one_window(spark, mode):
    rows = [("hot", BASE + i * SECOND, i, 200 + i % 7) for i in range(700)]
    data = [(k, _stamp(t), i, c, 500, 3) for k, t, i, c in rows]
    df = spark.createDataFrame(data, "key string, ts timestamp, id bigint, status_code int, fail_count int, resolve_count int")
    out = checks.history_text(df, ["key"], ["ts", "id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 4
    got = {r["id"]: r["history"] for r in out.select("id", "history").collect()}
    assert all(got[i] == ", ".join(str(200 + j % 7) for j in range(max(0, i - 499), i + 1)) for i in range(700))


def test_greedy_throttle_with_start(spark, mode):
    rows, period = _rows(5), 700 * SECOND
    start = BASE - 100 * SECOND
    df = _frame(spark, rows)
    got = silence.damped_heartbeats(df, ["key"], ["ts", "id"], period // 1000, F.lit(_stamp(start)))
    want = set()
    for group in _by_key(rows).values():
        last = start
        for _, t, i, _ in group:
            if t >= last + period:
                want.add(i)
                last = t
    assert {r["id"] for r in got.collect()} == want


def test_session_throttle(spark, mode):
    rows = _rows(6)
    got = throttle.session_throttle(_frame(spark, rows), ["key"], ["ts", "id"], 200 * SECOND)
    want = set()
    for group in _by_key(rows).values():
        seen = None
        for _, t, i, _ in group:
            if seen is None or seen + 200 * SECOND <= t:
                want.add(i)
            seen = t
    assert {r["id"] for r in got.collect()} == want


def _actions(df):
    return {(r["id"], r["action"]) for r in df.collect()}


def test_policies(spark, mode):
    rows, gap = _rows(7), 500 * SECOND
    df = _frame(spark, rows).select("*", F.col("bad").alias("failing"), F.lit("pk").alias("pager_key"))
    edge, every, stale = set(), set(), set()
    for group in _by_key(rows).values():
        flag, last, alarmed = False, None, False
        for _, t, i, bad in group:
            if bad:
                every.add((i, "trigger"))
                if not flag:
                    edge.add((i, "trigger"))
                if last is None or t > last + gap:
                    stale.add((i, "trigger"))
                    last, alarmed = t, True
            else:
                if flag:
                    edge.add((i, "resolve"))
                    every.add((i, "resolve"))
                if alarmed:
                    stale.add((i, "resolve"))
                alarmed = False
            flag = bad
    order = ["ts", "id"]
    assert _actions(incidents.rising_edge(df, ["key"], order)) == edge
    assert _actions(incidents.every_failing(df, ["key"], order)) == every
    assert _actions(incidents.throttled(df, ["key"], order, gap)) == stale


def test_backlog_pager(spark, mode):
    rows, gap = _rows(8), 400 * SECOND
    period = F.when(F.col("key") == "k1", 0).otherwise(60_000)
    age = F.when(F.col("bad"), 61).otherwise(F.col("id") % 60)
    df = _frame(spark, rows).select(
        "*",
        period.cast("long").alias("period_ms"),
        F.timestamp_micros(F.unix_micros("ts") - age.cast("long") * SECOND).alias("min_time"),
        F.lit("pk").alias("pager_key"),
    )
    want = set()
    for key, group in _by_key(rows).items():
        p, last = (0 if key == "k1" else 60 * SECOND), None
        for _, t, i, bad in group:
            m = t - (61 if bad else i % 60) * SECOND
            if p != 0 and m < t - p:
                if last is None or t > last + gap:
                    want.add((i, "trigger"))
                    last = t
            elif m >= t - p and last is not None:
                want.add((i, "resolve"))
                last = None
    assert _actions(incidents.backlog_pager(df, ["key"], ["ts", "id"], gap)) == want


def test_failed_job_pager(spark, mode):
    rng = random.Random(9)
    probes = sorted(rng.sample(range(5000), 120))
    jobs = {"a": 0, "b": 100, "c": 1000}
    failing = {p: [j for j in jobs if rng.random() < 0.7] for p in probes}
    schema = "env string, job string, ts timestamp, throttle_ms bigint, pager_key string"
    failed = spark.createDataFrame(
        [("e", j, _stamp(BASE + p * SECOND), jobs[j] * 1000, "pk") for p in probes for j in failing[p]],
        schema,
    )
    probe_rows = spark.createDataFrame([("e", _stamp(BASE + p * SECOND)) for p in probes], "env string, ts timestamp")
    state, want = {}, set()
    for p in probes:
        for j, (_, paged) in state.items():
            if paged and j not in failing[p]:
                want.add((j, p, "resolve"))
        after = {}
        for j in failing[p]:
            if j not in state:
                after[j] = (p, False)
            elif jobs[j] > 0 and (not state[j][1] or p - state[j][0] > jobs[j]):
                want.add((j, p, "trigger"))
                after[j] = (p, True)
            else:
                after[j] = state[j]
        state = after
    out = incidents.failed_job_pager(probe_rows, failed)
    got = {
        (r["job"], r["us"] // SECOND, r["action"])
        for r in out.select("job", (F.unix_micros("ts") - BASE).alias("us"), "action").collect()
    }
    assert got == want


def test_streaks(spark, mode):
    rows = _rows(10)
    df = _frame(spark, rows).select(
        F.lit("g").alias("group"), F.col("key").alias("name"), "ts", "id", (~F.col("bad")).alias("ok"),
        F.lit(3).alias("fail_count"), F.lit(2).alias("resolve_count"),
    )
    want = {}
    for group in _by_key(rows).values():
        history, failed = [], False
        for _, _, i, bad in group:
            history = (history + [not bad])[-3:]
            if len(history) >= 3 and not any(history[-3:]):
                want[i], failed = "failed", True
            elif failed and len(history) >= 2 and all(history[-2:]):
                want[i], failed = "resolved", False
            else:
                want[i] = "other"
    got = checks.streaks(df, ["group", "name"], ["ts", "id"])
    assert {r["id"]: r["verdict"] for r in got.collect()} == want


def _digest_loop(mails, waits, cutoff, outages, stop):
    """Timers and buffers, mail by mail."""
    out, state = [], None

    def run_due(t):
        nonlocal state
        while state and state["due"] <= t:
            if not state["held"]:
                state = None
            elif any(a <= state["due"] < b for a, b in outages):
                state["due"] += waits[state["step"]]
            else:
                out.append((state["due"], list(state["held"])))
                state["held"], state["step"] = [], min(state["step"] + 1, len(waits) - 1)
                state["due"] += waits[state["step"]]

    for t, body in mails:
        run_due(t)
        if state is None:
            state = {"due": t + waits[0], "step": 0, "held": []}
        state["held"].append(body)
    run_due(stop)
    if state and state["held"]:
        out.append((stop + 1, list(state["held"])))
    texts = []
    for sent, bodies in out:
        head, tail = (cutoff + 1) // 2, cutoff // 2
        middle = [f"... ({len(bodies) - cutoff} omitted)"] if len(bodies) > cutoff else []
        kept = bodies if not middle else bodies[:head] + middle + bodies[-tail:]
        texts.append((sent, len(bodies), digest.SEPARATOR.join(kept)))
    return texts


@pytest.mark.parametrize("backoff", ["PT10S", "PT10S PT1M PT5M", "PT2M PT30S"])
@pytest.mark.parametrize("cutoff", [2, 5])
def test_mail_digest(spark, mode, backoff, cutoff):
    rows = _rows(11)
    waits = digest.waits_micros(backoff)
    outages = [(BASE + 1000 * SECOND, BASE + 2000 * SECOND)]
    stop = BASE + 5500 * SECOND
    df = _frame(spark, rows).select(
        F.col("key").alias("subject"), F.format_string("m%d", F.col("id")).alias("body"), "ts", F.col("id").alias("arrival")
    )
    want = set()
    for key, group in _by_key(rows).items():
        mails = [(t, f"m{i}") for _, t, i, _ in group if t <= stop]
        want |= {(key, *d) for d in _digest_loop(mails, waits, cutoff, outages, stop)}
    got = digest.mail_digest(df, backoff, cutoff, F.lit(_stamp(stop)), outages)
    assert {(r["subject"], r["to_us"], r["mails"], r["text"]) for r in got.collect()} == want


def test_digest_needs_two_bodies(spark):
    with pytest.raises(ValueError):
        digest.digest_parts(_frame(spark, _rows(1)), ["key"], ["ts"], 1)


def test_silence(spark, mode):
    rows, period = _rows(12), 300 * SECOND
    start, now = BASE - 1000 * SECOND, BASE + 7000 * SECOND
    beats = _frame(spark, rows).select(F.col("key").alias("agent"), "ts", F.col("id").alias("arrival"))
    expected = spark.createDataFrame([("hot",), ("k1",), ("never",)], "agent string")
    want = set()
    for agent in ("hot", "k1", "never"):
        seen = [start] + [t for _, t, _, _ in _by_key(rows).get(agent, [])]
        for t, following in zip(seen, [*seen[1:], None]):
            if (following or now) - t > period:
                want.add((agent, "trigger", t + period))
                if following:
                    want.add((agent, "resolve", following))
    out = silence.silence(beats, expected, F.lit(_stamp(start)), period // 1000, F.lit(_stamp(now)))
    got = {(r["agent"], r["action"], r["us"]) for r in out.withColumn("us", F.unix_micros("at")).collect()}
    assert got == want


def test_cuts_of_a_table_serve_its_subsets(spark, split):
    df = _frame(spark, _rows(13))
    cuts = find_cuts(df, ["key"], ["ts", "id"])
    assert isinstance(cuts, Cuts)
    some = df.filter("bad")
    a = OrderedRows(some, ["key"], ["ts", "id"], cuts).running(n=F.lit(1)).df
    b = OrderedRows(some, ["key"], ["ts", "id"], Cuts(["key"], None)).running(n=F.lit(1)).df
    assert sorted(a.collect()) == sorted(b.collect())


def test_clock_is_utc(spark):
    assert spark.range(1).select(F.unix_micros(at("2024-01-31T00:00:00"))).first()[0] == 1_706_659_200_000_000


def test_segments_have_no_ceiling(spark, split):
    df = spark.range(20_000).select(
        F.when(F.col("id") < 12_000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 800).cast("string"))).alias("key"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        "id",
    )
    cuts = find_cuts(df, ["key"], ["ts", "id"])
    assert cuts.segments > 1024
    sizes = cuts.mark(df, ["ts", "id"]).groupBy("key", "_hot", "_seg").count()
    assert sizes.agg(F.max("count")).first()[0] <= 20
    assert sizes.filter("_hot").select("key").distinct().count() > 700
    out = OrderedRows(df, ["key"], ["ts", "id"]).running(n=F.lit(1)).df
    assert out.filter("key = 'hot'").agg(F.max("n")).first()[0] == 12_000


def test_cut_points_too_many_to_broadcast(spark, split):
    from tidewarden.operators.segments import BROADCAST_CONF

    rows = _same_instant(5)
    df = _frame(spark, rows)
    cuts = find_cuts(df, ["key"], ["ts", "id"])
    searched = {r["id"]: (r["_seg"], r["_hot"]) for r in cuts.mark(df, ["ts", "id"]).collect()}
    spark.conf.set(BROADCAST_CONF, "1")
    try:
        carried = {r["id"]: (r["_seg"], r["_hot"]) for r in cuts.mark(df, ["ts", "id"]).collect()}
        out = OrderedRows(df, ["key"], ["ts", "id"]).previous(before="id").df.collect()
    finally:
        spark.conf.unset(BROADCAST_CONF)
    assert carried == searched
    want = {}
    for group in _by_key(rows).values():
        for j, row in enumerate(group):
            want[row[2]] = group[j - 1][2] if j else None
    assert {r["id"]: r["before"] for r in out} == want


@pytest.mark.parametrize("cutoff", [2, 5])
def test_two_ended_buffers_of_many_tasks(spark, monkeypatch, cutoff):
    """Buffers that are cut and passed on many times, null keys and null bodies, and a digest in all tasks."""
    monkeypatch.setattr(digest, "BUFFER_ROWS", 8)
    rows = [(None if k == "k1" else k, t, i, None if i % 7 == 0 else f"m{i}") for k, t, i, _ in _rows(13)]
    df = spark.createDataFrame(rows, "key string, at bigint, id bigint, body string").repartition(5)
    want = set()
    for key in {k for k, *_ in rows}:
        bodies = [b for k, _, _, b in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])]
        n, head, tail = len(bodies), (cutoff + 1) // 2, cutoff // 2
        kept = bodies if n <= cutoff else [*bodies[:head], f"... ({n - cutoff} omitted)", *bodies[n - tail :]]
        want.add((key, n, digest.SEPARATOR.join(b for b in kept if b is not None)))
    parts = digest.digest_parts(df, ["key"], ["at", "id"], cutoff)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in parts.collect()} == want


def test_two_ended_buffers_of_no_mails(spark):
    df = spark.createDataFrame([], "key string, at bigint, body string")
    assert digest.digest_parts(df, ["key"], ["at"], 3).collect() == []
