"""The status store's versions: whole for readers at any time, refused twice, bounded in folders."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import status
from tidewarden.plans import views
from tidewarden.sinks.status_store import StatusStore, create_status_tables
from tidewarden.sinks.versions import Versions, VersionTaken

SF = "/root/testdata/sf0.001"
KEY = ["track", "ts", "arrival"]


def same(a, b):
    assert sorted(map(tuple, a.select(*KEY).collect()), key=str) == sorted(map(tuple, b.select(*KEY).collect()), key=str)


def test_a_number_is_committed_once(spark, tmp_path):
    log = Versions(spark, str(tmp_path / "new"))
    assert log.newest() == (0, {}) and log.numbers() == []
    log.commit(1, {"a": "ä"})
    log.commit(2, {"a": 2})
    for number in (1, 2):
        with pytest.raises(VersionTaken):
            log.commit(number, {"a": 3})
    assert log.newest() == (2, {"a": 2}) and log.read(1) == {"a": "ä"}
    log.forget(2)
    assert log.numbers() == [2] and os.listdir(tmp_path / "new" / "_versions") .count("000000000002.json") == 1
    assert not [n for n in log.names("_versions") if n.startswith(".") and not n.endswith(".crc")]


def test_of_two_writers_of_a_version_one_is_refused(spark, tmp_path):
    log, won, lost = Versions(spark, str(tmp_path)), [], []

    def write(i):
        try:
            Versions(spark, str(tmp_path)).commit(1, {"by": i})
            won.append(i)
        except VersionTaken:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) + len(lost) == 2 and won and log.newest()[1]["by"] in won


def test_a_failed_batch_leaves_the_version_before(spark, tmp_path):
    rows = views.statuses(spark, SF)
    store = StatusStore(spark, str(tmp_path))
    store.upsert(rows.filter("arrival % 2 = 0"), 0)
    before = store.read("current").select(*KEY).collect()
    broken = rows.withColumn("value", F.expr("if(arrival > 0, raise_error('lost'), value)"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken, 1)
    assert sorted(store.read("current").select(*KEY).collect()) == sorted(before)
    store.upsert(rows.filter("arrival % 2 = 1"), 1)
    same(store.read("current"), status.latest_status(rows))
    same(store.read("current", version=1), status.latest_status(rows.filter("arrival % 2 = 0")))


def test_folders_stay_bounded(spark, tmp_path):
    rows = views.statuses(spark, SF).limit(60).persist()
    store = StatusStore(spark, str(tmp_path), history_size=2, compact_every=4)
    most = 0
    for i in range(24):
        store.upsert(rows.filter(F.col("arrival") % 24 == i), i)
        most = max(most, *(len([n for n in os.listdir(tmp_path / t) if "=" in n]) for t in ("current", "history")))
    assert most <= 4 + 3 + 3 and len(store.versions.numbers()) == 3
    same(store.read("current"), status.latest_status(rows))


def test_publishing_never_shows_a_part(spark, tmp_path):
    rows = views.statuses(spark, SF).persist()
    store = StatusStore(spark, str(tmp_path / "store"), compact_every=2)
    create_status_tables(spark, "default", str(tmp_path / "tables"))
    try:
        store.upsert(rows.filter("arrival % 3 = 0"), 0)
        store.publish("default")
        sizes = {spark.table("default.status_current").count()}
        held = spark.table("default.status_current").select(*KEY)  # a query planned before the next ones
        seen, stop = set(), threading.Event()

        def look():
            while not stop.is_set():
                seen.add(spark.table("default.status_current").count())

        reader = threading.Thread(target=look)
        reader.start()
        for i in (1, 2):
            store.upsert(rows.filter(F.col("arrival") % 3 == i), i)
            store.publish("default")
            sizes.add(store.read("current").count())
            if i == 1:
                assert held.count() == min(sizes)
        stop.set()
        reader.join()
        assert seen and seen <= sizes
        same(spark.table("default.status_current"), status.latest_status(rows))
        same(spark.table("default.status_history"), status.status_history(rows))
    finally:
        for name in ("current", "history"):
            spark.sql(f"DROP TABLE IF EXISTS default.status_{name}")
