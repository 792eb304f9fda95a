"""The log source: start at the newest offset, restart from a checkpoint, lost and shortened logs, files opened."""

import datetime as dt
import glob
import os

import pytest

from tidewarden.operators.events import good
from tidewarden.sources import feeds, log_source

DAY = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def add(spark, path, texts, partitions=2):
    rows = [(t, DAY + dt.timedelta(seconds=i)) for i, t in enumerate(texts)]
    log_source.append(spark.createDataFrame(rows, "payload string, received_at timestamp"), path, partitions)


def run(spark, path, folder, name, starting="latest"):
    stream = log_source.read(spark, path, starting=starting)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").start(f"{folder}/{name}")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted(r["payload"] for r in spark.read.schema(stream.schema).parquet(f"{folder}/{name}").collect())


def texts(a, b):
    return [f"m{i:03d}" for i in range(a, b)]


def test_offsets_and_batch_reads(spark, tmp_path):
    path = str(tmp_path / "log")
    add(spark, path, texts(0, 20))
    add(spark, path, texts(20, 50))
    rows = log_source.read(spark, path, streaming=False).collect()
    assert sorted(r["payload"] for r in rows) == texts(0, 50)
    for p in (0, 1):
        assert sorted(r["arrival"] for r in rows if r["partition"] == p) == list(range(sum(r["partition"] == p for r in rows)))
    assert {r["received_at"].timestamp() for r in rows} <= {(DAY + dt.timedelta(seconds=i)).timestamp() for i in range(30)}


def test_start_at_newest_and_go_on_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "log")
    add(spark, path, texts(0, 10))
    assert run(spark, path, str(tmp_path), "out") == []  # what was there before the first start is not read
    add(spark, path, texts(10, 30))
    assert run(spark, path, str(tmp_path), "out") == texts(10, 30)
    assert run(spark, path, str(tmp_path), "out") == texts(10, 30)
    add(spark, path, texts(30, 31), partitions=5)  # a new partition or an old one
    assert run(spark, path, str(tmp_path), "out") == texts(10, 31)
    assert run(spark, path, str(tmp_path / "all"), "out", "earliest") == texts(0, 31)


def test_lost_offsets_and_a_shorter_log(spark, tmp_path):
    path = str(tmp_path / "log")
    add(spark, path, texts(0, 10), 1)
    run(spark, path, str(tmp_path), "out", "earliest")
    add(spark, path, texts(10, 20), 1)
    add(spark, path, texts(20, 30), 1)
    for name in ("00000000000000000000", "00000000000000000010"):  # retention was faster than the reader
        os.remove(f"{path}/partition=0/{name}.parquet")
    assert run(spark, path, str(tmp_path), "out") == texts(0, 10) + texts(20, 30)
    for name in glob.glob(f"{path}/partition=0/*.parquet"):
        os.remove(name)
    add(spark, path, texts(50, 55), 1)  # made anew: its end lies before the checkpoint
    assert run(spark, path, str(tmp_path), "out") == texts(0, 10) + texts(20, 30) + texts(50, 55)


def test_only_wanted_files_are_opened(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(8):
        add(spark, path, texts(10 * i, 10 * i + 10), 1)
    log = log_source.Log(path)
    (one,) = log.stretches({0: 35}, {0: 52})
    assert [os.path.basename(f)[:20].lstrip("0") for f in one.files] == ["30", "40", "50"]
    assert [r for b in log.rows(one) for r in b.column(1).to_pylist()] == list(range(35, 52))
    assert log.stretches({0: 80}, {0: 80}) == []
    with pytest.raises(ValueError, match="latest or earliest"):
        log_source.LogStream(path, "middle")


def test_a_feed_from_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    beat = '{"timestamp": "2024-01-01T00:00:0%dZ", "service": "s", "host": "h", "agent": "a%d"}'
    add(spark, path, [beat % (i, i) for i in range(4)] + ["{oops"])
    rows = good(feeds.decode(log_source.read(spark, path, streaming=False), "heartbeats"))
    assert sorted(r["agent"] for r in rows.collect()) == ["a0", "a1", "a2", "a3"]
