"""Streams against their batch forms."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from quarry.sources import scan, watch
from quarry.streaming import debounce as feed


def until(seconds, done):
    end = time.time() + seconds
    while time.time() < end and not done():
        time.sleep(0.2)
    return done()


def test_snapshots_of_a_directory():
    before = {"a": [1, 10], "b": [1, 10], "c": [5000, 10]}
    seen = {"b": [900, 11], "c": [9900, 12], "d": [9950, 1], "e": [9000, 1]}
    after = watch.settled(before, seen, 10_000, 200)
    assert after == {"b": [900, 11], "c": [5000, 10], "e": [9000, 1]}  # c and d are still being written
    assert watch.difference(before, after, 7) == [("a", "unlink", 1, 10, 7), ("b", "change", 900, 11, 7), ("e", "add", 9000, 1, 7)]
    assert watch.difference(after, after, 8) == []


def test_directory_changes(spark, tmp_path):
    """Files that come, change and go while a stream runs; and what has happened while none ran, from the checkpoint."""
    root, state, point = tmp_path / "tree", tmp_path / "state", tmp_path / "point"
    root.mkdir()
    (root / "old.txt").write_text("old")
    (root / "gone.txt").write_text("gone")
    spark.dataSource.register(watch.DirectoryChanges)
    got = []

    def start():
        stream = spark.readStream.format("directory_changes").option("state", str(state)).option("stability", "100").load(str(root))
        keep = lambda df, _: got.extend((r["path"], r["kind"]) for r in df.collect())
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(point)).trigger(processingTime="300 milliseconds").start()

    q = start()
    try:
        assert until(60, lambda: (state / "000000000000.json").exists())
        (root / "sub").mkdir()
        (root / "sub" / "new.txt").write_text("new")
        (root / ".hidden").write_text("x")
        assert until(60, lambda: ("sub/new.txt", "add") in got)
        (root / "sub" / "new.txt").write_text("longer")
        os.remove(root / "gone.txt")
        assert until(60, lambda: {("sub/new.txt", "change"), ("gone.txt", "unlink")} <= set(got))
    finally:
        q.stop()
    (root / "old.txt").write_text("changed while no stream ran")
    time.sleep(0.2)
    q = start()
    try:
        assert until(60, lambda: ("old.txt", "change") in got)
    finally:
        q.stop()
    assert sorted(got) == sorted([("sub/new.txt", "add"), ("sub/new.txt", "change"), ("gone.txt", "unlink"), ("old.txt", "change")])
    # The batch form: the difference of two scans.
    now = spark.createDataFrame([(p.relative_to(root).as_posix(), str(p.stat().st_size), 0.0) for p in root.rglob("*.txt")], "path string, hash string, modified_time double")
    then = spark.createDataFrame([("old.txt", "3", 0.0), ("gone.txt", "4", 0.0)], now.schema)
    assert {(r["path"], r["status"]) for r in scan.delta(now, then).collect()} == {("sub/new.txt", "new"), ("old.txt", "modified"), ("gone.txt", "deleted")}


def test_debounce_by_the_clock(spark, tmp_path):
    """The last of each burst comes out, once nothing has followed it for the gap: for bursts far apart what the batch form keeps."""
    schema = "key long, kind string, ts timestamp, event_id long"
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    first = [(1, "add", at(1), 1), (1, "change", at(2), 2), (2, "add", at(1), 3), (2, "unlink", at(3), 4)]
    second = [(1, "unlink", at(40), 5)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = feed.debounce_arrivals(stream, 1500).writeStream.format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="300 milliseconds").start()
    ids = lambda: {r["event_id"] for r in spark.sql("SELECT event_id FROM clock").collect()}
    try:
        assert until(90, lambda: ids() == {2, 4})
        spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert until(90, lambda: ids() == {2, 4, 5})
    finally:
        out.stop()
    batch = spark.createDataFrame(first + second, schema)
    assert {r["event_id"] for r in feed.debounce(batch, 10_000).select(F.col("event_id")).collect()} == {2, 4, 5}
