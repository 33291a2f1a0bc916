"""Stateful processors, and stream against batch."""

from __future__ import annotations

import time

import pytest

from quillmark.streaming import jobs
from quillmark.streaming import processors as P

DAY = 86_400
POLL = "cik long, accession string, date string, pos int, seed boolean, now long"


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_mark_and_seen(spark, tmp_path):
    rows = [
        (1, "a", "2026-01-05", 0, True, 100), (1, "old", "2026-01-04", 1, False, 200), (1, "same-day", "2026-01-05", 2, False, 200), (1, "a", "2026-01-05", 0, False, 200), (1, "new", "2026-01-06", 0, False, 200),
        (1, "late", "2026-01-05", 0, False, 300), (1, "new", "2026-01-06", 0, False, 300), (2, "b", "2026-01-01", 0, False, 300),
    ]
    df = spark.createDataFrame(rows, POLL)
    out = jobs.replay(df, P.new_filings, "now", parts=3, work=str(tmp_path))
    assert got(out, "cik", "accession", "now") == [(1, "new", 200), (1, "same-day", 200), (2, "b", 300)]


def test_queue(spark, tmp_path):
    wait = [("q", f"u{i}", 14 * 60) for i in range(11)]
    df = spark.createDataFrame([("q", None, 0), ("k", "x0", 10**6), *wait, *[("w", f"v{i}", 60) for i in range(12)], ("q", "u11", 15 * 60)], "queue string, uid string, now long")
    out = jobs.replay(df, P.due_items, "now", parts=3, work=str(tmp_path))
    fired = {(r.queue, r.uid): r.fired for r in out.collect()}
    assert all(fired["q", f"u{i}"] == 15 * 60 for i in range(12)) and all(fired["w", f"v{i}"] == 60 for i in range(12)) and fired["k", "x0"] == 10**6


def test_suppression(spark, tmp_path):
    df = spark.createDataFrame([("e", "a", 0), ("e", "b", 4 * DAY), ("e", "c", 4 * DAY + 1), ("f", "d", 4 * DAY)], "event_key string, uid string, now long")
    out = jobs.replay(df, P.unsuppressed, "now", parts=2, work=str(tmp_path))
    assert got(out, "uid") == [("a",), ("c",), ("d",)]


def test_suppression_forgets(spark, tmp_path):
    """The state holds what the last days need, however long the stream."""
    schema = "event_key string, uid string, now long"
    for day in range(0, 60, 3):
        rows = [(f"k{day + i % 3}", f"u{day}-{i}", (day + i % 3) * DAY) for i in range(30)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = P.unsuppressed(jobs.stream(spark, f"{tmp_path}/in", schema, 1000), buckets=4)
        jobs.run_available(out, lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    state = spark.read.format("statestore").load(f"{tmp_path}/checkpoint")
    held = [k for r in state.selectExpr("value.groupState.events AS e").collect() for k in r.e]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60 and 0 < len(held) <= 20 and "k0" not in held and "k59" in held


def test_seeding_is_silent(spark, tmp_path):
    rows = [(1, "a", "2026-01-05", 0, True, 100), (1, "b", "2026-01-07", 1, True, 100), (1, "c", "2026-01-06", 0, False, 200), (1, "d", "2026-01-07", 0, False, 200), (2, "x", None, 0, False, 200), (2, "y", None, 0, False, 300)]
    out = jobs.replay(spark.createDataFrame(rows, POLL), P.new_filings, "now", parts=2, work=str(tmp_path))
    assert got(out, "cik", "accession") == [(1, "d"), (2, "x"), (2, "y")]


def test_queue_fires_by_the_clock(spark, tmp_path):
    """What waits is given out though no further row comes."""
    now = int(time.time())
    spark.createDataFrame([("q", "a", now - 1), ("q", "b", now)], "queue string, uid string, now long").coalesce(1).write.parquet(f"{tmp_path}/in")
    items = P.due_items(jobs.stream(spark, f"{tmp_path}/in", "queue string, uid string, now long"), size=5, seconds=3, timer=True)
    query = items.writeStream.format("memory").queryName("given").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while spark.table("given").count() < 2 and time.time() < until:
            time.sleep(0.5)
        fired = {r.uid: r.fired for r in spark.table("given").collect()}
    finally:
        query.stop()
    assert fired["a"] == now - 1 and fired["b"] >= now - 1 + 3


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_batch(spark, tmp_path, parts):
    df = spark.createDataFrame([(f"k{i % 3}", f"u{i:02d}", i * DAY) for i in range(30)], "event_key string, uid string, now long")
    out = jobs.replay(df, P.unsuppressed, "now", parts=parts, work=str(tmp_path))
    last, want = {}, []
    for i in range(30):
        k = f"k{i % 3}"
        if k not in last or i * DAY - last[k] > 4 * DAY:
            want.append((f"u{i:02d}",))
            last[k] = i * DAY
    assert got(out, "uid") == want


def test_first_seen(spark, tmp_path):
    rows = [("a", 0), ("b", 10), ("a", 60), ("c", 60), ("b", 120), ("a", 120)]
    df = spark.createDataFrame(rows, "uid string, now long").selectExpr("uid", "now", "timestamp_seconds(now) AS ts")
    out = jobs.replay(df, lambda s: P.first_seen(s, "1 hour"), "now", parts=3, work=str(tmp_path))
    assert got(out, "uid") == [("a",), ("b",), ("c",)]
