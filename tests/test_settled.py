"""Debouncing by state and timers: lone events, bursts over micro-batches, restarts."""

import time
from datetime import datetime

import pytest

from loregrid.streaming import watch

SCHEMA = "path string, op string, at timestamp, n long"


@pytest.fixture
def stream(spark, tmp_path):
    before = spark.conf.get(watch.STATE_STORE[0], None)
    spark.conf.set(*watch.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    (tmp_path / "in").mkdir()
    got, queries = [], []

    def add(*rows):
        data = [(p, op, datetime(2026, 1, 1, 0, 0, s), s) for p, op, s in rows]
        at = tmp_path / f"made-{len(list((tmp_path / 'in').iterdir()))}"
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.json(str(at))
        file = next(at.glob("part-*.json"))
        file.rename(tmp_path / "in" / f"{at.name}.json")

    def start(gap_ms):
        events = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        keep = lambda kind: lambda b: got.extend((kind, r.path, r.events) for r in b.collect())
        queries.append(watch.watch_settled(events, keep("up"), keep("gone"), str(tmp_path / "ck"), gap_ms))
        return queries[-1]

    yield add, start, got
    for q in queries:
        q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset(watch.STATE_STORE[0]) if before is None else spark.conf.set(watch.STATE_STORE[0], before)


def wait(what, seconds=90):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.2)
    return what()


def read_by(q):
    return sum(s["numInputRows"] for p in q.recentProgress for s in p["sources"] if "FileStream" in s["description"])


def test_a_lone_event_needs_no_later_one(stream):
    add, start, got = stream
    add(("a", "write", 1))
    start(500)
    assert wait(lambda: got == [("up", "a", 1)]), got


def test_bursts_merge_and_a_restart_repeats_nothing(stream):
    add, start, got = stream
    add(("a", "create", 1), ("b", "write", 1), ("a", "write", 2))
    q = start(25_000)
    assert wait(lambda: read_by(q) == 3)
    add(("b", "remove", 3), ("a", "write", 0))  # the second came late: an older event
    assert wait(lambda: read_by(q) == 5)
    assert got == []  # both are still in their burst
    q.stop()
    q = start(25_000)
    assert wait(lambda: len(got) == 2), got
    assert sorted(got) == [("gone", "b", 2), ("up", "a", 3)]
    add(("c", "write", 9))
    q.stop()
    q = start(500)
    assert wait(lambda: len(got) == 3) and got[-1] == ("up", "c", 1)
