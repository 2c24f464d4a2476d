"""Bouts of a stream against bouts of a table."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals
from tidemark.streaming import bouts

SCHEMA = "subject_id string, epoch_idx long, ts timestamp, code int"


def deliver(spark, folder, parts):
    """Each part as a file of its own, then two that only move the watermark; runs the stream over all, a file at a time."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("epoch_idx") * 30)
    far = [[("none", 10**6, 0)], [("none", 10**6 + 100, 0)]]
    for k, part in enumerate([*parts, *far]):
        spark.createDataFrame(part, "subject_id string, epoch_idx long, code int").select("subject_id", "epoch_idx", at.alias("ts"), "code").coalesce(1).write.parquet(f"{folder}/in/{k:03d}")


def run(spark, folder, late):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = bouts.closing(stream, F.col("code").isin(1, 2, 3), "subject_id", "ts", late)
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out"), q.recentProgress


def rows(df):
    return sorted((r.subject_id, r["first"], r["last"], r.epochs, r.start, r.stop) for r in df.collect())


@pytest.fixture(scope="module")
def nights():
    r = random.Random(6)
    out = []
    for s in ("a", "b", "c"):
        code = 0
        for i in range(300):
            code = code if r.random() < 0.9 else r.choice([0, 1, 2, 3, 4])
            if r.random() > 0.01:  # some epochs are lost
                out.append((s, i, code))
    return out


def test_shuffled_files_give_the_bouts_of_the_table(spark, tmp_path, nights):
    r = random.Random(7)
    parts: dict = {}
    for e in nights:
        parts.setdefault((e[1] + r.randrange(15)) // 60, []).append(e)
    parts = [r.sample(p, len(p)) for _, p in sorted(parts.items())]
    deliver(spark, tmp_path, parts)
    got, progress = run(spark, tmp_path, "8 minutes")
    table = spark.createDataFrame(nights, "subject_id string, epoch_idx long, code int")
    want = intervals.bouts(table, F.col("code").isin(1, 2, 3), ["subject_id"])
    assert rows(got) == rows(want) and got.count() > 10
    numbers = sorted((r.subject_id, r.bout_idx, r["first"]) for r in got.collect())
    assert [n[:2] for n in numbers] == sorted((s, k) for s in "abc" for k in range(sum(x[0] == s for x in numbers))) and numbers == sorted(numbers, key=lambda x: (x[0], x[2]))
    # what the state holds doesn't grow with the night: a row for each run that is open or may still be joined
    sizes = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert max(sizes) < 120 and sizes[-1] <= 12


def test_epochs_beyond_the_lateness_are_dropped(spark, tmp_path):
    night = [("a", i, 2) for i in range(40) if i != 20]
    deliver(spark, tmp_path, [night, [("a", 200, 0)], [("a", 201, 0)], [("a", 20, 2)]])
    got, _ = run(spark, tmp_path, "1 minute")
    assert [(r["first"], r["last"]) for r in got.orderBy("first").collect()] == [(0, 19), (21, 39)]


def test_messages_of_a_key_dont_grow_with_its_runs():
    """The state is one value and one timer of a key: what is read, written and set doesn't depend on how many runs there are."""
    from types import SimpleNamespace

    calls, kept, timers = [], {}, set()
    state = SimpleNamespace(get=lambda: calls.append("get") or kept.get("v"), update=lambda v: calls.append("update") or kept.update(v=v), clear=lambda: calls.append("clear") or kept.clear())
    handle = SimpleNamespace(getValueState=lambda *a: state, registerTimer=lambda t: calls.append("set") or timers.add(t), deleteTimer=lambda t: calls.append("delete") or timers.remove(t))
    p = bouts.Runs("subject_id", 30.0, 90.0)
    p.init(handle)
    feed = lambda at: list(p.handleInputRows(("a",), iter([SimpleNamespace(epoch_idx=i, due=(i + 1) * 1000, member=True) for i in at]), None))
    assert feed([i for k in range(50) for i in range(10 * k, 10 * k + 4)][::-1]) == [] and timers == {4000} and len(calls) == 3
    assert feed([4]) == [] and timers == {5000} and len(calls) == 7
    fire = lambda t, mark: list(p.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda: t)))
    got = fire(5000, 200_500)
    assert [(r.bout_idx, r["first"], r["last"]) for r in got] == [(k, 10 * k, 10 * k + (4 if k == 0 else 3)) for k in range(20)] and len(calls) == 10
    assert 204_000 in timers
    assert [r.bout_idx for r in fire(204_000, 10**9)] == list(range(20, 50)) and kept["v"] == (50, []) and len(calls) == 12
