"""Bouts of a stream of epochs, each told once when it can't change any more.

The state of a subject are the runs of member epochs that the watermark hasn't passed, so it is as long as the
lateness that is allowed, and one open run. Epochs may come in any order within that time: an epoch extends a run, joins two, or is
one of its own. A run that the watermark has passed by an epoch can't be continued; it is then emitted, if it is long
enough, and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship


class Runs(StatefulProcessor):
    """Runs of consecutive epochs of one key: first, last, end of the epoch after it in milliseconds.

    Each look at the state is a message to the executor, so a key has one value, which holds all its runs, and one
    timer, for the run that is over first.
    """

    def __init__(self, key: str, epoch_sec: float, min_sec: float):
        self.key, self.epoch_sec, self.min_sec = key, epoch_sec, min_sec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", "told long, runs array<bigint>")

    def held(self) -> tuple[int, list[list[int]]]:
        """The number of bouts told so far, and the runs, in order."""
        value = self.state.get()
        if value is None:
            return 0, []
        told, flat = value
        return int(told), [list(map(int, flat[i : i + 3])) for i in range(0, len(flat), 3)]

    def keep(self, told: int, runs: list[list[int]]) -> None:
        self.state.update((told, [x for r in runs for x in r]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [[r.epoch_idx, r.epoch_idx, r.due] for r in rows if r.member]
        if not new:
            return iter(())
        told, held = self.held()
        merged: list[list[int]] = []
        for first, last, due in sorted([*held, *new]):
            if merged and first <= merged[-1][1] + 1:
                if last > merged[-1][1]:
                    merged[-1][1:] = [last, due]
            else:
                merged.append([first, last, due])
        if merged == held:
            return iter(())
        self.keep(told, merged)
        before, after = min((r[2] for r in held), default=None), min(r[2] for r in merged)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        told, held = self.held()
        out, left = [], []
        for run in held:
            first, last, due = run
            if due > now:
                left.append(run)
            elif (last - first + 1) * self.epoch_sec >= self.min_sec:
                out.append(Row(**{self.key: key[0], "bout_idx": told, "first": first, "last": last, "epochs": last - first + 1, "start": float(first * self.epoch_sec), "stop": float((last + 1) * self.epoch_sec)}))
                told += 1
        if told or left:
            self.keep(told, left)
        else:
            self.state.clear()
        if left:
            self.handle.registerTimer(min(r[2] for r in left))
        return iter(out)

    def close(self) -> None:
        pass


def closing(epochs: DataFrame, member: Column, key: str, ts: str, late: str = "10 minutes", epoch_sec: float = 30.0, min_sec: float = 200.0) -> DataFrame:
    """A stream of bouts from a stream of epochs (key, epoch_idx, ts at each epoch's start); an epoch later than ``late`` is dropped.

    Epochs that are no members only move the watermark. A lost epoch ends a run, as it does in ``intervals.bouts``.
    """
    spark = epochs.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = epochs.schema[key].dataType.simpleString()
    # the run is over once the watermark has passed the start of the epoch after it
    due = (F.unix_millis(F.col(ts)) + int(epoch_sec * 1000)).alias("due")
    # members are told from others in the state's own code: a filter would be moved below the watermark, and others must move it
    own = epochs.withWatermark(ts, late).select(key, "epoch_idx", ts, due, F.coalesce(member, F.lit(False)).alias("member"))
    schema = f"`{key}` {kind}, bout_idx long, first long, last long, epochs long, start double, stop double"
    return own.groupBy(key).transformWithState(Runs(key, epoch_sec, min_sec), outputStructType=schema, outputMode="append", timeMode="eventTime")
