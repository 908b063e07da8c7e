"""Stateful streams with timers: exact counts of the last hours at each event, and bursts of changes that end in a list or a poll.

Rows of a key are held in its state until the watermark has passed them, and are then taken in order of time, so what a row
gives does not depend on when or how often it came. A key has one timer, at the first row that it holds. State is what a key
has held within the watermark's delay and the span looked back on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where a key's state is kept; timers and state of this kind need it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HELD = Y.StructType([Y.StructField("times", Y.ArrayType(Y.LongType())), Y.StructField("ids", Y.ArrayType(Y.LongType())), Y.StructField("done", Y.IntegerType())])


class Ordered(StatefulProcessor):
    """Rows (key, id, micros) of a key in order of time, each once; settled() sees them when no earlier one can come."""

    names: tuple[str, ...] = ()  # the columns that come out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", _HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.state.get() if self.state.exists() else None
        times, ids, done = (list(held[0]), list(held[1]), held[2]) if held else ([], [], 0)
        known = set(zip(times, ids, strict=True))
        for row in rows:
            one = (row["micros"], row["id"])
            if one not in known and row["micros"] > passed:  # what is late beyond the watermark has no place any more
                known.add(one)
        self._keep(sorted(known), done)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times, ids, done = self.state.get()
        rows = sorted(zip(times, ids, strict=True))
        ready = sum(t <= passed for t, _ in rows)
        out, first = self.settled(rows, done, ready, passed)
        self._keep(rows[first:], max(ready, done) - first if first <= ready else 0)
        for values in out:
            yield Row(**dict(zip(self.names, (*key, *values), strict=True)))

    def _keep(self, rows: list[tuple[int, int]], done: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not rows:
            self.state.clear()
            return
        self.state.update(([t for t, _ in rows], [i for _, i in rows], done))
        wake = self.wakes(rows, done)
        if wake is not None:
            self.handle.registerTimer(-(-wake // 1000))

    def settled(self, rows: list[tuple[int, int]], done: int, ready: int, passed: int) -> tuple[list[tuple], int]:
        """(what comes out, how many of the first rows are needed no more); ``done`` were settled before, ``ready`` are now."""
        raise NotImplementedError

    def wakes(self, rows: list[tuple[int, int]], done: int) -> int | None:
        """The time at which to look again."""
        return rows[done][0] if done < len(rows) else None

    def close(self) -> None:
        pass


class LastHours(Ordered):
    """(key, id, micros, n): how many rows the key has in the span up to each row, itself and rows of its time included."""

    def __init__(self, span: int):
        self.span = span

    def settled(self, rows, done, ready, passed):
        out, first, last = [], 0, 0
        for at in range(done, ready):
            time, one = rows[at]
            while rows[first][0] < time - self.span:
                first += 1
            last = max(last, at)
            while last + 1 < ready and rows[last + 1][0] == time:
                last += 1
            out.append((one, time, last - first + 1))
        return out, first


class Bursts(Ordered):
    """(key, begin, finish, n, action): rows no further than ``quiet`` apart are one burst; of more than ``most`` rows no list can
    be kept, and a poll is asked for."""

    def __init__(self, quiet: int, most: int):
        self.quiet, self.most = quiet, most

    def settled(self, rows, done, ready, passed):
        out, first = [], 0
        for at in range(ready):
            following = rows[at + 1][0] if at + 1 < len(rows) else None
            if (following is None or following - rows[at][0] > self.quiet) and rows[at][0] + self.quiet <= passed:
                n = at + 1 - first
                out.append((rows[first][0], rows[at][0], n, "poll" if n > self.most else "changes"))
                first = at + 1
        return out, first

    def wakes(self, rows, done):
        for at in range(len(rows)):
            if at + 1 == len(rows) or rows[at + 1][0] - rows[at][0] > self.quiet:
                return rows[at][0] + self.quiet
        return None


def _run(events: DataFrame, key: str, id_: str, at: str, late: str, processor: Ordered, columns: list[tuple[str, Y.DataType]]) -> DataFrame:
    spark: SparkSession = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.withWatermark(at, late).select(key, F.col(id_).cast("long").alias("id"), F.unix_micros(at).alias("micros"), at)
    processor.names = (key, *(n for n, _ in columns))
    out = Y.StructType([Y.StructField(key, events.schema[key].dataType), *[Y.StructField(n, t) for n, t in columns]])
    return rows.groupBy(key).transformWithState(processor, out, "Append", "EventTime")


def last_hours(events: DataFrame, key: str, id_: str, at: str, hours: float = 24.0, late: str = "1 hour") -> DataFrame:
    """(key, id, at, n) of a stream: at each row, the rows of its key in the hours before it and itself; repeated rows count once."""
    found = _run(events, key, id_, at, late, LastHours(round(hours * 3600e6)), [("id", Y.LongType()), ("micros", Y.LongType()), ("n", Y.LongType())])
    return found.select(key, F.col("id").alias(id_), F.timestamp_micros("micros").alias(at), "n")


def bursts(events: DataFrame, key: str, id_: str, at: str, quiet_seconds: float = 2.0, most: int = 1000, late: str = "10 minutes") -> DataFrame:
    """(key, begin, finish, n, action) of a stream of changes; action is "changes", or "poll" after more than ``most`` of them."""
    found = _run(events, key, id_, at, late, Bursts(round(quiet_seconds * 1e6), most), [("begin", Y.LongType()), ("finish", Y.LongType()), ("n", Y.LongType()), ("action", Y.StringType())])
    return found.select(key, F.timestamp_micros("begin").alias("begin"), F.timestamp_micros("finish").alias("finish"), "n", "action")
