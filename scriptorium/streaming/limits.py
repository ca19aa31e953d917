"""Rate limits per key: a window opens at the first request and starts anew when it has expired.

In batch a key's requests are folded in order. In a stream they are held until the watermark has passed them, so that they
are taken in order of time however they arrive; the window is the key's state and goes when it has expired.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.keyed import BUCKETS, KeyedTable

#: Transform-with-state needs the state store on disk.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accepted(window: tuple[int, int] | None, at: int, most: int, length: int, *, inclusive: bool) -> tuple[tuple[int, int], bool]:
    """The window (start, count) after a request at `at` microseconds, and whether it passes.

    inclusive: a request exactly `length` after the start opens a new window. A rejected request leaves the window alone.
    """
    if window is None or at - window[0] > length or (inclusive and at - window[0] >= length):
        return (at, 1), True
    if window[1] >= most:
        return window, False
    return (window[0], window[1] + 1), True


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def replay(events: DataFrame, key: str, ts: str, order: str, most: int, seconds: int, *, inclusive: bool = False) -> DataFrame:
    """key, order and passed for each event. A key's events stream through one task in order, a batch at a time; they are
    sorted by Spark, which spills, and the only state is the open window."""
    length = seconds * 1_000_000
    ordered = events.select(key, order, micros(F.col(ts)).alias("at")).repartition(key).sortWithinPartitions(key, "at", order)
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {order} {events.schema[order].dataType.simpleString()}, passed boolean"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = object(), None
        for batch in batches:
            passed = []
            for k, at in zip(batch[key].tolist(), batch["at"].tolist(), strict=True):
                if k != current:
                    current, window = k, None
                window, ok = accepted(window, at, most, length, inclusive=inclusive)
                passed.append(ok)
            yield pd.DataFrame({key: batch[key], order: batch[order], "passed": passed})

    return ordered.mapInPandas(fold, schema)


class Limiter(StatefulProcessor):
    """A key's state: the open window, and requests that the watermark has not passed, in chunks by the slot of time that
    they belong to. When the watermark passes a slot its requests are taken in order; when it passes the window's end and
    nothing waits, the window goes. What is in memory at a time is a batch of Arrow, or one slot of one key."""

    def __init__(self, key: str, order: str, order_type: str, most: int, length: int, slot: int, *, inclusive: bool):
        self.key, self.order, self.order_type = key, order, order_type
        self.most, self.length, self.slot, self.inclusive = most, length, slot, inclusive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n long")
        self.sizes = handle.getMapState("sizes", "slot long", "chunks long")
        self.chunks = handle.getMapState("chunks", "slot long, chunk long", f"at array<long>, name array<{self.order_type}>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for slot, own in batch.groupby(batch["at"] // self.slot):
                place = (int(slot),)
                n = self.sizes.getValue(place)[0] if self.sizes.containsKey(place) else 0
                self.chunks.updateValue((int(slot), n), (own["at"].tolist(), own[self.order].tolist()))
                self.sizes.updateValue(place, (n + 1,))
                if not n:
                    self.handle.registerTimer((int(slot) + 1) * self.slot // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        window = tuple(self.window.get()) if self.window.exists() else None
        slot = end // self.slot - 1
        if end % self.slot == 0 and self.sizes.containsKey((slot,)):
            (n,) = self.sizes.getValue((slot,))
            waiting = []
            for chunk in range(n):
                at, names = self.chunks.getValue((slot, chunk))
                waiting += zip(at, names, strict=True)
                self.chunks.removeKey((slot, chunk))
            self.sizes.removeKey((slot,))
            passed = []
            for at, _ in sorted(waiting):
                window, ok = accepted(window, at, self.most, self.length, inclusive=self.inclusive)
                passed.append(ok)
            self.window.update(window)
            self.handle.registerTimer(self._expires(window))
            yield pd.DataFrame({self.key: key[0], self.order: [name for _, name in sorted(waiting)], "passed": passed})
        elif window is not None and end // 1000 >= self._expires(window):
            self.window.clear()

    def _expires(self, window: tuple[int, int]) -> int:
        """A millisecond after which any request opens a new window; not one at which a slot ends."""
        at = (window[0] + self.length) // 1000 + 2
        return at + (at * 1000 % self.slot == 0)

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, key: str, ts: str, order: str, most: int, seconds: int, *, inclusive: bool = False, late: str = "1 hour", slot_seconds: int = 1) -> DataFrame:
    """The same on a stream: key, order and passed of each request, when the watermark, `late` behind the newest request,
    has passed it. Requests that come later than that are dropped, as their order can't be known any more. One key's
    requests of one slot of `slot_seconds` are taken at a time. Sets the session's state store to the one on disk."""
    events.sparkSession.conf.set(STORE, ROCKSDB)
    types = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    rows = events.select(key, order, F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", late).withColumn("at", F.unix_micros("_ts"))
    limiter = Limiter(key, order, types[order], most, seconds * 1_000_000, slot_seconds * 1_000_000, inclusive=inclusive)
    return rows.groupBy(key).transformWithStateInPandas(limiter, f"{key} {types[key]}, {order} {types[order]}, passed boolean", "Append", "EventTime")


def keep_search_text(stream: DataFrame, derive: Column, key: str, path: str, checkpoint: str, order: str | None = None, buckets: int = BUCKETS):
    """Starts a query that keeps key, search_text, seen and version, one row a key: written only where it differs from
    what is stored.

    Of a key's rows in a trigger the last by `order` counts, in the order of its own type, and a row that comes later but
    is older than what is stored changes nothing; of equally old rows the later trigger's counts, within a trigger the
    one with the larger hash. Rows without a key have no text to keep. A trigger reads the folders of its keys and
    replaces those that change, so nothing is to be compacted.
    """
    seen = F.col(order) if order else F.lit(0)

    def merge(batch: DataFrame, _: int) -> None:
        KeyedTable(batch.sparkSession, path, [key], "seen", buckets).merge(batch.select(key, derive.alias("search_text"), seen.alias("seen")))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
