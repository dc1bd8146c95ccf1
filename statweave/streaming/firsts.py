"""First occurrences inside a stream's state store, whatever order the rows arrive in."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..schema import KEY

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD_ROWS = 1_000_000  # rows that a task holds at most while it looks for the first of each key
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _order(values) -> tuple:
    """Nulls come first, as in Spark."""
    return tuple((v is not None, v) for v in values)


class FirstOccurrence(StatefulProcessor):
    """Remembers per key the place of its earliest row; passes on a row that is earlier than all before it.

    With a delay in milliseconds a timer forgets a key once the watermark is that far behind its last row.
    """

    def __init__(self, order: list[str], time: str | None, delay: int | None):
        self.order, self.time, self.delay = order, time, delay

    def init(self, handle) -> None:
        self.handle = handle
        # The place is kept as text pairs, so any orderable column of numbers and text fits one state schema.
        self.place = handle.getValueState("place", ", ".join(f"o{i} string, n{i} double, l{i} long" for i in range(len(self.order))))
        self.until = handle.getValueState("until", "at long")

    def _read(self):
        held = self.place.get()  # one call to the store; a key without a place has none
        if held is None:
            return None
        return _order(next((x for x in held[3 * i : 3 * i + 3] if x is not None), None) for i in range(len(self.order)))

    def _write(self, row: Row) -> None:
        held = []
        for name in self.order:
            v = row[name]
            whole, text = isinstance(v, int), isinstance(v, str)
            held += [v if text else None, None if whole or text else v, v if whole else None]
        self.place.update(tuple(held))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best, latest = None, None
        for row in rows:
            if best is None or _order(row[c] for c in self.order) < _order(best[c] for c in self.order):
                best = row
            if self.time is not None and row[self.time] is not None:
                latest = row[self.time] if latest is None else max(latest, row[self.time])
        known = self._read()
        if known is None or _order(best[c] for c in self.order) < known:
            self._write(best)
            yield best
        if latest is not None and self.delay is not None:
            at = int(latest.replace(tzinfo=latest.tzinfo or dt.timezone.utc).timestamp() * 1000) + self.delay
            (old,) = self.until.get() or (None,)
            if old is None or at > old:
                if old is not None:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(at)
                self.until.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.place.clear()
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def _firsts(rows: pa.Table, keys: list[str], order: list[str]) -> pa.Table:
    """One row per key: the earliest by `order`, nulls first."""
    places = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
    ordered = rows.select(keys).take(places).append_column("_at", pa.array(range(len(rows)), pa.int64()))
    first = ordered.group_by(keys, use_threads=False).aggregate([("_at", "min")]).column("_at_min")
    return rows.take(places.take(first.combine_chunks()))


def _earliest(keys: list[str], order: list[str]):
    """One row per key of a task, so that a crowded key reaches the state store as few rows.

    While most of HELD_ROWS rows have keys of their own they are passed on as they are found, which bounds the memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD_ROWS:
                few = _firsts(pa.Table.from_batches(held), keys, order)
                if len(few) > HELD_ROWS * 3 // 4:
                    yield from few.to_batches(10_000)
                    held, n = [], 0
                else:
                    held, n = few.to_batches(), len(few)
        if n:
            yield from _firsts(pa.Table.from_batches(held), keys, order).to_batches(10_000)

    return run


def improving_firsts(rows: DataFrame, order: list[str], keys: list[str] = KEY, time: str | None = None, delay_ms: int | None = None) -> DataFrame:
    """Rows of a stream that come earlier, by `order`, than every row of their key so far.

    The last row a key passes on is its first occurrence, for any order of arrival; ``keep_first`` over the result
    settles it, and reads as many rows as there were improvements instead of all of the source.  With `time` (a timestamp) and
    `delay_ms` a key is forgotten once the watermark is that far behind its last row, which bounds the state by the keys of that
    span; a key that returns later counts as new.  Order columns are numbers or text.
    """
    spark = rows.sparkSession
    spark.conf.set(_PROVIDER, ROCKSDB)  # the store that keeps several states and timers per key
    if time is not None:
        rows = rows.withWatermark(time, "0 seconds")
    few = rows.mapInArrow(_earliest(keys, order), rows.schema)
    processor = FirstOccurrence(order, time if delay_ms is not None else None, delay_ms)
    mode = "EventTime" if delay_ms is not None else "None"
    return few.groupBy(*keys).transformWithState(processor, rows.schema, "Append", mode)


def source_place(seq: str = "seq") -> list:
    """The sequence of a source row as plain columns."""
    return [F.col(f"{seq}.file").alias("seq_file"), F.col(f"{seq}.block").alias("seq_block"), F.col(f"{seq}.row").alias("seq_row")]


PLACE = ["seq_file", "seq_block", "seq_row"]
