"""Which windows of a corpus were seen earlier: the part that byte and word deduplication share.

A document is a sequence of units (bytes or words); a window is a fixed number of consecutive units. In every window one short gram,
the one of least hash, is its anchor, chosen by content alone, so equal windows have equal anchors at equal places. Consecutive windows
mostly share an anchor; such a run of windows with all its units is a context. Only a few per cent of all positions are anchors, and
sorting these finds all that can repeat: a gram seen once rules out all windows around it. Contexts that are equal as a whole repeat
window by window. The windows of different contexts around one gram are undecided and are looked at one by one.

Tasks first collapse what repeats within their own rows, so that a passage in very many documents reaches a shuffle once per task.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm import kernel
from statweave.llm.frames import grouped, map_batches, stored, with_bytes

HOLD_ROWS = 1_000_000
"""Rows that a task gathers before it collapses repetitions among them."""
_PLACE = np.uint64((1 << 28) - 1)

REPEATED, FIRST, UNDECIDED, SETTLED = 0, 1, 2, 3
"""Of a run of windows: all were seen earlier; it is the first of several equal contexts; its windows must be looked at singly; an equal
context came earlier in the same task."""


@dataclasses.dataclass
class Units:
    """Hash of every unit of a batch, and where each document begins among them."""

    hashes: np.ndarray
    first: np.ndarray


def anchor_runs(units: Units, window: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows that share their anchor: document (index), start, count, hash of the gram, hash of the context."""
    n = len(units.hashes)
    if n < window:
        return {k: np.zeros(0, np.uint64 if k in ("gram", "context") else np.int64) for k in ("doc", "start", "count", "gram", "context")}
    sums = kernel.unit_sums(units.hashes)
    at = np.arange(n - gram + 1)
    grams = kernel.range_hash(sums, at, at + gram)
    # Least hash in each window; the place in the low bits breaks ties towards the left and says where it is.
    least = kernel.sliding_min((grams & ~_PLACE) | at.astype(np.uint64), window - gram + 1)
    size = np.diff(units.first)
    doc = np.repeat(np.arange(len(size)), np.maximum(0, size - window + 1))
    begin = np.cumsum(np.maximum(0, size - window + 1)) - np.maximum(0, size - window + 1)
    start = units.first[doc] + np.arange(len(doc)) - begin[doc]
    anchor = (least[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    where = np.flatnonzero(new)
    count = np.diff(np.append(where, len(start)))
    s, q = start[where], anchor[where]
    context = kernel.range_hash(sums, s, s + count - 1 + window)
    context = kernel.mix(context ^ kernel.mix((q - s).astype(np.uint64)))
    return {"doc": doc[where], "start": s - units.first[doc[where]], "count": count, "gram": grams[q], "context": context}


def earliest(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, document and start, and which entries of that order are the first of their key."""
    order = np.lexsort((start, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


_ROWS = pa.schema([("route", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("count", pa.int32())])


def collapsed(route: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle: the first of each key goes to its route; what repeats it here is settled (key null) and goes anywhere."""
    order, new = earliest([key], doc, start)
    route, key, doc, start, count = (x[order] for x in (route, key, doc, start, count))
    once = new.copy()  # a row that is repeated with its id is the same place
    once[1:] |= (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    route, key, doc, start, count, new = (x[once] for x in (route, key, doc, start, count, new))
    anywhere = kernel.mix(doc.astype(np.int64).view(np.uint64) ^ kernel.mix(start.astype(np.uint64)))
    return pa.record_batch(
        [
            pa.array(np.where(new, route.view(np.uint64), anywhere).view(np.int64)),
            pa.array(key.view(np.int64), mask=~new), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int32()),
        ],
        schema=_ROWS,
    )


def _contexts(split: Callable[[np.ndarray, np.ndarray], Units], window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for rows, buf, offs in kernel.slices(batch):
                runs = anchor_runs(split(buf, offs), window, gram)
                ids = rows.column("doc_id").to_numpy()[runs["doc"]]
                held.append((runs["gram"], runs["context"], ids, runs["start"], runs["count"]))
                size += len(ids)
                if size >= HOLD_ROWS:
                    yield collapsed(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if size:
            yield collapsed(*(np.concatenate(x) for x in zip(*held)))

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by kind, from rows sorted by route, key, document and start. Only the open gram's first row is carried over."""
    last: tuple[int, int, int, int] | None = None  # route, key, document and start of the row before
    waiting = None  # first row of a gram that has shown one context so far
    unpaired = None  # first row of a context that has shown one member so far

    for batch in batches:
        key = batch.column("key")
        done = np.asarray(key.is_null())
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("route", "doc_id", "start", "count")}
        out = [(cols["doc_id"][done], cols["start"][done], cols["count"][done], np.full(int(done.sum()), SETTLED, np.int8))]
        cols = {c: x[~done] for c, x in cols.items()}
        keys = key.drop_null().to_numpy()
        n = len(keys)
        if n:
            row = lambda i: tuple(int(cols[c][i]) for c in ("doc_id", "start", "count"))
            add = lambda r, kind: out.append(tuple(np.array([v]) for v in (*r, kind)))
            pick = lambda i, kind: out.append((cols["doc_id"][i], cols["start"][i], cols["count"][i], np.full(len(i), kind, np.int8)))
            before_route = np.concatenate([[last[0] if last else 0], cols["route"][:-1]])
            before_key = np.concatenate([[last[1] if last else 0], keys[:-1]])
            new_route = cols["route"] != before_route
            new_key = new_route | (keys != before_key)
            if last is None:
                new_route[0] = new_key[0] = True
            before_doc = np.concatenate([[last[2] if last else 0], cols["doc_id"][:-1]])
            before_start = np.concatenate([[last[3] if last else 0], cols["start"][:-1]])
            elsewhere = (cols["doc_id"] != before_doc) | (cols["start"] != before_start)
            pick(np.flatnonzero(~new_key & elsewhere), REPEATED)
            # Contexts that turn out to have a second member.
            if unpaired is not None:
                if not new_key[0]:
                    add(unpaired, FIRST)
                unpaired = None
            heads = np.flatnonzero(new_key)
            if len(heads):
                size = np.diff(np.append(heads, n))
                pick(heads[size > 1], FIRST)
                if size[-1] == 1:
                    unpaired = row(int(heads[-1]))
            # Grams with several contexts.
            gram = np.cumsum(new_route) - (1 if new_route[0] else 0)  # 0: the first gram of this batch
            contexts = np.bincount(gram[heads], minlength=int(gram[-1]) + 1)
            opened = not new_route[0]  # the first gram went on from before
            several = contexts > 1
            if opened and contexts[0] > 0:
                several[0] = True
                if waiting is not None:
                    add(waiting, UNDECIDED)
                    waiting = None
            pick(heads[several[gram[heads]]], UNDECIDED)
            if not (opened and gram[-1] == 0):
                waiting = row(int(heads[-1])) if not several[-1] else None
            last = (int(cols["route"][-1]), int(keys[-1]), int(cols["doc_id"][-1]), int(cols["start"][-1]))
        doc, start, count, kind = (np.concatenate(x) for x in zip(*out))
        yield pa.record_batch(
            {"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int32()), "count": pa.array(count, pa.int32()), "kind": pa.array(kind, pa.int8())}
        )


def window_runs(docs: DataFrame, split: Callable[[np.ndarray, np.ndarray], Units], window: int, gram: int) -> DataFrame:
    """Runs of windows that repeat or may repeat: doc_id, start, count, kind. Rows without doc_id take no part."""
    spark = docs.sparkSession
    rows = map_batches(with_bytes(docs.where("doc_id is not null"), "doc_id"), _contexts(split, window, gram), "route long, key long, doc_id long, start int, count int")
    rows = rows.repartition("route").sortWithinPartitions("route", "key", "doc_id", "start")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    settled = stored(rows.mapInArrow(_settle, "doc_id long, start int, count int, kind byte"), "window-runs")
    return settled


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress(x or b"") for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "text"])


def beside_text(docs: DataFrame, runs: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Bring each document's text (compressed for the way) and its runs together, and map the sorted stream of both."""
    texts = map_batches(with_bytes(docs, "doc_id"), _squeeze, "doc_id long, text binary")
    nothing = F.lit(None)
    rows = texts.select("doc_id", "text", nothing.cast("int").alias("start"), nothing.cast("int").alias("count")).unionByName(
        runs.select("doc_id", nothing.cast("binary").alias("text"), "start", "count")
    )
    # Rows without id are spread; they meet no runs.
    dealt = rows.repartition(F.coalesce("doc_id", F.xxhash64("text"))).sortWithinPartitions("doc_id", F.col("text").isNull())
    return map_batches(dealt, fn, schema)


def each_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[bytes], np.ndarray, np.ndarray]]:
    """Id, texts (several if the id is repeated), starts and counts of its runs, from a stream of `beside_text`."""
    open_zstd = zstandard.ZstdDecompressor()
    for table in grouped(batches, "doc_id"):
        doc_id = table["doc_id"][0].as_py()
        text = table["text"].combine_chunks()
        n = len(text) - text.null_count
        texts = [open_zstd.decompress(x) for x in text.slice(0, n).to_pylist()]
        start, count = (table[c].slice(n).to_numpy().astype(np.int64) for c in ("start", "count"))
        yield doc_id, texts, start, count


def covered(n: int, start: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Which of n units lie in a window of one of the runs."""
    change = np.zeros(n + 1, np.int64)
    ok = start + count - 1 + window <= n
    np.add.at(change, start[ok], 1)
    np.add.at(change, (start + count - 1 + window)[ok], -1)
    return np.cumsum(change[:n]) > 0
