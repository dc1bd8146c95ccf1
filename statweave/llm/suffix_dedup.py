"""Byte deduplication by ranking suffixes through prefix doubling.

A suffix's rank by its first 2h bytes is the pair of ranks by h bytes of itself and of the suffix h further on. Ranks are names: equal
prefixes have equal names, in the whole corpus, so that pairs can be sorted anywhere and no rank has to be sent back. Not every suffix
is ranked from the start: the first round sorts the short prefixes at anchors (see `repeats`), and suffixes whose prefix is unique leave.
Those that remain open are ranked by pairs at doubled offsets until the threshold is passed, and the sorted pairs show which suffix
is not the first with its prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm import kernel, repeats
from statweave.llm.frames import stored

THRESHOLD, GRAM = 100, 32


def byte_units(buf: np.ndarray, offs: np.ndarray) -> repeats.Units:
    return repeats.Units(kernel._BYTE[buf], offs)


def doubled_names(units: np.ndarray, length: int) -> np.ndarray:
    """Names of all prefixes of this length: from single units, names of twice the length pair two names at that offset."""
    have, names = 1, kernel.mix(units)
    while have < length:
        step = min(have, length - have)  # the last pair overlaps where the length is no power of two
        left, right = names[: len(names) - step], names[step:]
        names = kernel.mix(left * np.uint64(0x9E3779B97F4A7C15) + kernel.mix(right ^ np.uint64(have + step)))
        have += step
    return names


def _open_pairs(threshold: int):
    """Rank pairs of the open suffixes: the first of each pair here, and which repeat it."""
    half = threshold // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out():
            r1, r2, doc, start = (np.concatenate(x) for x in zip(*held))
            rank = kernel.mix(r1 ^ kernel.mix(r2))  # the pair's own name, by which it is sorted
            return repeats.collapsed(rank, rank, doc, start, np.ones(len(doc), np.int64))

        for doc_id, texts, start, count in repeats.each_document(batches):
            if not texts or not len(start):
                continue
            buf = np.frombuffer(texts[0], np.uint8)
            at = np.unique(np.concatenate([np.arange(s, s + c) for s, c in zip(start.tolist(), count.tolist())]))
            at = at[at <= len(buf) - threshold]
            # Names are computed around the open places only.
            breaks = np.flatnonzero(np.diff(at) > threshold) + 1
            for part in np.split(at, breaks):
                if not len(part):
                    continue
                a = int(part[0])
                names = doubled_names(kernel._BYTE[buf[a : int(part[-1]) + threshold]], half)
                r1, r2 = names[part - a], names[part - a + threshold - half]
                held.append((r1, r2, np.full(len(part), doc_id), part))
                size += len(part)
            if size >= repeats.HOLD_ROWS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _repeated_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes that are not the first of their rank pair, from rows sorted by it."""
    for batch in repeats._settle(batches):
        kind = batch.column("kind").to_numpy()
        yield batch.select(["doc_id", "start", "count"]).filter(pa.array((kind == repeats.REPEATED) | (kind == repeats.SETTLED)))


def _cleaned(threshold: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc_id, texts, start, count in repeats.each_document(batches):
            for text in texts:
                gone = repeats.covered(len(text), start, count, threshold)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
                out.append((doc_id, len(text), spans, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            if len(out) >= 1000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def repeated_suffixes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Suffixes whose first `threshold` bytes also start earlier, as runs: doc_id, start, count (of consecutive suffixes)."""
    spark = docs.sparkSession
    runs = repeats.window_runs(docs, byte_units, threshold, min(GRAM, threshold))
    opened = runs.where(F.col("kind") == repeats.UNDECIDED)
    pairs = repeats.beside_text(docs.where("doc_id is not null"), opened, _open_pairs(threshold), "route long, key long, doc_id long, start int, count int")
    pairs = pairs.repartition("route").sortWithinPartitions("route", "key", "doc_id", "start")
    later = stored(pairs.mapInArrow(_repeated_suffixes, "doc_id long, start int, count int"), "suffix-later")
    return runs.where(F.col("kind").isin(repeats.REPEATED, repeats.SETTLED)).select("doc_id", "start", "count").unionByName(later)


def remove_repeated_bytes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """What is left of every text when all bytes go that a repeated string of `threshold` bytes covers.

    docs: doc_id, text. A byte goes if it lies in a string of that length which also starts earlier: in a smaller doc_id, or in the same
    document further left. Returns doc_id, n_bytes, spans (removed runs: start, end in bytes), n_removed, kept_sha256; one row per input
    row. Null and empty texts have no bytes. Rows without doc_id neither remove nor lose anything. Rows repeated with one id are one
    document. Names are 64-bit hashes. An empty table gives an empty result.
    """
    gone = repeated_suffixes(docs, threshold)
    return repeats.beside_text(docs, gone, _cleaned(threshold), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, n_removed long, kept_sha256 string")
