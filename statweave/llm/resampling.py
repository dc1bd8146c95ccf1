"""Importance resampling towards a target text, with ranks from parallel sorting by regular sampling.

Features of texts (runs of 1 to n words) are counted in hashed buckets, for the documents and for the target. The gain of a bucket is the
log of how much likelier it is in the target; the gains are one small array, by which every document is scored. Gumbel noise from its id
is added, so the highest scores are a sample without replacement by importance.

The highest scores are found without one global sort: each task sorts its run of scores and gives keys at regular distances; the keys of
all runs yield splitters; counts between the splitters, added up from the top, say which segments can be drawn at all and which rank each
begins with; only those segments are exchanged, and merged inside one task each.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm import kernel
from statweave.llm.frames import map_batches, stored, with_bytes

RUN_SAMPLES = 64
"""Keys that a sorted run of up to RUN_ROWS scores gives: the driver sees one key of about 16,000 rows."""
RUN_ROWS = 1_000_000
SEGMENT_ROWS = 250_000
"""Rows aimed at in a segment."""

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_of_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range, one byte of all ranges at a time."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at = start[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    live, step = len(at), 0
    descending = -length[order]
    while live:
        live = int(np.searchsorted(descending, -step, "left"))  # ranges longer than the bytes read so far
        part = crc[:live]
        crc[:live] = _CRC[(part ^ buf[at[:live] + step]) & 0xFF] ^ (part >> np.uint32(8))
        step += 1
    out = np.empty(len(at), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _features(rows_buf: np.ndarray, offs: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature and its document; words of every document."""
    low = kernel.lower_ascii(rows_buf)
    start, end, first = kernel.find_words(low, offs, _INSIDE)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    found, owner = [], []
    if longest == 1:
        found, owner = [crc32_of_ranges(low, start, end)], [doc]
    else:
        # Words one space apart, so that a run of words is one range.
        room = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start + 1, out=room[1:])
        text = np.full(int(room[-1]), 32, np.uint8)
        inside = np.ones(len(text), bool)
        inside[room[1:] - 1] = False
        text[inside] = low[(np.arange(len(text)) + np.repeat(start - room[:-1], end - start + 1))[inside]]
        for n in range(1, longest + 1):
            at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
            found.append(crc32_of_ranges(text, room[at], room[at + n] - 1))
            owner.append(doc[at])
    bucket = np.concatenate(found).astype(np.int64) % buckets if found else np.zeros(0, np.int64)
    return bucket, np.concatenate(owner) if owner else np.zeros(0, np.int64), words


def _count(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, buf, offs in kernel.slices(batch):
                total += np.bincount(_features(buf, offs, longest, buckets)[0], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: one array, as long as there are buckets, per task and in the end."""
    local = map_batches(with_bytes(texts), _count(longest, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in local.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log of the ratio of smoothed shares, rounded down, by bucket."""
    s, t, m = int(source.sum()), int(target.sum()), len(source)
    ratio = ((float(y) + 1) * float(s + m) / ((float(x) + 1) * float(t + m)) for x, y in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Scaled Gumbel noise that an id always gets; the null id counts as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(longest: int, buckets: int, gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in kernel.slices(batch):
                bucket, owner, words = _features(buf, offs, longest, buckets)
                number = np.bincount(owner, minlength=len(rows))
                weight = np.zeros(len(rows), np.int64)
                np.add.at(weight, owner, gain[bucket])
                score = weight + np.array([noise(seed, d) for d in rows.column("doc_id").to_pylist()], np.int64)
                yield pa.record_batch(
                    [rows.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, number, weight, score))],
                    names=["doc_id", "n_words", "n_features", "weight", "score"],
                )

    return run


def score_documents(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight (sum of gains) and score (with noise) of every row of docs (doc_id, text); target: text."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    return map_batches(with_bytes(docs, "doc_id"), _score(longest, buckets, gain, seed), schema)


# --- ranks by regular sampling ------------------------------------------------------------------------------------------------

# Keys: (-score, doc_id is null, doc_id, row); a smaller key is drawn first, and no two rows share one.
_KEY = ["minus", "lacks", "id", "row"]
_KEY_SCHEMA = "minus long, lacks long, id long, row long"


def _keys(rows: DataFrame) -> DataFrame:
    lacks = F.col("doc_id").isNull().cast("long")
    return rows.withColumns({"minus": -F.col("score"), "lacks": lacks, "id": F.coalesce("doc_id", F.lit(0))})


def _sorted(columns: list[np.ndarray]) -> np.ndarray:
    return np.lexsort(columns[::-1])


def _regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys at regular distances of every run of RUN_ROWS rows or what is left of a task, once sorted."""

    def sample(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        columns = [table.column(k).to_numpy() for k in _KEY]
        order = _sorted(columns)
        step = max(1, RUN_ROWS // RUN_SAMPLES)
        picked = order[step // 2 :: step] if len(order) > step // 2 else order[len(order) // 2 : len(order) // 2 + 1]
        return pa.record_batch([pa.array(c[picked]) for c in columns], names=_KEY)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= RUN_ROWS:
            yield sample(held)
            held, size = [], 0
    if size:
        yield sample(held)


def _segment(splitters: list[tuple]):
    """The segment of each row: how many splitters lie at or before its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in _KEY))
            at = pa.array([bisect_right(splitters, key) for key in rows], pa.int32())
            yield pa.record_batch([*batch.columns, at], names=[*batch.schema.names, "segment"])

    return run


def highest(rows: DataFrame, count: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The rows (doc_id, score, row: a number of its own for each) with column rank: 1 to count from the highest score, else null.

    Equal scores go by smaller doc_id, null last, then by row.
    """
    keyed = _keys(rows)
    samples = sorted(tuple(r) for r in map_batches(keyed.select(*_KEY), _regular, _KEY_SCHEMA, 50_000).collect())
    total = rows.count()
    segments = max(1, -(-total // segment_rows))
    splitters = [samples[len(samples) * i // segments] for i in range(1, segments)] if samples else []
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema)
    dealt = stored(map_batches(keyed, _segment(splitters), f"{schema}, segment int", 50_000), "resampling-segments")
    sizes = {r.segment: r["count"] for r in dealt.groupBy("segment").count().collect()}
    before, taken = {}, 0
    for s in sorted(sizes):  # prefix counts from the top
        if taken < count:
            before[s] = taken
        taken += sizes[s]
    own = F.row_number().over(Window.partitionBy("segment").orderBy(*_KEY)).cast("long")
    none = F.lit(None).cast("long")
    if not before:
        return dealt.select(*rows.columns, none.alias("rank"))
    # Drawn segments come first; each has the rank before its first row.
    last = max(before)
    starts = F.element_at(F.array(*[F.lit(before.get(s, 0)).cast("long") for s in range(last + 1)]), F.col("segment") + 1)
    ranked = dealt.where(f"segment <= {last}").withColumn("rank", own + starts)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= count, F.col("rank")))
    return ranked.select(*rows.columns, "rank").unionByName(dealt.where(f"segment > {last}").select(*rows.columns, none.alias("rank")))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Scores of every document and the rank of those drawn: doc_id, n_words, n_features, weight, score, rank; one row per input row.

    docs: doc_id long, text; target: text; other columns are left out. Of the documents with least_words words or more, percent of them
    (rounded down) with the highest scores are drawn. Null and empty texts have no features and weight 0. Equal scores go by smaller
    doc_id; rows without doc_id share the noise of an empty id and come last among equals; equal rows with equal ids go in any order. An
    empty target leaves only the smoothing; an empty table gives an empty result.
    """
    scored = score_documents(docs.select("doc_id", "text"), target.select("text"), longest, buckets, seed)
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    able = scored.where(f"n_words >= {least_words}")
    ranked = highest(able, able.count() * percent // 100)
    rest = scored.where(f"n_words < {least_words}").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("row")
