"""Best-fit packing of documents into sequences by patterns.

The lengths of all pieces form a histogram of at most `capacity` entries. Patterns of a few lengths that fill a sequence exactly are
enumerated, and non-negative least squares fits say how often to use each so that the histogram is met. The counts are rounded,
and what remains is packed by best fit on the histogram. The plan is as large as the set of patterns, whatever the number of
documents; pieces find their sequence through their rank among those of the same length.
"""

from __future__ import annotations

import base64
import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from statweave.llm.frames import map_batches, stored

CAPACITY = 2048
COMPARED = 50
"""Texts of each worker on which both readers of the vocabulary are compared."""
FIT_PATTERNS = 16_384
"""Patterns that one fit chooses from: few more than lengths, so that counts are large enough to be rounded."""


class _Encoder:
    """A byte-level BPE tokenizer, with a faster reader of the same vocabulary where one is given.

    Both cut a text into words by one pattern and merge inside each word, so their ids are the same. The faster one takes texts of Latin
    letters and plain signs only, as classes of other characters may differ between libraries, and none that spell an added token, which
    is one id of its own; it is held against the tokenizer on the first texts of every worker.
    """

    # Fixed value: the pattern by which the public byte-level vocabularies cut text into words.
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, ranks: str | None):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = regex.compile(r"[\t\n\r -~\u00a1-\u017f]*")
        self.fast, self.compared = None, 0
        if ranks:
            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("pieces", pat_str=self.CUT, mergeable_ranks=known, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or self.plain.fullmatch(text) is None or any(token in text for token in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        out = self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        if self.compared < COMPARED:
            self.compared += 1
            if out.tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError("The ranks are not those of the tokenizer's vocabulary")
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str, ranks: str | None) -> _Encoder:
    return _Encoder(path, ranks)


def _pieces(path: str, ranks: str | None, capacity: int, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, ranks)
        for batch in batches:
            texts = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            out = [row for i, text in texts for row in cut_pieces(i, encoder.ids(text or ""))]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def cut_pieces(doc_id, tokens: np.ndarray) -> Iterator[tuple]:
        tokens = np.append(tokens, np.uint32(end))
        at, to, k = 0, (len(tokens) - 1) % capacity + 1, 0  # the first piece is the short one
        while at < len(tokens):
            yield doc_id, k, at, to - at, zlib.crc32(tokens[at:to].tobytes())
            at, to, k = to, to + capacity, k + 1

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, ranks: str | None = None) -> DataFrame:
    """Pieces of at most capacity tokens of every document: doc_id, piece, start, length, ids_crc32.

    tokenizer: path of a tokenizer file; ranks: path of the same byte-level vocabulary as ranks, if there is one.
    """
    rows = docs.select("doc_id", "text")
    return map_batches(rows, _pieces(tokenizer, ranks, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fit_counts(need: np.ndarray, patterns: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts of the patterns that meet the histogram in the least squares sense (projected gradient).

    need: pieces by length, entry 0 unused. patterns: rows of lengths, filled up with 0.
    """
    counts = np.zeros(len(patterns))
    use = patterns > 0
    # Each length's column is scaled by the number of patterns that use it, which keeps the steps stable.
    degree = np.maximum(1, np.bincount(patterns[use], minlength=len(need)))
    step = 1.0 / np.maximum(1, (degree[patterns] * use).max(axis=1))
    ahead, t = counts, 1.0
    for _ in range(rounds):
        have = np.zeros(len(need))
        for k in range(patterns.shape[1]):
            have += np.bincount(patterns[:, k], weights=ahead, minlength=len(need))
        gap = need - have
        gap[0] = 0
        new = np.maximum(0, ahead + step * gap[patterns].sum(axis=1) / patterns.shape[1])
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = np.maximum(0, new + (t - 1) / after * (new - counts))
        counts, t = new, after
    return counts


def exact_patterns(need: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one to three occurring lengths that fill a sequence exactly, longest first."""
    have = need > 0
    out = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    a = np.arange(1, capacity)
    two = a[(a >= capacity - a) & have[a] & have[capacity - a]]
    out.append(np.stack([two, capacity - two, 0 * two], 1))
    for first in range(-(-capacity // 3), capacity - 1):
        if not have[first]:
            continue
        rest = capacity - first
        b = np.arange(-(-rest // 2), min(first, rest - 1) + 1)
        b = b[have[b] & have[rest - b]]
        out.append(np.stack([np.full(len(b), first), b, rest - b], 1))
    return np.concatenate(out).astype(np.int64)


def plan_sequences(need: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use every piece of the histogram once."""
    left = need.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(pattern, times: int) -> None:
        for length in pattern:
            left[length] -= times
        plan.append((tuple(pattern), times))

    # Every pattern takes part in one fit. A fit over all at once spreads the pieces so thin that rounding leaves nothing; fits over
    # some, in a seeded order, each to what the ones before have left, have counts worth rounding.
    patterns = exact_patterns(need, capacity)
    order = np.random.default_rng(0).permutation(len(patterns))
    for block in range(0, len(order), FIT_PATTERNS):
        some = patterns[order[block : block + FIT_PATTERNS]]
        some = some[(left[some] > 0).all(1, where=some > 0)]
        if not len(some):
            continue
        counts = np.rint(fit_counts(left.astype(float), some)).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= 0:
                break
            pattern = [int(x) for x in some[k] if x]
            times = min([int(counts[k]), *(int(left[x]) // pattern.count(x) for x in pattern)])
            if times:
                use(pattern, times)

    # The rest, longest first: each goes where it fits best; many equal pieces and equal rooms are handled at once.
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            room = next((r for r in range(length, capacity) if rooms.get(r)), None)
            if room is None:
                each = capacity // length
                times, odd = divmod(int(left[length]), each)
                for n, t in ((each, times), (odd, 1 if odd else 0)):
                    if t:
                        rooms.setdefault(capacity - n * length, {})
                        key = (length,) * n
                        rooms[capacity - n * length][key] = rooms[capacity - n * length].get(key, 0) + t
                left[length] = 0
                continue
            held, times = rooms[room].popitem()
            n = min(room // length, int(left[length]))
            t = min(times, int(left[length]) // n)
            if times > t:
                rooms[room][held] = times - t
            key, now = held + (length,) * n, room - n * length
            rooms.setdefault(now, {})
            rooms[now][key] = rooms[now].get(key, 0) + t
            left[length] -= n * t
    plan += [(held, times) for own in rooms.values() for held, times in own.items()]
    return plan


def _runs(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: a run starts at a rank, and its pieces go to consecutive sequences at one offset."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for pattern, times in plan:
        at = 0
        for length in pattern:
            rows.append((length, used[length], sequence, at))
            used[length] += times
            at += length
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _placed(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        # Length and rank as one number; the last run that starts at or before it holds the piece.
        shift = np.int64(1) << np.int64(48)
        starts = table["length"] * shift + table["rank"]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, batch.column("length").to_numpy() * shift + rank, "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), each of 1 to capacity tokens.

    Only the histogram of lengths reaches the driver, and the plan, bounded by the patterns, goes back. Ranks among pieces of one
    length are counted by bins, so a length that many pieces share is spread over tasks. Repeated pieces get places of their own;
    ties among them are broken arbitrarily, as they are alike. No pieces give an empty result.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    need = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        need[row["length"]] = row["count"]
    runs = spark.sparkContext.broadcast(_runs(plan_sequences(need, capacity), capacity))
    bins = 16 + math.isqrt(int(need.sum())) // 8  # grows with the square root, and so do the rows of a bin
    binned = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(bins)))
    sums = binned.groupBy("length", "bin").agg(F.count("*").alias("n"))
    sums = sums.selectExpr("length", "bin", "sum(n) over (partition by length order by bin) - n as before")
    inner = binned.selectExpr("*", "row_number() over (partition by length, bin order by doc_id, piece, ids_crc32) - 1 as inner")
    ranked = inner.join(sums, ["length", "bin"]).withColumn("rank", F.col("inner") + F.col("before"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, ranks: str | None = None) -> DataFrame:
    """Packs documents (doc_id, text): one row per piece with its sequence and offset.

    Null and empty texts are one piece that holds only the end id; a very long text becomes many pieces, encoded as a whole. Rows without
    doc_id and repeated rows are packed like any other. An empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end, ranks), capacity)
