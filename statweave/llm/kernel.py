"""Vectorised helpers over the bytes of a batch of texts.

A batch is one byte buffer with document offsets. All functions take whole batches, so Python work per document stays small.
Words are maximal runs of bytes other than space and the control characters 9 to 13. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
"""Texts are handled in slices of about this size, a longer text in a slice of its own."""

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits can be used."""
    x = np.asarray(values, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power(which: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse modulo 2**64, from exponent 0."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = int(_BASE) if which == "up" else pow(int(_BASE), -1, 1 << 64)
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        _powers[which] = have = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts hold about SLICE_BYTES, with their bytes and offsets."""
    buf, offs = flat(batch.column(column))
    n, at = len(batch), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE_BYTES, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def find_words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document the index of its first word (one more entry at the end).

    inside: marks, for all 256 byte values, which belong to words; by default all but white space.
    """
    held = ~_SPACE[buf] if inside is None else inside[buf]
    first = held.copy()
    first[1:] &= ~held[:-1]
    last = held.copy()
    last[:-1] &= ~held[1:]
    begins = offs[:-1][offs[:-1] < offs[1:]]
    first[begins] = held[begins]
    ends = offs[1:][offs[:-1] < offs[1:]] - 1
    last[ends] = held[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def rolling(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, from which the hash of any range follows."""
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[buf] * _power("up", len(buf)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal bytes give equal hashes wherever they stand."""
    raw = (sums[end] - sums[start]) * _power("down", len(sums))[start]
    return mix(raw ^ ((end - start).astype(np.uint64) * _STEP))


def unit_sums(units: np.ndarray) -> np.ndarray:
    """The same prefix sums over 64-bit units, such as word hashes."""
    out = np.empty(len(units) + 1, np.uint64)
    out[0] = 0
    np.cumsum(units * _power("up", len(units)), out=out[1:])
    return out


def gram_hash(units: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive units; entry i is that of units i to i+n-1."""
    count = len(units) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    sums = unit_sums(units)
    at = np.arange(count)
    return range_hash(sums, at, at + n)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the word index at which each document begins."""
    start, end, first = find_words(buf, offs)
    return range_hash(rolling(buf), start, end), first


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of this width."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
