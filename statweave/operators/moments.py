"""Sums of products of all pairs of columns in one pass: blocks of rows give matrices, matrices merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_ROWS = 4096
FLAT = 1e-13
"""A column whose relative deviation stays below this is constant: what is left is rounding."""


class Moments:
    """Of every pair of columns, over the rows that hold both: count, mean and squared deviations of the first, co-deviation.

    Those of the second column stand in the transposed place.  Deviations are taken from the mean of each block before
    they are squared, and blocks merge by the difference of their means, so nothing large cancels.
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, square: np.ndarray, product: np.ndarray, odd: np.ndarray):
        self.n, self.mean, self.square, self.product, self.odd = n, mean, square, product, odd

    @classmethod
    def nothing(cls, columns: int) -> Moments:
        return cls(*(np.zeros((columns, columns)) for _ in range(5)))

    @classmethod
    def of(cls, values: np.ndarray, held: np.ndarray) -> Moments:
        """values and held (which of them are there): rows x columns."""
        odd = held & ~np.isfinite(values)  # infinite or not a number: its pairs have no coefficient
        mask, clean = held.astype(float), np.where(held & ~odd, values, 0.0)
        shift = clean.sum(0) / np.maximum(mask.sum(0), 1)
        x = (clean - shift) * (held & ~odd)
        n, total = mask.T @ mask, x.T @ mask
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.where(n > 0, total / n, 0.0)
        return cls(n, np.where(n > 0, shift[:, None] + off, 0.0), (x**2).T @ mask - total * off, x.T @ x - n * off * off.T, odd.T.astype(float) @ mask)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(n > 0, other.n / n, 0.0)
        between = self.n * share
        return Moments(
            n, self.mean + apart * share, self.square + other.square + apart**2 * between,
            self.product + other.product + apart * apart.T * between, self.odd + other.odd,
        )


_PARTS = ["n", "mean_a", "mean_b", "square_a", "square_b", "product", "odd"]


def _rows(m: Moments) -> Iterator[list[np.ndarray]]:
    """One row per column: its pairs with all later columns."""
    for a in range(len(m.n) - 1):
        later = slice(a + 1, None)
        yield [x[later] for x in (m.n[a], m.mean[a], m.mean[:, a], m.square[a], m.square[:, a], m.product[a], m.odd[a] + m.odd[:, a])]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch, bool]]:
    """Consecutive rows of one key: the key (one row), the rows, and whether they begin a new key."""
    current = None
    for batch in batches:
        if not len(batch):
            continue
        named = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * len(batch)
        at = 0
        while at < len(named):
            to = at + 1
            while to < len(named) and named[to] == named[at]:
                to += 1
            yield batch.select(keys).slice(at, 1), batch.slice(at, to - at), named[at] != current
            current, at = named[at], to


def _partial(groups: list[str], columns: list[str]):
    def emit(key: pa.RecordBatch, m: Moments) -> pa.RecordBatch:
        rows = list(_rows(m))
        repeated = [pa.array(c.to_pylist() * len(rows), c.type) for c in key.columns]
        arrays = [pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in range(len(_PARTS))]
        return pa.record_batch([*repeated, pa.array(range(len(rows)), pa.int32()), *arrays], names=[*groups, "a", *_PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m = None, None
        for own, rows, new in _runs(batches, groups):
            if new and m is not None:
                yield emit(key, m)
                m = None
            key, m = own, m or Moments.nothing(len(columns))
            for at in range(0, len(rows), BLOCK_ROWS):
                part = [rows.column(c).slice(at, BLOCK_ROWS) for c in columns]
                held = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part])
                m += Moments.of(np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in part]), held)
        if m is not None:
            yield emit(key, m)

    return run


def _merged(groups: list[str], columns: list[str], minimum: int):
    def emit(key: pa.RecordBatch, a: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        n, mean_a, mean_b, square_a, square_b, product, odd = parts
        varied = (square_a > n * (FLAT * mean_a) ** 2) & (square_b > n * (FLAT * mean_b) ** 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(odd > 0, np.nan, product / np.sqrt(square_a * square_b))
        defined = (n >= minimum) & (varied | (odd > 0))
        later = columns[a + 1 :]
        return pa.record_batch(
            [
                *(pa.array(c.to_pylist() * len(later), c.type) for c in key.columns), pa.array([columns[a]] * len(later)), pa.array(later),
                pa.array(n.astype(np.int64)), pa.array(r, mask=~defined),
            ],
            names=[*groups, "indicator_a", "indicator_b", "n", "coefficient"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for own, rows, new in _runs(batches, [*groups, "a"]):
            if new and held is not None:
                yield emit(key.select(groups), key.column("a")[0].as_py(), held)
                held = None
            key = own
            for i in range(len(rows)):
                parts = [rows.column(p)[i].values.to_numpy() for p in _PARTS]
                held = parts if held is None else _joined(held, parts)
        if held is not None:
            yield emit(key.select(groups), key.column("a")[0].as_py(), held)

    return run


def _joined(one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
    """The merge of ``Moments``, for one row of it."""
    n1, n2 = one[0], two[0]
    n = n1 + n2
    share = np.divide(n2, n, out=np.zeros_like(n), where=n > 0)
    a, b = two[1] - one[1], two[2] - one[2]
    between = n1 * share
    added = [0, 0, 0, a * a * between, b * b * between, a * b * between, 0]
    out = [x + y + z for x, y, z in zip(one, two, added)]
    return [n, one[1] + a * share, one[2] + b * share, *out[3:]]


def pair_correlations(frame: DataFrame, groups: list[str], columns: list[str], minimum: int) -> DataFrame:
    """Count and Pearson coefficient of every pair of columns, over the rows of a group that hold both.

    Each task adds up its own rows, a group at a time, and sends one row per group and column, whatever the number of
    rows; these merge by group and column.  Rows are sorted inside their task and never shuffled.
    """
    wide = frame.select(*groups, *columns)
    if groups:
        wide = wide.sortWithinPartitions(*groups)
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wide.schema if f.name in groups)
    parts = wide.mapInArrow(_partial(groups, columns), f"{keys}a int, " + ", ".join(f"{p} array<double>" for p in _PARTS))
    dealt = parts.repartition(*groups, "a").sortWithinPartitions(*groups, "a")
    return dealt.mapInArrow(_merged(groups, columns, minimum), f"{keys}indicator_a string, indicator_b string, n long, coefficient double")
