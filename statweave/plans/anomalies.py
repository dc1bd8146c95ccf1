"""Novelty flags for every series: an isolation forest of its own.

One exchange brings a series together; the calendar bounds its rows.  All its trees
grow on their samples level by level at once, and then the rows outside the samples fall through them.  No
row is copied per tree between tasks, and rows outside the samples only fall.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.series import along, fractional_change, whole
from ..schema import SERIES

TREES, SAMPLE, CONTAMINATION = 100, 256, 0.05
TRAIN_FRACTION, MIN_TRAIN, MIN_LATER = 0.7, 24, 6
_EULER = 0.5772156649015329
_WALKERS = 2_000_000  # points times trees that fall at a time


def monitored(fact: DataFrame, fraction: float = TRAIN_FRACTION, keys: list[str] = SERIES) -> DataFrame:
    """(value, change) rows with ``train`` for the first part of each series and its ``status``."""
    w = along(keys)
    rows = fact.withColumn("change", fractional_change(F.col("value"), w)).filter(
        F.col("value").isNotNull() & F.col("change").isNotNull()
    )
    split = F.floor(F.lit(fraction) * F.col("_n"))
    enough = (split >= MIN_TRAIN) & (F.col("_n") - split >= MIN_LATER)
    return (
        rows.withColumns({"_row": F.row_number().over(w), "_n": F.count("*").over(whole(w))})
        .withColumns(
            {
                "train": F.col("_row") <= split,
                "train_rows": split.cast("int"),
                "status": F.when(enough, "trained").otherwise("blocked"),
            }
        )
        .drop("_n")
        .withColumnRenamed("_row", "row")
    )


def _average_depth(n: np.ndarray) -> np.ndarray:
    """Expected depth left in a node of n sampled rows."""
    m = np.maximum(n, 3).astype(float)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * (np.log(m - 1.0) + _EULER) - 2.0 * (m - 1.0) / m))


def grow(points: np.ndarray, trees: int, sample: int, rng: np.random.Generator) -> tuple[list[dict], np.ndarray]:
    """Levels of all trees over samples of the points; the nodes of a level are numbered across the trees.

    Also the summed depths of the points themselves where every tree sees all of them (else zeros): they are known once the trees are grown.
    """
    size = min(sample, len(points))
    drawn = [rng.permutation(len(points))[:size] for _ in range(trees)]
    if size == len(points):  # the order inside a sample changes nothing
        who = np.tile(np.arange(size), trees)
    else:
        who = np.concatenate(drawn)
    total = np.zeros(len(points))
    columns = [np.take(c, who) for c in points.T]
    count, levels = np.full(trees, size), []
    limit = math.ceil(math.log2(max(size, 2)))
    while len(count):
        # The sampled rows are ordered by node; a node can be empty where a cut falls on the largest value.
        width, held = len(count), np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[held]
        low, high = np.full((len(columns), width), np.inf), np.full((len(columns), width), -np.inf)
        for c, values in enumerate(columns):
            low[c, held], high[c, held] = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        varies = (high > low).T
        leaf = (count <= 1) | (len(levels) == limit) | ~varies.any(axis=1)
        # A random feature among those that vary, and a random cut within its range.
        feature = np.where(varies, rng.random(varies.shape), -1.0).argmax(axis=1)
        every = np.arange(width)
        with np.errstate(invalid="ignore"):
            cut = low[feature, every] + rng.random(width) * (high[feature, every] - low[feature, every])
        first_child = 2 * (np.cumsum(~leaf) - 1)
        levels.append({"leaf": leaf, "depth": len(levels) + _average_depth(count), "feature": feature, "cut": cut, "child": first_child})
        if size == len(points):
            out = np.repeat(leaf, count)
            total += np.bincount(who[out], weights=np.repeat(levels[-1]["depth"][leaf], count[leaf]), minlength=size)
            stay = np.flatnonzero(~out)
        else:
            stay = np.flatnonzero(np.repeat(~leaf, count))
        inner = np.flatnonzero(~leaf)
        width, of_inner = 2 * len(inner), count[inner]
        columns, who = [np.take(c, stay) for c in columns], np.take(who, stay)
        own = columns[0]
        for c in range(1, len(columns)):
            own = np.where(np.repeat(feature[inner] == c, of_inner), columns[c], own)
        node = np.repeat(first_child[inner], of_inner) + (own > np.repeat(cut[inner], of_inner))
        count = np.bincount(node, minlength=width)
        order = np.argsort(node.astype(np.uint16) if width < 65536 else node, kind="stable")
        columns, who = [np.take(c, order) for c in columns], np.take(who, order)
    return levels, total


def depths(points: np.ndarray, levels: list[dict], trees: int) -> np.ndarray:
    """Summed depths of each point over the trees."""
    total = np.zeros(len(points))
    step = max(1, _WALKERS // trees)
    for begin in range(0, len(points), step):
        columns = np.ascontiguousarray(points[begin : begin + step].T)
        rows = columns.shape[1]
        who, node = np.tile(np.arange(rows), trees), np.repeat(np.arange(trees), rows)
        for level in levels:
            ended = level["leaf"][node]
            total[begin : begin + step] += np.bincount(who[ended], weights=level["depth"][node[ended]], minlength=rows)
            stay = np.flatnonzero(~ended)
            if not len(stay):
                break
            who, node = np.take(who, stay), np.take(node, stay)
            node = np.take(level["child"], node) + (columns[np.take(level["feature"], node), who] > np.take(level["cut"], node))
    return total


def isolation_scores(points: np.ndarray, train: np.ndarray, trees: int, sample: int, rng: np.random.Generator) -> np.ndarray:
    """Isolation score of each point from a forest over the marked ones: higher is stranger."""
    known = int(train.sum())
    levels, total = grow(points[train], trees, sample, rng)
    if known <= sample:
        summed = np.empty(len(points))
        summed[train], summed[~train] = total, depths(points[~train], levels, trees)
    else:
        summed = depths(points, levels, trees)
    return 2.0 ** (-(summed / trees) / _average_depth(np.array([min(sample, known)]))[0])


def forest_scores(rows: DataFrame, keys: list[str] = SERIES, trees: int = TREES, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """The rows with the isolation ``score`` from their series' own forest (higher is stranger).

    ``sample``: training rows that a tree sees at most; sub-sampling is part of the method.  A series travels as one row with
    an ordered array, which the calendar bounds, so a task scores one after the other without a data frame for each.
    """
    rest = [c for c in rows.columns if c not in keys]
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", *[c for c in rest if c != "row"]))).alias("_rows"))
    numbers = gathered.select("*", *[F.col(f"_rows.{c}").alias(f"_{c}") for c in ("value", "change", "train")])

    def run(batches):
        for batch in batches:
            names = zip(*[batch.column(k).to_pylist() for k in keys])
            value, change, train = (batch.column(f"_{c}") for c in ("value", "change", "train"))
            begins = value.offsets.to_numpy()
            points = np.column_stack([c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (value, change)])
            known, scores = train.flatten().to_numpy(zero_copy_only=False).astype(bool), np.empty(len(points))
            begins = begins - begins[0]
            for name, a, b in zip(names, begins[:-1], begins[1:]):
                rng = np.random.default_rng([seed, zlib.crc32("\0".join(map(str, name)).encode())])
                scores[a:b] = isolation_scores(points[a:b], known[a:b], trees, sample, rng)
            made = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(scores))
            yield pa.record_batch([*[batch.column(c) for c in (*keys, "_rows")], made], names=[*keys, "_rows", "_scores"])

    schema = T.StructType([*gathered.schema.fields, T.StructField("_scores", T.ArrayType(T.DoubleType()))])
    scored = numbers.mapInArrow(run, schema).select(*keys, F.explode(F.arrays_zip("_rows", "_scores")).alias("r"))
    return scored.select(*[c if c in keys else F.col(f"r._rows.{c}").alias(c) for c in rows.columns], F.col("r._scores").alias("score"))


def anomalies(
    fact: DataFrame, keys: list[str] = SERIES, trees: int = TREES, seed: int = 42, sample: int = SAMPLE
) -> DataFrame:
    """Later observations with ``score`` (negative is anomalous) and ``anomaly``.

    The threshold is the 5th percentile of the training scores of the same series.
    Series too short to learn from appear once, as blocked.
    """
    rows = monitored(fact.select(*keys, "period", "value"), keys=keys)
    ready = rows.filter("status = 'trained'")
    scored = forest_scores(ready, keys, trees, seed, sample).withColumn("score", -F.col("score"))
    everything = Window.partitionBy(*keys)
    later = (
        scored.withColumns(
            {
                "_offset": F.percentile(F.when(F.col("train"), F.col("score")), F.lit(CONTAMINATION)).over(everything),
                "training_end": F.max(F.when(F.col("train"), F.col("period"))).over(everything),
            }
        )
        .filter(~F.col("train"))
        .withColumn("score", F.col("score") - F.col("_offset"))
    )
    too_short = rows.filter("status = 'blocked'").select(*keys).distinct()
    return later.select(
        *keys, F.lit("trained").alias("status"), "training_end", "period", "value", "score", (F.col("score") < 0).alias("anomaly")
    ).unionByName(
        too_short.withColumn("status", F.lit("blocked")), allowMissingColumns=True
    )
