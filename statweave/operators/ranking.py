"""Exact positions in groups of any size.

A window would send a whole group to one task.  Here the rows are range-partitioned
on group and order together, so a large group, or a long run of equal values, spans
several ranges; each range is numbered on its own and the exact counts of the lower
ranges of its group are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

RANGE_ROWS = 500_000


def positions_by(df: DataFrame, groups: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """1-based ``position`` of each row inside its group.

    Range borders come from a sample that a second evaluation could draw differently,
    so the partitioned rows are written once and numbered from there.  The rows are
    stored before: they are sampled and counted without being computed again, and their
    number says how many ranges of RANGE_ROWS there are.
    """
    df = materialized(df, "ranked")
    n = ranges or max(1, -(-df.count() // RANGE_ROWS))
    keys = [*[F.col(g) for g in groups], *order]
    # Ordered inside its range, a row's number there needs no further shuffle: the id counts rows of a partition.
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialized(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    below = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A row per group and range: how many rows come before it, and where its numbers begin.
    shifts = (
        ranged.groupBy(*groups, "_range")
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        .select(
            *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_range").alias("_r"),
            (F.coalesce(F.sum("_n").over(below), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        )
    )
    same = F.col("_range") == F.col("_r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = ranged.join(shifts, same).withColumn("position", F.col("_id") + F.col("_shift"))
    return joined.drop("_id", "_range", "_r", "_shift", *[f"_g_{g}" for g in groups])


def ranking(df: DataFrame, groups: list[str], value: str = "value", ties: list[str] | None = None) -> DataFrame:
    """Descending ``position`` of every row inside its group; ``ties`` settle equal values."""
    return positions_by(df, groups, [F.desc(value), *[F.asc(t) for t in ties or []]])


def district_ranking(
    fact: DataFrame,
    indicator: str,
    period_prefix: str,
    dataset: str | None = None,
    name_part: str = "",
) -> DataFrame:
    """Geographies of one indicator and period, largest first, optionally narrowed."""
    from ..functions.periods import range_predicate

    rows = fact.filter(
        (F.col("indicator") == F.lit(indicator)) & range_predicate(F.col("period"), period_prefix, period_prefix)
    )
    if dataset is not None:
        rows = rows.filter(F.col("dataset") == F.lit(dataset))
    if name_part:
        rows = rows.filter(F.contains(F.lower("geography"), F.lit(name_part.lower())))
    return ranking(rows, ["indicator", "period"], "value", ["geography", "dataset"])


def average_rank(value: Column, groups: list[str]) -> Column:
    """Mean rank of ties, for groups bounded by the calendar (matched periods)."""
    w = Window.partitionBy(*groups).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*groups, value))
    return F.rank().over(w) + (ties - 1) / F.lit(2.0)
