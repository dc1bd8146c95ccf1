"""Matched-period comparison, correlation and inference."""

from __future__ import annotations

import json
from collections import defaultdict
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import range_predicate
from ..functions.distributions import correlation_p, t_half_width, t_two_sided_p
from .ranking import average_rank
from .series import finite, fractional_change, along
from ..session import materialized
from .moments import pair_correlations
from .validate import ContractError

MAX_PATTERNS = 4096  # patterns of present columns that are told apart
MAX_ENTRIES = 50_000  # columns and sets of all patterns together, which stand in the plan
RANKED_ROWS = 100_000  # copies of rows that a task ranks, if no group has more


def matched_pairs(fact: DataFrame, indicator_a: str, indicator_b: str, geography: str | None = None) -> DataFrame:
    """Observations of two indicators at the same geography, frequency and period."""

    def side(indicator: str, suffix: str) -> DataFrame:
        rows = fact.filter(F.col("indicator") == F.lit(indicator))
        if geography is not None:
            rows = rows.filter(F.col("geography") == F.lit(geography))
        return rows.select(
            "geography", "frequency", "period",
            F.col("dataset").alias(f"dataset_{suffix}"),
            F.col("unit").alias(f"unit_{suffix}"),
            F.col("value").alias(f"value_{suffix}"),
        )

    return side(indicator_a, "a").join(side(indicator_b, "b"), ["geography", "frequency", "period"]).dropna(
        subset=["value_a", "value_b"]
    )


def side_profile(fact: DataFrame, indicator: str, geography: str) -> DataFrame:
    rows = fact.filter((F.col("indicator") == F.lit(indicator)) & (F.col("geography") == F.lit(geography)))
    return rows.select("dataset", "frequency", "unit").distinct()


def compare(fact: DataFrame, indicator_a: str, indicator_b: str, geography: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Matched values of two series in a period range; each side must be one source, frequency and unit."""
    fact = fact.filter(range_predicate(F.col("period"), start, end))
    sides = []
    for indicator in (indicator_a, indicator_b):
        found = side_profile(fact, indicator, geography).limit(2).collect()
        if len(found) > 1:
            raise ContractError(f"{indicator} has several sources, frequencies or units there; choose one.")
        sides.append(found)
    if all(sides) and sides[0][0].frequency != sides[1][0].frequency:
        raise ContractError("The two indicators are published at different frequencies.")
    return matched_pairs(fact, indicator_a, indicator_b, geography).select("period", "value_a", "value_b")


def comparison(fact: DataFrame, indicator_a: str, indicator_b: str, geography: str, start: str | None = None, end: str | None = None) -> dict:
    """A comparison with its status and both correlations (one row; null below three pairs or with a constant side)."""
    rows = compare(fact, indicator_a, indicator_b, geography, start, end)
    return {"status": "unavailable" if rows.isEmpty() else "available", "rows": rows, "correlation": with_p_values(correlations(rows, [], 3))}


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows that hold both values; null for a constant side.

    The built-in aggregate raises a division error on constant input in ANSI mode.
    """
    deviations = F.stddev_pop(_both(x, y, x)) * F.stddev_pop(_both(x, y, y))
    return F.try_divide(F.covar_pop(x, y), deviations)


def correlations(pairs: DataFrame, groups: list[str], minimum: int = 3) -> DataFrame:
    """Pearson and Spearman of ``value_a`` and ``value_b`` per group.

    Undefined below ``minimum`` matched rows or when a side is constant.  Ranks are
    taken inside a group, i.e. over matched periods of one pair, which the calendar
    bounds.
    """
    ranked = pairs.withColumns(
        {
            "_rank_a": average_rank(F.col("value_a"), groups),
            "_rank_b": average_rank(F.col("value_b"), groups),
        }
    )
    varied = (F.min("value_a") < F.max("value_a")) & (F.min("value_b") < F.max("value_b"))
    defined = (F.count("*") >= minimum) & varied
    return ranked.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.when(defined, pearson(F.col("value_a"), F.col("value_b"))).alias("pearson"),
        F.when(defined, pearson(F.col("_rank_a"), F.col("_rank_b"))).alias("spearman"),
    )


def with_p_values(result: DataFrame) -> DataFrame:
    """Two-sided p-values of both coefficients, on the aggregated rows only."""
    return result.withColumns(
        {
            "pearson_p": correlation_p(F.col("pearson"), F.col("n")),
            "spearman_p": correlation_p(F.col("spearman"), F.col("n")),
        }
    )


def wide(fact: DataFrame, index: list[str], columns: list[str], name: str = "indicator") -> DataFrame:
    """One column per named indicator; the list is explicit, so no pass is spent finding it.

    One aggregate over the index: a task holds and sends a row per index, not one per index and indicator.
    """
    cells = [F.first(F.when(F.col(name) == F.lit(c), F.col("value")), ignorenulls=True).alias(c) for c in columns]
    return fact.groupBy(*index).agg(*cells)


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def pearson_matrix(frame: DataFrame, groups: list[str], columns: list[str], minimum: int = 12) -> DataFrame:
    """Pairwise-complete Pearson of the columns of a wide frame: all pairs from one pass, as sums of products merge."""
    return pair_correlations(frame.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns]), groups, columns, minimum)


def _shared_rows(patterns: list[str], pairs: list[tuple[int, int]]) -> tuple[dict, dict]:
    """Which rows the pairs of columns share, told by the patterns of present columns: pairs by set, and per pattern (column, set).

    Ranks of a column depend only on the rows they are taken over, so pairs with the same rows share them.
    """
    sets: dict[tuple, int] = {}
    pairs_of, entries = defaultdict(list), {p: set() for p in patterns}
    for i, j in pairs:
        rows = tuple(n for n, p in enumerate(patterns) if p[i] == p[j] == "1")
        if not rows:
            continue
        s = sets.setdefault(rows, len(sets))
        pairs_of[s].append((i, j))
        for n in rows:
            entries[patterns[n]] |= {(i, s), (j, s)}
    return pairs_of, {p: sorted(e) for p, e in entries.items() if e}


def spearman_matrix(frame: DataFrame, groups: list[str], columns: list[str], minimum: int = 12) -> DataFrame:
    """Pairwise-complete Spearman of the columns of a wide frame.

    A row is copied once for each of its columns and each distinct set of rows that a pair of that column is complete on:
    once per column where nothing is missing, not once per pair.  A frame with more patterns of present columns than
    MAX_PATTERNS, or more copies to tell apart than MAX_ENTRIES, takes every pair for a set of its own.

    Patterns and sets are few and most rows share one, so they are looked up in constants of the plan: a join by pattern would
    bring nearly all rows to one task.  Whole groups are dealt to as many tasks as the copies need and stay there to the end.
    """
    pairs = list(combinations(range(len(columns)), 2))
    mask = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    values = F.array(*[F.col(c).cast("double") for c in columns])
    rows = materialized(frame.select(*groups, values.alias("_v"), mask.alias("_mask"), F.monotonically_increasing_id().alias("_row")), "matrix")
    found = rows.groupBy("_mask").count().limit(MAX_PATTERNS + 1).collect()
    constant = lambda value, schema: F.from_json(F.lit(json.dumps(value)), schema)
    pairs_of, entries = _shared_rows(sorted(r[0] for r in found), pairs) if len(found) <= MAX_PATTERNS else ({}, {})
    together = len(found) <= MAX_PATTERNS and sum(map(len, entries.values())) <= MAX_ENTRIES
    if groups:
        copies = sum(r[1] * len(entries.get(r[0], ())) for r in found) if together else rows.count() * 2 * len(pairs)
        rows = rows.repartition(max(1, -(-copies // RANKED_ROWS)), *groups)
    if together:
        plan = constant({p: [{"a": a, "s": s} for a, s in e] for p, e in entries.items()}, "map<string,array<struct<a:int,s:int>>>")
        copied = rows.withColumn("e", F.try_element_at(plan, F.col("_mask")))
    else:
        pairs_of = {s: [pair] for s, pair in enumerate(pairs)}
        own = [F.array(*[F.struct(F.lit(c).alias("a"), F.lit(s).alias("s")) for c in pair]) for s, (pair,) in pairs_of.items()]
        both = [F.when((F.substring("_mask", i + 1, 1) == "1") & (F.substring("_mask", j + 1, 1) == "1"), e) for e, (i, j) in zip(own, pairs)]
        copied = rows.withColumn("e", F.flatten(F.array_compact(F.array(*both))))
    long = copied.select(*groups, "_row", F.explode("e").alias("e"), "_v").select(*groups, "_row", "e.*", F.get("_v", F.col("e.a")).alias("_x"))
    ranked = long.withColumn("_rank", average_rank(F.col("_x"), [*groups, "a", "s"]))
    matched = ranked.groupBy(*groups, "s", "_row").agg(F.map_from_entries(F.collect_list(F.struct("a", "_rank"))).alias("_ranks"))
    members = constant([[{"i": i, "j": j} for i, j in pairs_of[s]] for s in range(len(pairs_of))], "array<array<struct<i:int,j:int>>>")
    paired = matched.select(*groups, "_ranks", F.explode(F.get(members, F.col("s"))).alias("p")).select(
        *groups, "p.*", F.element_at("_ranks", F.col("p.i")).alias("x"), F.element_at("_ranks", F.col("p.j")).alias("y")
    )
    x, y = F.col("x"), F.col("y")
    defined = (F.count("*") >= minimum) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    result = paired.groupBy(*groups, "i", "j").agg(F.count("*").alias("n"), F.when(defined, pearson(x, y)).alias("coefficient"))
    name = lambda i: F.get(F.array(*[F.lit(c) for c in columns]), F.col(i))
    return result.select(*groups, name("i").alias("indicator_a"), name("j").alias("indicator_b"), "n", "coefficient")


def changes(frame: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Fractional change of each column against the row before, in period order."""
    w = along(groups)
    return frame.withColumns({c: fractional_change(finite(F.col(c)), w) for c in columns})


def mean_interval(
    df: DataFrame, groups: list[str], value: str = "value", confidence: float = 0.95, independent: bool = False
) -> DataFrame:
    """Student-t interval of each group's mean, for samples declared independent."""
    v = finite(F.col(value))
    stats = df.groupBy(*groups).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"),
        F.min(v).alias("_low"),
        F.max(v).alias("_high"),
    )
    reason = (
        F.when(F.lit(not independent), "independence_not_declared").when(F.col("n") < 3, "too_few_observations")
    )
    ready = reason.isNull()
    constant = F.col("_low") == F.col("_high")
    half = F.when(constant, F.lit(0.0)).otherwise(
        F.col("sem") * t_half_width(F.lit(confidence), (F.col("n") - 1).cast("double"))
    )
    return stats.select(
        *groups,
        F.when(ready, "calculated").otherwise("blocked").alias("status"),
        reason.alias("reason"),
        "n",
        F.when(ready, F.col("mean")).alias("mean"),
        F.when(ready, F.col("sem")).alias("sem"),
        F.when(ready, F.col("mean") - half).alias("lower"),
        F.when(ready, F.col("mean") + half).alias("upper"),
    )


def difference_test(
    df: DataFrame, groups: list[str], side: Column, value: str = "value", independent: bool = False
) -> DataFrame:
    """Welch's test between rows where ``side`` is true and false, per group."""
    v = finite(F.col(value))
    a, b = F.when(side, v), F.when(~side, v)
    stats = df.groupBy(*groups).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"),
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        (F.var_samp(a) / F.count(a)).alias("_va"), (F.var_samp(b) / F.count(b)).alias("_vb"),
    )
    reason = F.when(F.lit(not independent), "independence_not_declared").when(
        F.least("n_a", "n_b") < 3, "too_few_observations"
    )
    ready = reason.isNull()
    spread = F.col("_va") + F.col("_vb")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(spread))
    dof = F.try_divide(
        spread * spread,
        F.col("_va") * F.col("_va") / (F.col("n_a") - 1) + F.col("_vb") * F.col("_vb") / (F.col("n_b") - 1),
    )
    return (
        stats.select(
            *groups,
            F.when(ready, "calculated").otherwise("blocked").alias("status"),
            reason.alias("reason"),
            "n_a",
            "n_b",
            F.when(ready, t).alias("statistic"),
            F.when(ready, dof).alias("degrees_of_freedom"),
        )
    )


def with_test_p(result: DataFrame) -> DataFrame:
    return result.withColumn("p_value", t_two_sided_p(F.col("statistic"), F.col("degrees_of_freedom")))


def forecast_errors(df: DataFrame, groups: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE and MAPE; rows with an actual of (nearly) zero do not enter the MAPE."""
    a, p = F.col(actual), F.col(predicted)
    error = F.abs(a - p)
    eligible = F.abs(a) > 1e-10
    return df.groupBy(*groups).agg(
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.when(eligible, F.abs((a - p) / a))) * 100.0).alias("mape_percent"),
        F.count_if(eligible).alias("mape_eligible_rows"),
    )
