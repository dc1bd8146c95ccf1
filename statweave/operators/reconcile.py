"""Checks that published parts and totals agree, and geography matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def exact_sum(c: Column) -> Column:
    """Order-independent sum of published figures."""
    return F.sum(c.cast("decimal(28,4)"))


def hierarchy_violations(
    children: DataFrame, parents: DataFrame, link: DataFrame, on: list[str]
) -> DataFrame:
    """Parents whose children do not add up to exactly one published figure.

    ``link`` maps ``geography`` (child) to ``parent``; ``on`` lists the further
    columns that must agree.  Children are summed per parent before the join, so a
    parent with very many children costs one row per task in the shuffle.
    """
    summed = (
        children.join(link.select("geography", "parent"), "geography")
        .groupBy("parent", *on)
        .agg(exact_sum(F.col("value")).alias("child_total"), F.count("*").alias("children"))
    )
    published = parents.groupBy(F.col("geography").alias("parent"), *on).agg(
        F.count("*").alias("published_rows"), F.max(F.col("value").cast("decimal(28,4)")).alias("published_total")
    )
    joined = summed.join(published, ["parent", *on], "full_outer")
    agree = (
        (F.coalesce("published_rows", F.lit(0)) == 1) & F.col("child_total").eqNullSafe(F.col("published_total"))
    )
    return joined.withColumn("reconciled", agree)


def parts_violations(df: DataFrame, parts: list[str], total: str, shares: list[str] = ()) -> DataFrame:
    """Rows whose parts miss the total, or whose percentages leave 0..100."""
    tests = [~F.col(total).eqNullSafe(reduce(lambda a, b: a + b, [F.col(p) for p in parts]))]
    tests += [F.col(s).isNotNull() & ~F.col(s).between(0, 100) for s in shares]
    reasons = [F.when(tests[0], F.lit("parts_differ_from_total"))] + [
        F.when(t, F.lit(f"{s}_out_of_range")) for s, t in zip(shares, tests[1:])
    ]
    return df.withColumn("violations", F.array_join(F.array_compact(F.array(*reasons)), ",")).filter(
        F.col("violations") != ""
    )


def to_long(df: DataFrame, ids: list[str], fields: dict[str, tuple[str, str]], period: Column) -> DataFrame:
    """Wide rows to one row per present measure; ``fields`` maps column -> (indicator, unit)."""
    entries = [
        F.when(
            F.col(c).isNotNull(),
            F.struct(
                F.lit(indicator).alias("indicator"), F.lit(unit).alias("unit"),
                F.col(c).cast("double").alias("value"),
            ),
        )
        for c, (indicator, unit) in fields.items()
    ]
    return df.select(
        *ids, period.alias("period"), F.explode(F.array_compact(F.array(*entries))).alias("_m")
    ).select(*ids, "period", "_m.*")


def census_long(
    df: DataFrame, ids: list[str], fields: dict[str, tuple[str, str]], period: Column,
    prior: str, prior_field: tuple[str, str], prior_period: Column,
) -> DataFrame:
    """Current measures plus the comparison column, which belongs to an earlier period."""
    return to_long(df, ids, fields, period).unionByName(to_long(df, ids, {prior: prior_field}, prior_period))


def match_geographies(left: DataFrame, right: DataFrame) -> DataFrame:
    """Exact-name match of two geography lists: ``both``, ``left_only`` or ``right_only``."""
    a = left.select("geography").distinct().withColumn("_l", F.lit(True))
    b = right.select("geography").distinct().withColumn("_r", F.lit(True))
    return a.join(b, "geography", "full_outer").select(
        "geography",
        F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only").alias("match"),
    )


def common_periods(fact: DataFrame, indicators: list[str], keys: list[str]) -> DataFrame:
    """Periods at which all the indicators exist."""
    rows = fact.filter(F.col("indicator").isin(indicators))
    per_period = rows.groupBy(*keys, "period", "indicator").agg(F.count("*").alias("n"))
    return (
        per_period.groupBy(*keys, "period")
        .agg(F.count("*").alias("present"))
        .filter(F.col("present") == len(indicators))
        .drop("present")
    )


def breakdown(fact: DataFrame, indicators: dict[str, str], keys: list[str], rest: str = "Other") -> DataFrame:
    """Shares at the latest common period, with the unpublished rest as its own part.

    The rest appears only when the shares leave a gap (sum above 0 and below 99.5).
    """
    rows = fact.filter(F.col("indicator").isin(list(indicators)))
    last = common_periods(fact, list(indicators), keys).groupBy(*keys).agg(F.max("period").alias("period"))
    names = F.coalesce(*[F.when(F.col("indicator") == i, F.lit(n)) for i, n in indicators.items()])
    parts = rows.join(last, [*keys, "period"]).select(*keys, "period", names.alias("part"), "value")
    gap = (
        parts.groupBy(*keys, "period")
        .agg(F.sum("value").alias("_sum"))
        .filter((F.col("_sum") > 0) & (F.col("_sum") < 99.5))
        .select(*keys, "period", F.lit(rest).alias("part"), (F.lit(100.0) - F.col("_sum")).alias("value"))
    )
    return parts.unionByName(gap)


def national_share(fact: DataFrame, national: str, keys: list[str]) -> DataFrame:
    """Latest value of each geography as a percentage of the national latest, if of the same period."""
    last = fact.groupBy(*keys, "geography").agg(
        F.max("period").alias("period"), F.max_by("value", "period").alias("value")
    )
    total = last.filter(F.col("geography") == F.lit(national)).select(
        *keys, "period", F.col("value").alias("national_value")
    )
    return (
        last.filter(F.col("geography") != F.lit(national))
        .join(total, [*keys, "period"])
        .withColumn("share", F.try_divide("value", "national_value") * 100.0)
    )


def comparable_indicators(dictionary: DataFrame, indicator: str) -> DataFrame:
    """Other indicators of the same domain, unit and frequency."""
    kind = ["domain", "unit", "frequency"]
    chosen = dictionary.filter(F.col("indicator") == F.lit(indicator)).select(*kind)
    return dictionary.filter(F.col("indicator") != F.lit(indicator)).join(chosen, kind, "left_semi")


def series_table(fact: DataFrame, index: list[str], series: Column, names: list[str]) -> DataFrame:
    """Periods x series for a chart; the union of all periods, gaps stay null."""
    return (
        fact.withColumn("_series", series)
        .filter(F.col("_series").isin(names))
        .groupBy(*index)
        .pivot("_series", names)
        .agg(F.first("value", ignorenulls=True))
    )
