"""Counts and spans of what has been published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SERIES


def indicator_coverage(fact: DataFrame) -> DataFrame:
    """First and last period and number of observations of every series."""
    return fact.groupBy(*SERIES).agg(
        F.min("period").alias("start"), F.max("period").alias("end"), F.count("*").alias("observations")
    )


COVERED = ["dataset", "indicator", "geography", "frequency"]


def coverage_table(fact: DataFrame) -> DataFrame:
    """Coverage without the unit, as the mirror keeps it."""
    return fact.groupBy(*COVERED).agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count("*").alias("observations"),
    )


def changed_coverage(coverage: DataFrame, inserted: DataFrame, removed: DataFrame | None = None, remaining: DataFrame | None = None) -> DataFrame:
    """The coverage table after some keys came and others went, without reading the rest of the fact.

    Counts add up and insertions can only widen a span.  A removal may have taken the first
    or last period of a series: such a series is counted anew from ``remaining``, the facts
    after the change, of which only these series are read; all others follow from the
    changed rows alone.  Series without observations are left out.
    """
    signed = lambda df, sign: df.select(*COVERED, "first_period", "last_period", (F.col("observations") * sign).alias("n"), F.lit(sign < 0).alias("gone"))
    parts = signed(coverage, 1).unionByName(signed(coverage_table(inserted), 1))
    if removed is not None:
        parts = parts.unionByName(signed(coverage_table(removed), -1))
    stays = lambda c: F.when(~F.col("gone"), F.col(c))
    gone = lambda c: F.when(F.col("gone"), F.col(c))
    merged = parts.groupBy(*COVERED).agg(
        F.min(stays("first_period")).alias("first_period"), F.max(stays("last_period")).alias("last_period"), F.sum("n").alias("observations"),
        F.min(gone("first_period")).alias("_low"), F.max(gone("last_period")).alias("_high"),
    ).filter("observations > 0")
    columns = [*COVERED, "first_period", "last_period", "observations"]
    if removed is None:
        return merged.select(*columns)
    doubtful = F.coalesce((F.col("_low") <= F.col("first_period")) | (F.col("_high") >= F.col("last_period")), F.lit(False))
    recounted = coverage_table(remaining.join(merged.filter(doubtful).select(*COVERED), COVERED, "left_semi"))
    return merged.filter(~doubtful).select(*columns).unionByName(recounted.select(*columns))


def geography_counts(fact: DataFrame) -> DataFrame:
    return fact.groupBy("geography").agg(F.count("*").alias("observations"))


def workspace_summary(fact: DataFrame, national: str) -> DataFrame:
    """One row of totals.

    Each distinct count comes from the same pre-aggregated series table, so no
    per-column expansion of the fact is shuffled.
    """
    per_series = fact.groupBy("indicator", "dataset", "geography").agg(
        F.count("*").alias("n"), F.min("period").alias("lo"), F.max("period").alias("hi")
    )
    return per_series.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"),
        F.count_distinct("indicator").alias("indicators"),
        F.count_distinct("dataset").alias("datasets"),
        F.count_distinct("geography").alias("geographies"),
        F.min("lo").alias("start"),
        F.max("hi").alias("end"),
        F.coalesce(F.sum(F.when(F.col("geography") == F.lit(national), F.col("n"))), F.lit(0)).alias(
            "national_observations"
        ),
    )


def yearly_means(fact: DataFrame) -> DataFrame:
    return fact.groupBy("indicator", F.year("period").alias("year")).agg(F.avg("value").alias("mean_value"))


def dimensions(fact: DataFrame) -> dict[str, DataFrame]:
    """Distinct projections of the fact."""
    return {
        "dim_dataset": fact.select("dataset", "source_url", "dataset_version").distinct(),
        "dim_indicator": fact.select("indicator", "unit", "frequency").distinct(),
        "dim_geography": fact.select("geography").distinct(),
        "dim_date": fact.select("period").distinct().select(
            "period", F.year("period").alias("year"), F.month("period").alias("month")
        ),
    }


def source_summary(accepted: DataFrame) -> DataFrame:
    """Rows, indicators and geographies per dataset, counted from one series table."""
    per_series = accepted.groupBy("dataset", "indicator", "geography").agg(F.count("*").alias("n"))
    return per_series.groupBy("dataset").agg(
        F.sum("n").alias("observations"),
        F.count_distinct("indicator").alias("indicators"),
        F.count_distinct("geography").alias("geographies"),
    )


def covered_total(fact: DataFrame, indicator: str, start: str, end: str) -> DataFrame:
    """Sum over the geographies that published an indicator in a period range."""
    from ..functions.periods import range_predicate

    rows = fact.filter((F.col("indicator") == F.lit(indicator)) & range_predicate(F.col("period"), start, end))
    return rows.groupBy("dataset", "indicator", "unit", "period").agg(
        F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("covered_value"),
        F.count("*").alias("geographies"),
    )


def domain_counts(fact: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Indicators with observations, per domain."""
    present = fact.select("indicator").distinct()
    return (
        present.join(dictionary.select("indicator", "domain"), "indicator")
        .groupBy("domain")
        .agg(F.count_distinct("indicator").alias("indicators"))
    )


def missing_series(dictionary: DataFrame, fact: DataFrame) -> DataFrame:
    """Dictionary entries without a single observation."""
    return dictionary.join(fact.select("indicator").distinct(), "indicator", "left_anti")


def homogeneity(fact: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each selection is one clean monthly series; the first failed test gives the reason.

    A month becomes one row first, so its number needs no distinct count; whether an attribute has one value follows from
    its smallest and largest.  Distinct counts of four columns side by side would carry every row five times.
    """
    attributes = ["frequency", "unit", "dataset"]
    ends = lambda c, low, high: [F.min(low).alias(f"_low_{c}"), F.max(high).alias(f"_high_{c}")]
    per_month = fact.groupBy(*keys, F.trunc("period", "month").alias("month")).agg(
        F.count("*").alias("n"), *[e for c in attributes for e in ends(c, c, c)]
    )
    stats = per_month.groupBy(*keys).agg(
        F.sum("n").alias("observations"),
        F.count("month").alias("months"),
        *[e for c in attributes for e in ends(c, f"_low_{c}", f"_high_{c}")],
    )
    one = {c: F.coalesce(F.col(f"_low_{c}") == F.col(f"_high_{c}"), F.lit(False)) for c in attributes}
    reason = (
        F.when(~one["frequency"] | ~F.lower("_low_frequency").isin("monthly", "m"), "not_monthly")
        .when(~one["unit"] | ~one["dataset"], "mixed_source_or_unit")
        .when(F.col("months") != F.col("observations"), "duplicate_periods")
    )
    return stats.select(
        *keys,
        "observations",
        F.when(reason.isNull(), "ready").otherwise("blocked").alias("status"),
        reason.alias("reason"),
    )


def calendar_gaps(fact: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Observed against expected months between the first and last period of each series."""
    months = F.year("period") * 12 + F.month("period")
    return (
        fact.groupBy(*keys)
        .agg(
            F.count("*").alias("observed"),
            (F.max(months) - F.min(months) + 1).cast("long").alias("expected"),
        )
        .withColumn("complete", F.col("observed") == F.col("expected"))
    )


def calendar_words(fact: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """The months of every series as bits: ``word`` (64 months each) and ``bits``, at most 110 rows per series.

    Bits combine on the map side, so however often a month is published it costs no shuffle.
    """
    months = fact.select(*keys, (F.year("period") * 12 + F.month("period") - 1).alias("_m"))
    bit = F.expr("shiftleft(1L, _m % 64)")
    return months.groupBy(*keys, F.floor(F.col("_m") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"), F.min("_m").alias("low"), F.max("_m").alias("high"))


def missing_months(fact: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Months between a series' first and last period without an observation; read off its calendar words, without a join."""
    series = calendar_words(fact, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    absent = F.expr("filter(sequence(low, high), m -> coalesce(getbit(words[cast(floor(m / 64) as bigint)], m % 64), 0) = 0)")
    month = F.make_date(F.floor(F.col("m") / 12).cast("int"), (F.col("m") % 12 + 1).cast("int"), F.lit(1))
    return series.select(*keys, F.explode(absent).alias("m")).select(*keys, month.alias("period"))
