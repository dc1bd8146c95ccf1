"""Window calculations along each series.

All windows of one call share a single partition and order specification, so Spark
plans one exchange and one sort for them.  A series is bounded by the calendar (one
row per date), which keeps the largest window group small however large the fact is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.periods import month_cos, month_sin
from ..schema import SERIES


def along(keys: list[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("period")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def fractional_change(value: Column, w: WindowSpec) -> Column:
    """Change against the previous observed row; undefined after zero or nothing."""
    return finite(F.try_divide(value, F.lag(value).over(w)) - F.lit(1.0))


def percent_change(value: Column, w: WindowSpec) -> Column:
    return fractional_change(value, w) * F.lit(100.0)


def complete_mean(value: Column, w: WindowSpec, rows: int) -> Column:
    """Mean of the last ``rows`` observations, only where all of them exist."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def complete_deviation(value: Column, w: WindowSpec, rows: int) -> Column:
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) == rows, F.stddev_samp(value).over(frame))


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def rebased(value: Column, w: WindowSpec) -> Column:
    """Index with the first observed value at 100; undefined for a zero base."""
    base = F.first(value, ignorenulls=True).over(whole(w))
    return F.try_divide(value, base) * F.lit(100.0)


def rebased_nonzero(value: Column, w: WindowSpec) -> Column:
    """Index whose base is the first value other than zero."""
    base = F.first(F.when(value != 0, value), ignorenulls=True).over(whole(w))
    return value / base * F.lit(100.0)


def transform(df: DataFrame, how: str = "raw", window: int = 3, keys: list[str] = SERIES) -> DataFrame:
    """The series transforms of the selection query, replacing ``value``."""
    if how == "raw":
        return df
    w, value = along(keys), F.col("value")
    if how == "rolling_mean":
        if not 2 <= window <= 120:
            raise ValueError("window must lie between 2 and 120 rows")
        return df.withColumn("value", complete_mean(value, w, window))
    if how == "pct_change":
        return df.withColumn("value", percent_change(value, w))
    if how == "index":
        return df.withColumn("value", rebased(value, w))
    raise ValueError(f"Unknown transform {how!r}")


def dashboard_transforms(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Index on the first non-zero value, change and three-row mean side by side."""
    w, value = along(keys), F.col("value")
    return df.withColumns(
        {
            "index_value": rebased_nonzero(value, w),
            "change_value": percent_change(value, w),
            "rolling_value": complete_mean(value, w, 3),
        }
    )


def trends(df: DataFrame, window: int = 12, keys: list[str] = SERIES) -> DataFrame:
    """Change (percent), rolling mean and volatility (deviation of the fractional change)."""
    w = along(keys)
    changed = df.withColumn("_change", fractional_change(F.col("value"), w))
    return changed.withColumns(
        {
            "percentage_change": F.col("_change") * F.lit(100.0),
            "rolling_average": complete_mean(F.col("value"), w, window),
            "moving_volatility": complete_deviation(F.col("_change"), w, window),
        }
    ).drop("_change")


def lag_features(df: DataFrame, lags: int = 12, keys: list[str] = SERIES) -> DataFrame:
    """``lag_1..lag_k``, the mean of those lags and the seasonal encoding.

    Every feature ends before its target row; rows without all lags are left out.
    """
    w = along(keys)
    featured = df.withColumns(
        {
            **{f"lag_{i}": F.lag("value", i).over(w) for i in range(1, lags + 1)},
            "rolling_mean": F.avg("value").over(w.rowsBetween(-lags, -1)),
            "_row": F.row_number().over(w),
        }
    )
    return (
        featured.filter(F.col("_row") > lags)
        .drop("_row")
        .withColumns({"month_sin": month_sin(F.col("period")), "month_cos": month_cos(F.col("period"))})
    )


def positions(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """``row`` (1-based, chronological) and ``rows`` of each series."""
    w = along(keys)
    return df.withColumns({"row": F.row_number().over(w), "rows": F.count("*").over(whole(w))})


def chronological_split(df: DataFrame, fraction: float = 0.7, keys: list[str] = SERIES) -> DataFrame:
    """``part`` is ``train`` for the first floor(fraction*n) rows of each series, else ``later``."""
    cut = F.floor(F.lit(fraction) * F.col("rows"))
    return positions(df, keys).withColumn("part", F.when(F.col("row") <= cut, "train").otherwise("later"))


def holdout_split(df: DataFrame, holdout: int = 12, keys: list[str] = SERIES) -> DataFrame:
    """``part`` is ``test`` for the last ``holdout`` rows of each series, else ``train``."""
    return positions(df, keys).withColumn(
        "part", F.when(F.col("row") > F.col("rows") - holdout, "test").otherwise("train")
    )


def previous_observation(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Each observation with the latest strictly earlier one of its series."""
    w = along(keys)
    return df.withColumns(
        {"previous_period": F.lag("period").over(w), "previous_value": F.lag("value").over(w)}
    )


def latest(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Last observation of each series; an aggregation, no sort."""
    return df.groupBy(*keys).agg(
        F.max("period").alias("period"), F.max_by("value", "period").alias("value")
    )


def kpi(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Latest value with its change: points for percent units, else percent of the
    previous magnitude (zero after zero)."""
    value, prior = F.col("value"), F.col("previous_value")
    delta = F.when(
        prior.isNotNull(),
        F.when(F.col("unit").startswith("percent"), value - prior)
        .when(prior == 0, F.lit(0.0))
        .otherwise((value - prior) / F.abs(prior) * F.lit(100.0)),
    )
    last = (
        previous_observation(df, keys)
        .groupBy(*keys)
        .agg(F.max_by(F.struct("period", "value", "previous_period", "previous_value"), "period").alias("last"))
    )
    return last.select(*keys, "last.*").withColumns(
        {
            "delta": delta,
            "delta_kind": F.when(prior.isNull(), F.lit(None).cast("string"))
            .when(F.col("unit").startswith("percent"), "points")
            .otherwise("percent"),
        }
    )


def sparkline(df: DataFrame, points: int = 16, keys: list[str] = SERIES) -> DataFrame:
    """The last ``points`` observations scaled into a 110 x 35 box; flat lines sit at the bottom."""
    recent = (
        df.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("period"))))
        .filter(F.col("_back") <= points)
    )
    w = Window.partitionBy(*keys)
    low, high, n = F.min("value").over(w), F.max("value").over(w), F.count("*").over(w)
    spread = F.when(high - low != 0, high - low).otherwise(F.lit(1.0))
    return (
        recent.withColumns({"_low": low, "_spread": spread, "_n": n})
        .filter(F.col("_n") >= 2)
        .withColumns(
            {
                "x": (F.col("_n") - F.col("_back")) / (F.col("_n") - 1) * F.lit(110.0),
                "y": F.lit(30.0) - (F.col("value") - F.col("_low")) / F.col("_spread") * F.lit(25.0),
            }
        )
        .drop("_back", "_low", "_spread", "_n")
    )


def densify(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """All observations, and the calendar periods a series skipped as rows with a null value.

    Only series whose periods all are first days of a month have a calendar: months when
    any period falls outside January, else years.  Only for display: no value is ever invented.
    """
    span = df.groupBy(*keys).agg(
        F.min("period").alias("_lo"),
        F.max("period").alias("_hi"),
        F.max((F.month("period") != 1)).alias("_monthly"),
        F.max((F.dayofmonth("period") != 1)).alias("_daily"),
    )
    step = F.when(F.col("_monthly"), F.expr("sequence(_lo, _hi, interval 1 month)")).otherwise(
        F.expr("sequence(_lo, _hi, interval 1 year)")
    )
    calendar = span.filter("not _daily").select(*keys, F.explode(step).alias("period"))
    skipped = calendar.join(df.select(*keys, "period"), [*keys, "period"], "left_anti")
    value = dict(df.dtypes)["value"]
    return df.select(*keys, "period", "value").unionByName(skipped.withColumn("value", F.lit(None).cast(value)))
