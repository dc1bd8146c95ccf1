"""Calculations along series, rankings, breakdowns and calendars."""

from pyspark.sql import functions as F

from statweave.functions import periods as P
from statweave.operators import ranking, reconcile
from statweave.operators import series as W
from statweave.schema import KEY, SERIES

from .observations import DICTIONARY, OBS, WORLD, dictionary, obs
from .registry import query

_S = "dataset, indicator, geography, unit, frequency"
_ID = "dataset, indicator, geography, CAST(period AS VARCHAR) AS period, unit, frequency"
_W = f"PARTITION BY {_S} ORDER BY period"
_FRAC = "value / nullif(lag(value) OVER w, 0) - 1.0::DOUBLE"


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "percent_change",
    f"WITH {OBS} SELECT {_ID}, round(({_FRAC}) * 100.0::DOUBLE, 6) AS value FROM obs WINDOW w AS ({_W})",
)
def percent_change(spark, d):
    return _rounded(W.transform(obs(spark, d), "pct_change"), 6, "value").select(*KEY, "value")


@query(
    "rolling_mean",
    f"""WITH {OBS} SELECT {_ID}, round(CASE WHEN count(*) OVER f = 6 THEN avg(value) OVER f END, 4) AS value FROM obs
  WINDOW f AS ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
)
def rolling_mean(spark, d):
    return _rounded(W.transform(obs(spark, d), "rolling_mean", 6), 4, "value").select(*KEY, "value")


@query(
    "rebased_index",
    f"""WITH {OBS} SELECT {_ID}, round(value / nullif(first_value(value) OVER ({_W}), 0) * 100.0::DOUBLE, 6) AS value FROM obs""",
)
def rebased_index(spark, d):
    return _rounded(W.transform(obs(spark, d), "index"), 6, "value").select(*KEY, "value")


@query(
    "dashboard_transforms",
    f"""WITH {OBS}, b AS (SELECT {_S}, arg_min(value, period) FILTER (WHERE value <> 0) AS base FROM obs GROUP BY ALL)
  SELECT {_ID}, round(value / base * 100.0::DOUBLE, 6) AS index_value, round(({_FRAC}) * 100.0::DOUBLE, 6) AS change_value,
    round(CASE WHEN count(*) OVER f = 3 THEN avg(value) OVER f END, 4) AS rolling_value
  FROM obs JOIN b USING ({_S}) WINDOW w AS ({_W}), f AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def dashboard_transforms(spark, d):
    out = _rounded(W.dashboard_transforms(obs(spark, d)), 6, "index_value", "change_value")
    return _rounded(out, 4, "rolling_value").select(*KEY, "index_value", "change_value", "rolling_value")


_TREND = f"""WITH {OBS}, c AS (SELECT *, {_FRAC} AS ch FROM obs WINDOW w AS ({_W}))
  SELECT {_ID}, round(ch * 100.0::DOUBLE, 6) AS percentage_change,
    round(CASE WHEN count(*) OVER f = 12 THEN avg(value) OVER f END, 4) AS rolling_average,
    round(CASE WHEN count(ch) OVER f = 12 THEN stddev_samp(ch) OVER f END, 6) AS moving_volatility
  FROM c WINDOW f AS ({_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""


@query("trend_table", _TREND)
def trend_table(spark, d):
    out = W.trends(obs(spark, d), 12).withColumn("rolling_average", F.round("rolling_average", 4))
    return _rounded(out, 6, "percentage_change", "moving_volatility").select(
        *KEY, "percentage_change", "rolling_average", "moving_volatility"
    )


@query(
    "moving_volatility",
    f"""WITH {OBS}, c AS (SELECT *, {_FRAC} AS ch FROM obs WINDOW w AS ({_W}))
  SELECT {_ID}, round(CASE WHEN count(ch) OVER f = 4 THEN stddev_samp(ch) OVER f END, 6) AS volatility
  FROM c WINDOW f AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def moving_volatility(spark, d):
    w = W.along()
    changed = obs(spark, d).withColumn("change", W.fractional_change(F.col("value"), w))
    return changed.select(*KEY, F.round(W.complete_deviation(F.col("change"), w, 4), 6).alias("volatility"))


_LAGS = ", ".join(f"lag(value, {i}) OVER w AS lag_{i}" for i in range(1, 13))


@query(
    "lag_features",
    f"""WITH {OBS}, x AS (SELECT *, {_LAGS}, avg(value) OVER ({_W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rolling_mean,
    row_number() OVER w AS rn FROM obs WHERE frequency = 'monthly' WINDOW w AS ({_W}))
  SELECT {_ID}, value, {", ".join(f"lag_{i}" for i in range(1, 13))}, round(rolling_mean, 4) AS rolling_mean,
    round(sin(2 * pi() * month(period) / 12.0), 8) AS month_sin, round(cos(2 * pi() * month(period) / 12.0), 8) AS month_cos
  FROM x WHERE rn > 12""",
)
def lag_features(spark, d):
    out = W.lag_features(obs(spark, d).filter("frequency = 'monthly'"), 12)
    out = out.withColumn("rolling_mean", F.round("rolling_mean", 4))
    return _rounded(out, 8, "month_sin", "month_cos").select(
        *KEY, "value", *[f"lag_{i}" for i in range(1, 13)], "rolling_mean", "month_sin", "month_cos"
    )


@query(
    "latest_values",
    f"""WITH {OBS} SELECT {_S}, CAST(max(period) AS VARCHAR) AS period, arg_max(value, period) AS value FROM obs GROUP BY {_S}""",
)
def latest_values(spark, d):
    return W.latest(obs(spark, d))


@query(
    "previous_observation",
    f"""WITH {OBS} SELECT {_ID}, value, CAST(lag(period) OVER w AS VARCHAR) AS previous_period, lag(value) OVER w AS previous_value
  FROM obs WINDOW w AS ({_W})""",
)
def previous_observation(spark, d):
    return W.previous_observation(obs(spark, d)).select(*KEY, "value", "previous_period", "previous_value")


@query(
    "kpi_delta",
    f"""WITH {OBS}, p AS (SELECT *, lag(period) OVER w AS pp, lag(value) OVER w AS pv, row_number() OVER (PARTITION BY {_S} ORDER BY period DESC) AS back
    FROM obs WINDOW w AS ({_W}))
  SELECT {_ID}, value, CAST(pp AS VARCHAR) AS previous_period, pv AS previous_value,
    round(CASE WHEN pv IS NULL THEN NULL WHEN unit LIKE 'percent%' THEN value - pv WHEN pv = 0 THEN 0
      ELSE (value - pv) / abs(pv) * 100.0::DOUBLE END, 6) AS delta,
    CASE WHEN pv IS NULL THEN NULL WHEN unit LIKE 'percent%' THEN 'points' ELSE 'percent' END AS delta_kind
  FROM p WHERE back = 1""",
)
def kpi_delta(spark, d):
    return _rounded(W.kpi(obs(spark, d)), 6, "delta")


@query(
    "sparkline_points",
    f"""WITH {OBS}, p AS (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY period DESC) AS back FROM obs QUALIFY back <= 16),
  q AS (SELECT *, min(value) OVER s AS lo, max(value) OVER s AS hi, count(*) OVER s AS n FROM p WINDOW s AS (PARTITION BY {_S}))
  SELECT {_ID}, value, round((n - back)::DOUBLE / (n - 1) * 110, 6) AS x,
    round(30 - (value - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) * 25, 6) AS y FROM q WHERE n >= 2""",
)
def sparkline_points(spark, d):
    return _rounded(W.sparkline(obs(spark, d)), 6, "x", "y").select(*KEY, "value", "x", "y")


@query(
    "district_ranking",
    f"""WITH {OBS} SELECT indicator, geography, CAST(period AS VARCHAR) AS period, value,
    row_number() OVER (PARTITION BY indicator, period ORDER BY value DESC, geography, dataset) AS position
  FROM obs WHERE indicator = 'ship_value' AND dataset = 'shipments_supplier' AND period BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
)
def district_ranking(spark, d):
    out = ranking.district_ranking(obs(spark, d, "shipments_supplier"), "ship_value", "1998", "shipments_supplier")
    return out.select("indicator", "geography", "period", "value", "position")


@query(
    "value_ranking",
    f"""WITH {OBS} SELECT {_ID}, value, row_number() OVER (PARTITION BY dataset, indicator ORDER BY value DESC, geography, period, unit) AS position
  FROM obs""",
)
def value_ranking(spark, d):
    out = ranking.ranking(obs(spark, d), ["dataset", "indicator"], "value", ["geography", "period", "unit"])
    return out.select(*KEY, "value", "position")


@query(
    "national_share",
    f"""WITH {OBS}, l AS (SELECT indicator, unit, frequency, geography, max(period) AS period, arg_max(value, period) AS value FROM obs
    WHERE dataset IN ('shipments_nation', 'shipments_world') AND unit <> 'percent' GROUP BY 1, 2, 3, 4)
  SELECT l.indicator, l.geography, CAST(l.period AS VARCHAR) AS period, l.value, w.value AS national_value,
    round(l.value / w.value * 100, 6) AS share
  FROM l JOIN l w ON l.indicator = w.indicator AND l.unit = w.unit AND l.frequency = w.frequency AND l.period = w.period
  WHERE l.geography <> '{WORLD}' AND w.geography = '{WORLD}'""",
)
def national_share(spark, d):
    rows = obs(spark, d, "shipments_nation", "shipments_world").filter("unit <> 'percent'")
    out = reconcile.national_share(rows, WORLD, ["indicator", "unit", "frequency"])
    return _rounded(out, 6, "share").select("indicator", "geography", "period", "value", "national_value", "share")


@query(
    "chronological_split",
    f"""WITH {OBS} SELECT {_ID}, CASE WHEN row_number() OVER w <= floor(0.7 * count(*) OVER (PARTITION BY {_S})) THEN 'train' ELSE 'later' END AS part
  FROM obs WINDOW w AS ({_W})""",
)
def chronological_split(spark, d):
    return W.chronological_split(obs(spark, d), 0.7).select(*KEY, "part")


@query(
    "holdout_split",
    f"""WITH {OBS} SELECT {_ID}, CASE WHEN row_number() OVER w > count(*) OVER (PARTITION BY {_S}) - 12 THEN 'test' ELSE 'train' END AS part
  FROM obs WINDOW w AS ({_W})""",
)
def holdout_split(spark, d):
    return W.holdout_split(obs(spark, d), 12).select(*KEY, "part")


@query(
    "calendar_densified",
    f"""WITH {OBS}, span AS (SELECT {_S}, min(period) AS lo, max(period) AS hi, bool_or(month(period) <> 1) AS m FROM obs
    GROUP BY ALL HAVING NOT bool_or(day(period) <> 1)),
  cal AS (SELECT {_S}, CAST(unnest(CASE WHEN m THEN generate_series(lo, hi, INTERVAL 1 MONTH) ELSE generate_series(lo, hi, INTERVAL 1 YEAR) END) AS DATE) AS period FROM span)
  SELECT {_S}, CAST(period AS VARCHAR) AS period, value FROM obs UNION ALL
  SELECT {_S}, CAST(period AS VARCHAR) AS period, NULL AS value FROM cal ANTI JOIN obs USING ({_S}, period)""",
)
def calendar_densified(spark, d):
    return W.densify(obs(spark, d))


@query(
    "common_periods",
    f"""WITH {OBS} SELECT geography, frequency, CAST(period AS VARCHAR) AS period FROM obs WHERE indicator IN ('ship_value', 'order_value', 'ship_qty')
  GROUP BY 1, 2, obs.period HAVING count(DISTINCT indicator) = 3""",
)
def common_periods(spark, d):
    return reconcile.common_periods(obs(spark, d), ["ship_value", "order_value", "ship_qty"], ["geography", "frequency"])


@query(
    "latest_common_period",
    f"""WITH {OBS}, c AS (SELECT geography, period FROM obs WHERE indicator IN ('ship_value', 'order_value') AND frequency = 'monthly'
    GROUP BY 1, 2 HAVING count(DISTINCT indicator) = 2) SELECT geography, CAST(max(period) AS VARCHAR) AS period FROM c GROUP BY 1""",
)
def latest_common_period(spark, d):
    rows = obs(spark, d).filter("frequency = 'monthly'")
    return reconcile.common_periods(rows, ["ship_value", "order_value"], ["geography"]).groupBy("geography").agg(
        F.max("period").alias("period")
    )


@query(
    "share_breakdown",
    f"""WITH {OBS}, c AS (SELECT dataset, geography, period FROM obs WHERE indicator IN ('returned_share', 'accepted_share')
    GROUP BY 1, 2, 3 HAVING count(DISTINCT indicator) = 2),
  l AS (SELECT dataset, geography, max(period) AS period FROM c GROUP BY 1, 2),
  p AS (SELECT dataset, geography, period, CASE indicator WHEN 'returned_share' THEN 'Returned' ELSE 'Accepted' END AS part, value
    FROM obs JOIN l USING (dataset, geography, period) WHERE indicator IN ('returned_share', 'accepted_share'))
  SELECT dataset, geography, CAST(period AS VARCHAR) AS period, part, round(value, 6) AS value FROM p UNION ALL
  SELECT dataset, geography, CAST(period AS VARCHAR), 'Other', round(100 - sum(value), 6) FROM p
  GROUP BY dataset, geography, p.period HAVING sum(value) > 0 AND sum(value) < 99.5""",
)
def share_breakdown(spark, d):
    out = reconcile.breakdown(
        obs(spark, d), {"returned_share": "Returned", "accepted_share": "Accepted"}, ["dataset", "geography"]
    )
    return _rounded(out, 6, "value")


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "chart_table",
    f"""WITH {OBS} SELECT dataset, CAST(period AS VARCHAR) AS period,
  max(value) FILTER (WHERE geography = 'NATION_1') AS "NATION_1", max(value) FILTER (WHERE geography = 'NATION_2') AS "NATION_2",
  max(value) FILTER (WHERE geography = 'NATION_3') AS "NATION_3" FROM obs
  WHERE indicator = 'ship_value' AND geography IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY dataset, obs.period""",
)
def chart_table(spark, d):
    rows = obs(spark, d, "shipments_nation", "shipments_annual").filter("indicator = 'ship_value'")
    return reconcile.series_table(rows, ["dataset", "period"], F.col("geography"), ["NATION_1", "NATION_2", "NATION_3"])


@query(
    "period_labels",
    f"""WITH {OBS} SELECT DISTINCT CAST(period AS VARCHAR) AS period, frequency, CAST(year(period) AS INT) AS year, CAST(month(period) AS INT) AS month,
  CASE WHEN frequency = 'monthly' THEN strftime(period, '%Y-%m') ELSE strftime(period, '%Y') END AS label FROM obs""",
)
def period_labels(spark, d):
    return obs(spark, d).select("period", "frequency").distinct().select(
        "period", "frequency", F.year("period").alias("year"), F.month("period").alias("month"),
        P.period_label(F.col("period"), F.col("frequency")).alias("label"),
    )


@query(
    "seasonal_encoding",
    """SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS orders, round(sin(2 * pi() * month(o_orderdate) / 12.0), 8) AS month_sin,
  round(cos(2 * pi() * month(o_orderdate) / 12.0), 8) AS month_cos FROM orders GROUP BY 1, 3, 4""",
)
def seasonal_encoding(spark, d):
    days = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count("*").alias("orders")
    )
    day = F.col("day")
    return days.withColumns(
        {"month_sin": F.round(P.month_sin(day), 8), "month_cos": F.round(P.month_cos(day), 8)}
    )
