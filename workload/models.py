"""Series models: requirements, naive and ridge forecasts, trees, regimes, novelty, yields."""

from pyspark.sql import functions as F

from statweave.operators import compare
from statweave.operators import series as W
from statweave.plans import anomalies, panel, regimes, reports, yields
from statweave.schema import KEY, SERIES
from statweave.session import materialized, scratch_path

from .observations import OBS, WORLD, obs, table
from .registry import query

_S = "dataset, indicator, geography, unit, frequency"
_ID = "dataset, indicator, geography, CAST(period AS VARCHAR) AS period, unit, frequency"
_W = f"PARTITION BY {_S} ORDER BY period"
_ELIGIBLE = f"""elig AS (SELECT {_S}, count(*) AS observations, CASE
    WHEN count(DISTINCT period) <> count(*) THEN 'duplicate_periods'
    WHEN bool_or(NOT isfinite(value)) THEN 'missing_or_nonfinite'
    WHEN bool_or(day(period) <> 1) OR date_diff('month', min(period), max(period)) + 1 <> count(*) THEN 'not_contiguous_months'
    WHEN count(*) < 60 THEN 'too_short' END AS reason FROM obs GROUP BY ALL),
  ready AS (SELECT obs.*, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {_S}) AS n
    FROM obs SEMI JOIN (SELECT * FROM elig WHERE reason IS NULL) e USING ({_S}) WINDOW w AS ({_W}))"""


@query(
    "series_eligibility",
    f"WITH {OBS}, {_ELIGIBLE} SELECT {_S}, observations, CASE WHEN reason IS NULL THEN 'ready' ELSE 'blocked' END AS status, reason FROM elig",
)
def series_eligibility(spark, d):
    return panel.eligibility(obs(spark, d))


@query(
    "seasonal_naive_holdout",
    f"""WITH {OBS}, {_ELIGIBLE}, p AS (SELECT *, lag(value, 12) OVER ({_W}) AS guess FROM ready)
  SELECT {_S}, round(avg(abs(value - guess)), 5) AS mae, round(sqrt(avg((value - guess) * (value - guess))), 5) AS rmse,
    round(avg(CASE WHEN abs(value) > 1e-10 THEN abs((value - guess) / value) END) * 100, 6) AS mape_percent,
    count(*) FILTER (WHERE abs(value) > 1e-10) AS mape_eligible_rows FROM p WHERE rn > n - 12 GROUP BY ALL""",
)
def seasonal_naive_holdout(spark, d):
    h = panel.ready_history(obs(spark, d))
    train = F.slice("values", F.lit(1), F.size("values") - 12)
    out = h.select(*SERIES, panel.error_columns(F.slice("values", -12, 12), panel.seasonal_naive(train, 12)).alias("e")).select(*SERIES, "e.*")
    return out.withColumns({"mae": F.round("mae", 5), "rmse": F.round("rmse", 5), "mape_percent": F.round("mape_percent", 6)})


@query(
    "seasonal_naive_forecast",
    f"""WITH {OBS}, {_ELIGIBLE}, last AS (SELECT {_S}, max(period) AS last_period FROM ready GROUP BY ALL)
  SELECT r.dataset, r.indicator, r.geography, r.unit, r.frequency, CAST(CAST(last_period + to_months(CAST(h AS INT)) AS DATE) AS VARCHAR) AS period, value
  FROM ready r JOIN last USING ({_S}) CROSS JOIN generate_series(1, 18) g(h) WHERE rn = n - 12 + (h - 1) % 12 + 1""",
)
def seasonal_naive_forecast(spark, d):
    h = panel.ready_history(obs(spark, d))
    return h.select(
        *SERIES, F.element_at("periods", -1).alias("last"), F.posexplode(panel.seasonal_naive(F.col("values"), 18)).alias("i", "value")
    ).select(*SERIES, F.add_months("last", F.col("i") + 1).alias("period"), "value")


_BLOCKS = f"""m AS (SELECT *, n - 24 AS m, (n - 24) // 4 AS size, rn - 13 AS ix FROM ready WHERE rn > 12)
  SELECT {_ID}, CAST(CASE WHEN ix >= m THEN 4 WHEN ix < m - 3 * size THEN 0 ELSE 1 + (ix - (m - 3 * size)) // size END AS INT) AS block FROM m"""


@query("expanding_folds", f"WITH {OBS}, {_ELIGIBLE}, {_BLOCKS}")
def expanding_folds(spark, d):
    ready = W.positions(panel.ready_series(obs(spark, d)))
    return panel.with_blocks(ready.filter("row > 12")).select(*KEY, "block")


@query(
    "ridge_fold_moments",
    f"""WITH {OBS}, {_ELIGIBLE}, f AS (SELECT *, lag(value, 1) OVER ({_W}) AS lag_1, lag(value, 12) OVER ({_W}) AS lag_12 FROM ready),
  b AS (SELECT *, n - 24 AS m, (n - 24) // 4 AS size, rn - 13 AS ix FROM f WHERE rn > 12),
  c AS (SELECT *, CASE WHEN ix >= m THEN 4 WHEN ix < m - 3 * size THEN 0 ELSE 1 + (ix - (m - 3 * size)) // size END AS block FROM b)
  SELECT {_S}, CAST(block AS INT) AS block, count(*) AS feature_rows, round(sum(value / 1e6 * lag_1 / 1e6), 6) AS lag_1_target, round(sum(value / 1e6 * lag_12 / 1e6), 6) AS lag_12_target
  FROM c GROUP BY ALL""",
)
def ridge_fold_moments(spark, d):
    """Sums of products per fold block, in millions (the full set feeds the ridge solver)."""
    ready = panel.ready_series(obs(spark, d))
    rows = panel.with_blocks(W.lag_features(W.positions(ready)))
    million = lambda c: F.col(c) / 1e6
    return rows.groupBy(*SERIES, "block").agg(
        F.count("*").alias("feature_rows"),
        F.round(F.sum(F.col("value") / 1e6 * F.col("lag_1") / 1e6), 6).alias("lag_1_target"),
        F.round(F.sum(F.col("value") / 1e6 * F.col("lag_12") / 1e6), 6).alias("lag_12_target"),
    )


# Ridge from first principles: features of scaled values, normal equations per series, fold and alpha, solved by elimination, errors
# over the folds, and recursive paths. Block k holds the rows that fold k validates; set k has the blocks up to k.
_RIDGE = f"""
  scale AS (SELECT {_S}, avg(value) FILTER (WHERE rn <= n - 12) AS center, stddev_pop(value) FILTER (WHERE rn <= n - 12) AS dev FROM ready GROUP BY ALL),
  one AS (SELECT {_S}, row_number() OVER (ORDER BY {_S}) AS s, n, center, spread, list((value - center) / spread ORDER BY rn) AS v,
      list(value ORDER BY rn) AS raw, month(min(period)) AS m0, max(period) AS last_period
    FROM (SELECT ready.*, center, CASE WHEN dev > 0 THEN dev ELSE 1 END AS spread FROM ready JOIN scale USING ({_S})) GROUP BY {_S}, n, center, spread),
  x AS (SELECT s, t, y, CASE WHEN t - 13 >= m THEN 4 WHEN t - 13 < m - 3 * size THEN 0 ELSE 1 + (t - 13 - (m - 3 * size)) // size END AS block, lags || [
      list_avg(lags), sin(2 * pi() * ((m0 + t - 2) % 12 + 1) / 12), cos(2 * pi() * ((m0 + t - 2) % 12 + 1) / 12)] AS x
    FROM (SELECT s, t, m0, n - 24 AS m, (n - 24) // 4 AS size, v[t] AS y, list_reverse(v[t - 12 : t - 1]) AS lags FROM one, unnest(generate_series(13, n)) u(t))),
  l AS (SELECT s, k, t, y, x[i] AS x, i FROM x, generate_series(0, 4) g(k), generate_series(1, 15) h(i) WHERE block <= k),
  mean AS (SELECT s, k, i, avg(x) AS mu, CASE WHEN stddev_pop(x) < 1e-12 THEN 1 ELSE stddev_pop(x) END AS sd, avg(y) AS my FROM l GROUP BY ALL),
  z AS (SELECT s, k, t, i, (x - mu) / sd AS z, y - my AS y FROM l JOIN mean USING (s, k, i)),
  normal AS (SELECT a.s, a.k, a.i, b.i AS j, sum(a.z * b.z) AS c FROM z a JOIN z b ON a.s = b.s AND a.k = b.k AND a.t = b.t GROUP BY ALL
    UNION ALL SELECT s, k, i, 16, sum(z * y) FROM z GROUP BY ALL),
  equations AS (SELECT s, k, a, alpha, list(row_ ORDER BY i) AS m FROM (
      SELECT s, k, i, a, alpha, list(c + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j) AS row_
      FROM normal, (VALUES (0, 1.0::DOUBLE), (1, 10.0), (2, 100.0)) al(a, alpha) GROUP BY s, k, i, a, alpha) GROUP BY ALL),
  solved AS (SELECT s, k, a, 1 AS step, m FROM equations UNION ALL
    SELECT s, k, a, step + 1, list_transform(m, lambda r, i: CASE WHEN i = step THEN list_transform(r, lambda q: q / r[step])
      ELSE list_transform(r, lambda q, j: q - r[step] * m[step][j] / m[step][step]) END) FROM solved WHERE step <= 15),
  coef AS (SELECT s, k, a, list(b ORDER BY i) AS b, any_value(my) - sum(b * mu) AS b0
    FROM (SELECT s, k, a, i, m[i][16] / sd AS b, mu, my FROM solved JOIN mean USING (s, k) WHERE step = 16) GROUP BY s, k, a),
  cv AS (SELECT s, a, avg(e) AS cv FROM (SELECT s, a, k, avg(abs(y - b0 - list_inner_product(b, x)) * spread) AS e
    FROM x JOIN coef USING (s) JOIN one USING (s) WHERE block = k + 1 AND k < 3 GROUP BY ALL) GROUP BY ALL),
  best AS (SELECT s, arg_min(a, (cv, a)) AS a, min(cv) AS cv FROM cv GROUP BY s),
  paths AS (SELECT s, k, b, b0, m0, 0 AS step, v[1 : CASE WHEN k = 3 THEN n - 12 ELSE n END] AS h FROM one JOIN best USING (s) JOIN coef USING (s, a) WHERE k >= 3
    UNION ALL SELECT s, k, b, b0, m0, step + 1, h || [b0 + list_inner_product(b, list_reverse(h[-12:]) || [list_avg(h[-12:]),
      sin(2 * pi() * ((m0 + len(h) - 1) % 12 + 1) / 12), cos(2 * pi() * ((m0 + len(h) - 1) % 12 + 1) / 12)])]
    FROM paths WHERE step < CASE WHEN k = 3 THEN 12 ELSE 6 END),
  held AS (SELECT s, raw[n - 12 + i] AS y, h[n - 12 + i] * spread + center AS p, raw[n - 24 + i] AS naive
    FROM paths JOIN one USING (s), generate_series(1, 12) g(i) WHERE k = 3 AND step = 12),
  scored AS (SELECT s, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, avg(CASE WHEN abs(y) > 1e-10 THEN abs((y - p) / y) END) * 100 AS mape_percent,
    avg(abs(y - naive)) AS naive FROM held GROUP BY s)"""


def _sql_digits(x: str) -> str:
    """Six significant digits; powers of ten are whole numbers, so that every engine has them exactly."""
    e = f"(floor(log10(abs({x}))) - 5)"
    return f"CASE WHEN {x} = 0 THEN 0.0 WHEN {e} < 0 THEN round({x} * pow(10.0, -{e})) / pow(10.0, -{e}) ELSE round({x} / pow(10.0, {e})) * pow(10.0, {e}) END"


def _digits(c: str):
    return F.expr(_sql_digits(c).replace("10.0", "10D").replace("0.0", "0D"))


@query(
    "ridge_panel_forecast",
    f"""WITH RECURSIVE {OBS}, {_ELIGIBLE}, {_RIDGE},
  f AS (SELECT s, i, CASE WHEN mae < naive THEN 'ridge' ELSE 'seasonal_naive' END AS model, CASE WHEN mae < naive THEN h[n + i] * spread + center ELSE raw[n - 12 + i] END AS value
    FROM paths JOIN one USING (s) JOIN scored USING (s), generate_series(1, 6) g(i) WHERE k = 4 AND step = 6)
  SELECT e.dataset, e.indicator, e.geography, e.unit, e.frequency, CASE WHEN reason IS NULL THEN 'trained' ELSE 'blocked' END AS status, reason, model AS selected_model,
    CAST(CAST(last_period - to_months(11) AS DATE) AS VARCHAR) AS holdout_start, CAST(CAST(last_period + to_months(CAST(i AS INT)) AS DATE) AS VARCHAR) AS period,
    {_sql_digits("value")} AS value FROM elig e LEFT JOIN one USING ({_S}) LEFT JOIN f USING (s)""",
)
def ridge_panel_forecast(spark, d):
    out = panel.forecast(obs(spark, d), models=("ridge",))
    return out.select(*SERIES, "status", "reason", "selected_model", "holdout_start", F.explode_outer("forecast").alias("f")).select(
        *SERIES, "status", "reason", "selected_model", "holdout_start", "f.period", "f.value"
    ).withColumn("value", _digits("value"))


@query(
    "ridge_panel_metrics",
    f"""WITH RECURSIVE {OBS}, {_ELIGIBLE}, {_RIDGE}
  SELECT {_S}, {", ".join(f"{_sql_digits(c)} AS {c}" for c in ("mae", "rmse", "mape_percent"))}, {_sql_digits("cv")} AS cv_one_step_mae, [1.0, 10.0, 100.0][a + 1]::DOUBLE AS alpha
  FROM one JOIN scored USING (s) JOIN best USING (s)""",
)
def ridge_panel_metrics(spark, d):
    """Errors of every series' ridge over the folds and the held-out year, and the alpha its folds chose."""
    out = panel.forecast(obs(spark, d), models=("ridge",)).select(*SERIES, F.explode("metrics").alias("m")).filter("m.model = 'ridge'")
    found = out.select(*SERIES, "m.metrics.mae", "m.metrics.rmse", "m.metrics.mape_percent", "m.cv_one_step_mae", F.col("m.parameter").alias("alpha"))
    return found.withColumns({c: _digits(c) for c in ("mae", "rmse", "mape_percent", "cv_one_step_mae")})


def _panel_metrics(spark, d, **how):
    out = panel.forecast(obs(spark, d), **how)
    return out.select(*SERIES, "status", "selected_model", F.explode_outer("metrics").alias("m")).select(
        *SERIES, "status", "selected_model", "m.model", "m.metrics.mae", "m.metrics.rmse", "m.metrics.mape_percent", "m.cv_one_step_mae", "m.parameter"
    )


@query("panel_model_metrics")
def panel_model_metrics(spark, d):
    """All models of every series against the naive forecast."""
    return _panel_metrics(spark, d)


@query("forest_panel_metrics")
def forest_panel_metrics(spark, d):
    """Ridge and random forest against the naive forecast."""
    return _panel_metrics(spark, d, models=("ridge", "random_forest"))


@query("boosting_panel_metrics")
def boosting_panel_metrics(spark, d):
    """Gradient boosting against the naive forecast."""
    return _panel_metrics(spark, d, models=("gradient_boosting",))


_REGIME = ["ship_value", "ship_qty", "ship_lines", "returned_share", "accepted_share", "order_value", "order_count"]


def _national_matrix(spark, d):
    rows = obs(spark, d, "shipments_world", "orders_world")
    return compare.wide(rows, ["period"], _REGIME)


@query(
    "regime_matrix",
    f"""WITH {OBS}, w AS (SELECT period, {", ".join(f"max(value) FILTER (WHERE indicator = '{c}') AS {c}" for c in _REGIME)} FROM obs
    WHERE dataset IN ('shipments_world', 'orders_world') GROUP BY 1),
  c AS (SELECT * FROM w WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _REGIME)})
  SELECT CAST(period AS VARCHAR) AS period, {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS z_{c}" for c in _REGIME)} FROM c""",
)
def regime_matrix(spark, d):
    z = regimes.standardized(_national_matrix(spark, d).dropna(), _REGIME)
    return z.select("period", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in _REGIME])


@query(
    "regime_profile",
    f"""WITH {OBS}, w AS (SELECT period, {", ".join(f"max(value) FILTER (WHERE indicator = '{c}') AS {c}" for c in _REGIME)} FROM obs
    WHERE dataset IN ('shipments_world', 'orders_world') GROUP BY 1),
  c AS (SELECT * FROM w WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _REGIME)})
  SELECT count(*) AS periods, {", ".join(f"round(avg({c}) / 1e3, 4) AS {c}" for c in _REGIME)} FROM c""",
)
def regime_profile(spark, d):
    """Cluster means, weighted by the clusters' periods: together they are the means of all periods."""
    profile = regimes.regimes(_national_matrix(spark, d), _REGIME)["profile"]
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("periods")) / F.sum("periods") / 1e3, 4).alias(c)
    return profile.agg(F.sum("periods").alias("periods"), *[mean(c) for c in _REGIME])


@query("regime_periods")
def regime_periods(spark, d):
    out = regimes.regimes(_national_matrix(spark, d), _REGIME)
    return out["periods"]


@query("anomaly_flags")
def anomaly_flags(spark, d):
    return anomalies.anomalies(obs(spark, d))


@query(
    "anomaly_rows",
    f"""WITH {OBS}, c AS (SELECT *, value / nullif(lag(value) OVER ({_W}), 0) - 1.0::DOUBLE AS change FROM obs),
  r AS (SELECT *, row_number() OVER ({_W}) AS rn, count(*) OVER (PARTITION BY {_S}) AS n FROM c WHERE change IS NOT NULL),
  s AS (SELECT *, rn <= floor(0.7 * n) AS train, floor(0.7 * n) >= 24 AND n - floor(0.7 * n) >= 6 AS enough FROM r)
  SELECT {_S}, 'trained' AS status, CAST(max(period) FILTER (WHERE train) AS VARCHAR) AS training_end, count(*) FILTER (WHERE NOT train) AS later_rows,
    CAST(max(period) AS VARCHAR) AS last_period, true AS flags_known FROM s WHERE enough GROUP BY {_S}
  UNION ALL SELECT {_S}, 'blocked', NULL, 0, NULL, NULL FROM s WHERE NOT enough GROUP BY {_S}""",
)
def anomaly_rows(spark, d):
    """What the flags of every series of the fact rest on; the flags themselves are in ``anomaly_flags``."""
    out = anomalies.anomalies(obs(spark, d))
    return out.groupBy(*SERIES, "status").agg(
        F.max("training_end").alias("training_end"), F.count("period").alias("later_rows"), F.max("period").alias("last_period"),
        F.bool_and(F.col("anomaly").isNotNull() & F.when(F.col("status") == "trained", True)).alias("flags_known"),
    ).withColumn("flags_known", F.when(F.col("status") == "trained", F.col("flags_known")))


@query(
    "monitoring_split",
    f"""WITH {OBS}, c AS (SELECT *, value / nullif(lag(value) OVER ({_W}), 0) - 1.0::DOUBLE AS change FROM obs),
  r AS (SELECT *, row_number() OVER ({_W}) AS rn, count(*) OVER (PARTITION BY {_S}) AS n FROM c WHERE change IS NOT NULL)
  SELECT {_ID}, round(change, 8) AS change, rn <= floor(0.7 * n) AS train,
    CASE WHEN floor(0.7 * n) >= 24 AND n - floor(0.7 * n) >= 6 THEN 'trained' ELSE 'blocked' END AS status FROM r""",
)
def monitoring_split(spark, d):
    return anomalies.monitored(obs(spark, d)).select(*KEY, F.round("change", 8).alias("change"), "train", "status")


def _yield_panel(spark, d):
    return spark.sql(f"""SELECT year(l_shipdate) AS year, p_type AS crop, n_name AS district,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS area,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS yield
      FROM parquet.`{d}/lineitem.parquet` JOIN parquet.`{d}/part.parquet` ON l_partkey = p_partkey
      JOIN parquet.`{d}/supplier.parquet` ON l_suppkey = s_suppkey JOIN parquet.`{d}/nation.parquet` ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""")


_YIELD = """y AS (SELECT CAST(year(l_shipdate) AS INT) AS year, p_type AS crop, n_name AS district, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS area,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS yield
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


@query(
    "yield_split",
    f"WITH {_YIELD} SELECT year, crop, district, area, round(yield, 6) AS yield, CASE WHEN year = (SELECT max(year) FROM y) THEN 'test' ELSE 'train' END AS part FROM y",
)
def yield_split(spark, d):
    return yields.year_split(_yield_panel(spark, d)).withColumn("yield", F.round("yield", 6))


@query(
    "yield_median_baseline",
    f"""WITH {_YIELD}, t AS (SELECT * FROM y WHERE year = (SELECT max(year) FROM y)),
  b AS (SELECT median(yield) AS guess FROM y WHERE year < (SELECT max(year) FROM y))
  SELECT round(avg(abs(yield - guess)), 5) AS mae, round(sqrt(avg((yield - guess) * (yield - guess))), 5) AS rmse,
    round(avg(abs((yield - guess) / yield)) * 100, 5) AS mape_percent, count(*) AS mape_eligible_rows FROM t, b""",
)
def yield_median_baseline(spark, d):
    out = yields.median_baseline(yields.year_split(_yield_panel(spark, d)))
    return out.withColumns({c: F.round(c, 5) for c in ("mae", "rmse", "mape_percent")})


@query(
    "yield_model_rows",
    f"""WITH {_YIELD}, last AS (SELECT max(year) AS year FROM y), t AS (SELECT y.* FROM y JOIN last USING (year)),
  b AS (SELECT median(yield) AS guess FROM y WHERE year < (SELECT year FROM last))
  SELECT model, training_rows, holdout_rows, holdout_year, mae FROM (SELECT (SELECT count(*) FROM y) - (SELECT count(*) FROM t) AS training_rows,
    (SELECT count(*) FROM t) AS holdout_rows, (SELECT year FROM last) AS holdout_year, round(avg(abs(yield - guess)), 5) AS m FROM t, b)
  JOIN (VALUES ('training_median'), ('random_forest')) v(model) ON true,
  LATERAL (SELECT CASE WHEN model = 'training_median' THEN m END AS mae)""",
)
def yield_model_rows(spark, d):
    """Size and year of the holdout and the baseline's error; the forest's error is in ``yield_model_metrics``."""
    out = yields.yield_model(_yield_panel(spark, d))
    whole = lambda k, t="long": F.lit(out[k]).cast(t).alias(k)
    return out["metrics"].select(
        "model", whole("training_rows"), whole("holdout_rows"), whole("holdout_year", "int"),
        F.round(F.when(F.col("model") == "training_median", F.col("mae")), 5).alias("mae"),
    )


@query("yield_model_metrics")
def yield_model_metrics(spark, d):
    return yields.yield_model(_yield_panel(spark, d))["metrics"]


@query("yield_permutation_importance")
def yield_permutation_importance(spark, d):
    return yields.yield_model(_yield_panel(spark, d))["permutation_importance"]


@query(
    "report_provenance",
    f"""WITH {OBS} SELECT {_S}, CAST(min(period) AS VARCHAR) AS period_start, CAST(max(period) AS VARCHAR) AS period_end, count(*) AS observations,
  string_agg(DISTINCT source_url, ',') AS source_urls FROM obs GROUP BY {_S}""",
)
def report_provenance(spark, d):
    return reports.provenance(obs(spark, d)).withColumn("source_urls", F.array_join("source_urls", ","))


@query(
    "saved_reports",
    f"""WITH {OBS}, {_ELIGIBLE} SELECT {_S}, CASE WHEN reason IS NULL THEN 'trained' ELSE 'blocked' END AS status, reason, observations,
  CAST(p.period_end AS VARCHAR) AS period_end, CASE WHEN reason IS NULL THEN 12 END AS holdout_rows,
  CASE WHEN reason IS NULL THEN 2 ELSE -1 END AS models, CASE WHEN reason IS NULL THEN 6 ELSE -1 END AS forecast_rows
  FROM elig JOIN (SELECT {_S}, max(period) AS period_end FROM obs GROUP BY ALL) p USING ({_S})""",
)
def saved_reports(spark, d):
    """Every series with its report: what was trained, on what, and how far it looks ahead."""
    path, fact = scratch_path(spark, "reports"), materialized(obs(spark, d), "reported")
    reports.save(panel.forecast(fact, models=("ridge",)), fact, path, "forecast")
    return reports.listing(spark, path, "forecast").select(
        *SERIES, "status", "reason", "provenance.observations", "provenance.period_end", "holdout_rows",
        F.coalesce(F.size("metrics"), F.lit(-1)).alias("models"), F.coalesce(F.size("forecast"), F.lit(-1)).alias("forecast_rows"),
    )
