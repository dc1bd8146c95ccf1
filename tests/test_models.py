import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statweave.operators import compare
from statweave.plans import anomalies, panel, regimes, reports, yields
from statweave.schema import SERIES


def wave(n=72):
    i = np.arange(n)
    return (i * 0.1 + 10 + np.sin(i * np.pi / 6)).tolist()


def lag_matrix(x, first_month=1, k=12):
    rows, y = [], []
    for t in range(k, len(x)):
        m = (first_month - 1 + t) % 12 + 1
        lags = x[t - k : t][::-1]
        rows.append([*lags, np.mean(lags), np.sin(2 * np.pi * m / 12), np.cos(2 * np.pi * m / 12)])
        y.append(x[t])
    return np.array(rows), np.array(y)


def ridge_fit(x, y, alpha):
    mean, dev = x.mean(0), x.std(0)
    dev[dev < 1e-12] = 1
    z = (x - mean) / dev
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / dev
    return lambda q: y.mean() + (np.asarray(q) - mean) @ beta


def recursive(predict, history, steps, first_month=1):
    h = list(history)
    for _ in range(steps):
        m = (first_month - 1 + len(h)) % 12 + 1
        lags = h[-12:][::-1]
        h.append(float(predict([*lags, np.mean(lags), np.sin(2 * np.pi * m / 12), np.cos(2 * np.pi * m / 12)])))
    return h[-steps:]


def brute_ridge(x):
    """Grid search over expanding folds, holdout metrics and forecast of one series."""
    train, test = x[:-12], x[-12:]
    fx, fy = lag_matrix(train)
    m, scores = len(fy), {}
    size = m // 4
    for alpha in panel.RIDGE_ALPHAS:
        maes = []
        for i in range(3):
            s = m - (3 - i) * size
            p = ridge_fit(fx[:s], fy[:s], alpha)
            maes.append(np.mean(np.abs(fy[s : s + size] - p(fx[s : s + size]))))
        scores[alpha] = np.mean(maes)
    alpha = min(scores, key=scores.get)
    guess = recursive(ridge_fit(fx, fy, alpha), train, 12)
    future = recursive(ridge_fit(*lag_matrix(x), alpha), x, 6)
    return alpha, scores[alpha], np.mean(np.abs(np.array(test) - guess)), future


def test_ridge_panel_equals_brute_force(series):
    rng = np.random.default_rng(11)
    noisy = (1e6 * (np.array(wave(83)) + rng.normal(0, 0.3, 83))).tolist()
    fact = series(noisy, indicator="noisy").unionByName(series(wave(72), indicator="wave"))
    out = {r.indicator: r for r in panel.forecast(fact, models=("ridge",)).collect()}
    for name, x in (("noisy", noisy), ("wave", wave(72))):
        alpha, cv, mae, future = brute_ridge(x)
        row = out[name]
        ridge = next(m for m in row.metrics if m.model == "ridge")
        assert ridge.parameter == alpha
        assert ridge.cv_one_step_mae == pytest.approx(cv, rel=1e-6)
        assert ridge.metrics.mae == pytest.approx(mae, rel=1e-6)
        naive = next(m for m in row.metrics if m.model == "seasonal_naive")
        assert naive.metrics.mae == pytest.approx(np.mean(np.abs(np.array(x[-12:]) - x[-24:-12])))
        if row.selected_model == "ridge":
            np.testing.assert_allclose([f.value for f in row.forecast], future, rtol=1e-6)


def test_forecast_prerequisites_and_dates(series):
    fact = (
        series(wave(72), indicator="ok")
        .unionByName(series(wave(20), indicator="short"))
        .unionByName(series(wave(72), indicator="holed").filter("period <> '2001-01-01'"))
        .unionByName(series([None if i == 5 else v for i, v in enumerate(wave(72))], indicator="missing"))
        .unionByName(series(wave(72), indicator="offset").withColumn("period", F.date_add("period", 1)))
    )
    out = {r.indicator: r for r in panel.forecast(fact, models=("ridge",), horizon=2).collect()}
    assert {k: r.reason for k, r in out.items()} == {
        "ok": None, "short": "too_short", "holed": "not_contiguous_months", "missing": "missing_or_nonfinite",
        "offset": "not_contiguous_months",
    }
    assert [str(f.period) for f in out["ok"].forecast] == ["2006-01-01", "2006-02-01"]
    assert str(out["ok"].holdout_start) == "2005-01-01" and out["ok"].training_rows == 60


def test_tree_models_report(series):
    rng = np.random.default_rng(2)
    fact = series(wave(72), indicator="a").unionByName(series((np.array(wave(72)) + rng.normal(0, 0.1, 72)).tolist(), indicator="b"))
    out = panel.forecast(fact, rounds=5).collect()
    for row in out:
        assert [m.model for m in row.metrics] == panel.MODEL_ORDER
        best = min(row.metrics, key=lambda m: m.metrics.mae)
        assert row.selected_model == best.model
        assert len(row.forecast) == 6 and all(np.isfinite(f.value) for f in row.forecast)


def test_seasonal_naive_repeats_beyond_a_season(series):
    h = panel.history(series(wave(30)))
    got = h.select(panel.seasonal_naive(F.col("values"), 15).alias("x")).first().x
    tail = wave(30)[-12:]
    assert got == tail + tail[:3]


def test_expanding_folds(series):
    rows = panel.feature_rows(series(wave(72))).groupBy("block").count().orderBy("block").collect()
    assert [(r.block, r["count"]) for r in rows] == [(0, 12), (1, 12), (2, 12), (3, 12), (4, 12)]
    rows = panel.feature_rows(series(wave(75))).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in rows] == [15, 12, 12, 12, 12]


def test_anomaly_flags(series):
    rng = np.random.default_rng(1)
    x = rng.normal(100, 1, 120)
    x[110] = 160
    fact = series(x.tolist()).unionByName(series(rng.normal(size=20).tolist(), indicator="short"))
    out = anomalies.anomalies(fact)
    rows = out.filter("indicator = 'cpi'").orderBy("period").collect()
    assert len(rows) == 119 - int(119 * 0.7)
    assert all(r.period > r.training_end for r in rows)
    spike = {str(r.period): r for r in rows}["2009-03-01"]
    assert spike.anomaly and spike.score == min(r.score for r in rows)
    assert [r.status for r in out.filter("indicator = 'short'").collect()] == ["blocked"]
    again = {str(r.period): r.score for r in anomalies.anomalies(fact).filter("indicator = 'cpi'").collect()}
    assert again == {str(r.period): r.score for r in rows}


def test_forest_scores_are_calibrated(series):
    rng = np.random.default_rng(4)
    rows = anomalies.monitored(series(rng.normal(50, 5, 200).tolist()))
    scores = anomalies.forest_scores(rows).toPandas().score
    assert 0.3 < scores.mean() < 0.6 and scores.max() > 0.55
    train = anomalies.forest_scores(rows).filter("train").toPandas()
    offset = np.percentile(-train.score, 5)
    assert 0.03 <= (-train.score < offset).mean() <= 0.06


def test_ridge_solves_a_bounded_number_of_series_at_a_time(monkeypatch):
    import pyarrow as pa

    rng, solved, solve = np.random.default_rng(2), [], panel._solve
    monkeypatch.setattr(panel, "_solve", lambda sets, *a: solved.append(len(sets)) or solve(sets, *a))
    rows, upper = 600, np.triu_indices(5)
    sums = []
    for _ in range(rows):
        parts = [np.column_stack([np.ones(9), rng.normal(size=(9, 4))]) for _ in range(3)]
        sums.append([(p.T @ p)[upper].tolist() for p in parts])
    batch = pa.record_batch([pa.array([str(i) for i in range(rows)]), pa.array(sums)], names=["k", "sums"])
    out = pa.Table.from_batches(panel._solved([batch.slice(1)], ["k"], (1.0, 10.0), 5)).to_pydict()
    assert max(solved) <= 3 * 256 and out["k"] == [str(i) for i in range(1, rows)]
    whole = solve(np.cumsum(np.array(sums[1:]), axis=1).reshape(-1, 15), (1.0, 10.0), 5).reshape(rows - 1, 3, 2, 4)
    assert np.array(out["fits"]) == pytest.approx(whole, rel=1e-9)


@pytest.mark.parametrize("sample", [256, 16])
def test_only_rows_outside_the_samples_fall_again(monkeypatch, sample):
    rng = np.random.default_rng(9)
    points, train = np.round(rng.normal(size=(60, 2)), 1), np.arange(60) < 40
    fell, depths = [], anomalies.depths
    monkeypatch.setattr(anomalies, "depths", lambda p, *a: fell.append(len(p)) or depths(p, *a))
    got = anomalies.isolation_scores(points, train, 20, sample, np.random.default_rng(3))
    assert fell == [20 if sample > 40 else 60]
    levels, _ = anomalies.grow(points[train], 20, sample, np.random.default_rng(3))

    def depth(point, tree):
        node = tree
        for level in levels:
            if level["leaf"][node]:
                return level["depth"][node]
            node = level["child"][node] + (point[level["feature"][node]] > level["cut"][node])

    expected = 2 * (np.log(min(sample, 40) - 1) + 0.5772156649015329) - 2 * (min(sample, 40) - 1) / min(sample, 40)
    plain = [2 ** (-np.mean([depth(p, t) for t in range(20)]) / expected) for p in points]
    assert got == pytest.approx(plain, rel=1e-12)


def _matrix(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    level = np.where(np.arange(n) < n // 2, 0, 8)
    dates = pd.date_range("2000-01-01", periods=n, freq="MS").date
    rows = [(d, *(float(level[i] * s + rng.normal()) for s in (1, -1, 2, 0.5))) for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "period date, a double, b double, c double, d double")


def test_regimes_find_the_break(spark):
    out = regimes.regimes(_matrix(spark), list("abcd"), restarts=2)
    assert out["status"] == "trained" and out["clusters"] == 2 and out["rows"] == 60
    periods = out["periods"].orderBy("period").toPandas()
    assert periods.cluster[:30].nunique() == 1 and periods.cluster[30:].nunique() == 1
    assert sorted(r.periods for r in out["profile"].collect()) == [30, 30]


def test_regime_requirements(spark):
    small = _matrix(spark, 20)
    assert regimes.regimes(small, list("abcd"))["status"] == "blocked"
    assert regimes.regimes(_matrix(spark), ["a", "b"])["status"] == "blocked"
    infinite = _matrix(spark).withColumn("a", F.when(F.col("period") == "2000-01-01", float("inf")).otherwise(F.col("a")))
    assert regimes.regimes(infinite, list("abcd"))["reason"] == "impossible_numbers"


@pytest.fixture(scope="module")
def crops(spark):
    rows = [(y, "wheat" if d % 2 else "maize", str(d), float(100 + d), 2 + d / 100 + (y - 2000) / 10) for y in range(2000, 2006) for d in range(20)]
    return spark.createDataFrame(rows, "year int, crop string, district string, area double, yield double")


def test_yield_model(crops):
    out = yields.yield_model(crops, trees=20, repeats=2)
    assert (out["holdout_year"], out["holdout_rows"], out["training_rows"]) == (2005, 20, 100)
    importance = {r.feature: r.mae_increase for r in out["permutation_importance"].collect()}
    assert set(importance) == {"year", "area", "crop", "district"}
    errors = {r.model: r.mae for r in out["metrics"].collect()}
    assert errors["random_forest"] < errors["training_median"]


def test_permutation_is_one_to_one(crops):
    test = crops.filter("year = 2005")
    out = yields.permuted(test, repeats=3).toPandas()
    assert len(out) == 20 * 3 * 4
    for (_, feature), part in out.groupby(["repeat", "feature"]):
        assert sorted(part[feature]) == sorted(test.toPandas()[feature])
    assert (out[out.feature == "area"].set_index("district").area != out[out.feature == "area"].set_index("district").index.astype(float) + 100).any()


def test_yield_requirements(spark, crops):
    assert yields.yield_model(spark.createDataFrame([], "year int"))["status"] == "blocked"
    assert "too_few_rows_or_years" in yields.yield_model(crops.filter("year < 2004"))["reason"]
    assert "impossible_numbers" in yields.yield_model(crops.withColumn("area", F.lit(0.0)))["reason"]


def test_saved_reports(spark, series, tmp_path):
    fact = series(wave(72))
    out = panel.forecast(fact, models=("ridge",))
    reports.save(out, fact, str(tmp_path / "r"), "forecast")
    row = reports.listing(spark, str(tmp_path / "r"), "forecast").first()
    assert row.provenance.observations == 72 and str(row.provenance.period_end) == "2005-12-01" and row.status == "trained"


def test_reports_of_blocked_series_have_all_fields(spark, series, tmp_path):
    fact = series(wave(20))
    reports.save(panel.forecast(fact, models=("ridge",)), fact, str(tmp_path / "r"), "forecast")
    row = reports.listing(spark, str(tmp_path / "r"), "forecast").select("status", "reason", "selected_model", "forecast").first()
    assert tuple(row) == ("blocked", "too_short", None, None)


def test_panel_queries_read_every_series_with_the_default_rounds(spark, sf, monkeypatch):
    import __spark_entry__ as entry
    from workload.observations import obs

    class Called(Exception):
        pass

    def called(fact, **how):
        raise Called(fact, how)

    monkeypatch.setattr(panel, "forecast", called)
    every = {r.dataset for r in obs(spark, sf).select("dataset").distinct().collect()}
    models = {
        "panel_model_metrics": {}, "forest_panel_metrics": {"models": ("ridge", "random_forest")},
        "boosting_panel_metrics": {"models": ("gradient_boosting",)}, "ridge_panel_forecast": {"models": ("ridge",)},
    }
    for name, want in models.items():
        with pytest.raises(Called) as e:
            entry.queries()[name](spark, sf)
        fact, how = e.value.args
        assert how == want and {r.dataset for r in fact.select("dataset").distinct().collect()} == every
