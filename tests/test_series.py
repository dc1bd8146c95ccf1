import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statweave.operators import compare, coverage, ranking, reconcile, select
from statweave.operators import series as W
from statweave.operators.validate import ContractError
from statweave.schema import SERIES


def values(df, column="value"):
    return [r[column] for r in df.orderBy("period").collect()]


def test_change_rolling_index(series):
    s = series([100, 110, 121])
    assert values(W.transform(s, "pct_change")) == [None, pytest.approx(10), pytest.approx(10)]
    assert values(W.transform(s, "rolling_mean", 2)) == [None, 105, 115.5]
    assert values(W.transform(s, "index")) == [100, pytest.approx(110), pytest.approx(121)]
    with pytest.raises(ValueError):
        W.transform(s, "rolling_mean", 1)


def test_zero_bases(series):
    s = series([0, 2, 4])
    assert values(W.transform(s, "pct_change")) == [None, None, pytest.approx(100)]
    assert values(W.transform(s, "index")) == [None, None, None]
    d = W.dashboard_transforms(s)
    assert values(d, "index_value") == [0, 100, 200]
    assert values(d, "rolling_value") == [None, None, 2]


def test_trends_follow_pandas(series):
    rng = np.random.default_rng(3)
    x = pd.Series(np.r_[rng.normal(10, 3, 20), 0, rng.normal(10, 3, 20)])
    t = W.trends(series(x.tolist()), 5)
    change = x.pct_change(fill_method=None).replace([np.inf, -np.inf], np.nan)
    for column, expected in {
        "percentage_change": change * 100, "rolling_average": x.rolling(5, min_periods=5).mean(), "moving_volatility": change.rolling(5).std(),
    }.items():
        got = pd.Series(values(t, column), dtype=float)
        np.testing.assert_allclose(got, expected, rtol=1e-9, equal_nan=True)


def test_units_do_not_interleave(series):
    s = series([1, 2, 4]).unionByName(series([10, 30, 90], unit="other"))
    got = {(r.unit, str(r.period)): r.value for r in W.transform(s, "pct_change").collect()}
    assert got[("index", "2000-03-01")] == pytest.approx(100) and got[("other", "2000-03-01")] == pytest.approx(200)


def test_transform_before_page(series):
    page = select.timeseries(series([100, 110, 121]), "cpi", "Pakistan", how="pct_change", limit=1, offset=1).collect()
    assert [r.value for r in page] == [pytest.approx(10)]
    assert select.timeseries(series([1]), "cpi'; DROP TABLE x; --", "Pakistan").collect() == []
    assert select.availability(select.timeseries(series([1]), "cpi", "Swat")) == "unavailable"


def test_pages_report_their_total(series):
    fact = series([100, 110, 121, 133.1])
    page = select.timeseries_page(fact, "cpi", "Pakistan", how="pct_change", limit=1, offset=1)
    assert (page["status"], page["total"], page["limit"], page["offset"], page["transform"]) == ("available", 4, 1, 1, "pct_change")
    assert [r.value for r in page["rows"].collect()] == [pytest.approx(10)]
    assert [r.value for r in select.page(fact, ["period"], None, 2).collect()] == [121, pytest.approx(133.1)]
    after = select.page_after(fact, ["indicator", "period"], {"indicator": "cpi", "period": dt.date(2000, 2, 1)}, 1)
    assert [r.value for r in after.collect()] == [121]
    assert [r.value for r in select.snapshot(fact).collect()] == [100, 110, 121, pytest.approx(133.1)]


def test_densify_keeps_every_observation(series, spark):
    days = [(dt.date(2000, 1, 15), 1.0), (dt.date(2000, 2, 20), 2.0), (dt.date(2000, 4, 15), 3.0)]
    daily = series([0]).drop("period", "value").crossJoin(spark.createDataFrame(days, "period date, value double"))
    assert sorted(r.period for r in W.densify(daily).collect()) == [d for d, _ in days]
    months = W.densify(series([1, 2, 3, 4]).filter("month(period) <> 3"))
    assert sorted((r.period.month, r.value) for r in months.collect() if r.value) == [(1, 1.0), (2, 2.0), (4, 4.0)]
    assert [r.period.month for r in months.collect() if r.value is None] == [3]


def test_an_extra_indicator_needs_no_dictionary_entry(series, spark):
    words = spark.createDataFrame([("other", "economy")], "indicator string, domain string")
    rows = series([1, 2])
    assert select.subject_rows(rows, words, "economy", "", {"economy": ["cpi"]}).count() == 2
    assert select.subject_rows(rows, words, "economy", "").count() == 0


def test_comparison_has_range_and_correlation(series):
    a = series([1, 2, 3, 4, 5])
    fact = a.unionByName(series([2, 4, 6, 8, 1], indicator="wpi"))
    out = compare.comparison(fact, "cpi", "wpi", "Pakistan", end="2000-04")
    row = out["correlation"].first()
    assert out["status"] == "available" and out["rows"].count() == 4
    assert (row.n, row.pearson, row.pearson_p) == (4, pytest.approx(1.0), pytest.approx(0.0, abs=1e-6))


def test_lags_exclude_the_target(series):
    x = list(range(1, 31))
    row = W.lag_features(series(x), 12).orderBy("period").first()
    assert row.lag_1 == x[11] and row.lag_12 == x[0] and row.rolling_mean == pytest.approx(np.mean(x[:12]))
    assert row.month_sin == pytest.approx(np.sin(2 * np.pi / 12))


def test_kpi_and_sparkline(series):
    row = W.kpi(series([0, 5])).first()
    assert (row.delta, row.delta_kind) == (0.0, "percent")
    assert W.kpi(series([-2, 5])).first().delta == pytest.approx(350)
    assert W.kpi(series([40, 45.5], unit="percent_gdp")).first().delta == pytest.approx(5.5)
    assert W.kpi(series([7])).first().delta is None
    pts = W.sparkline(series([5] * 20)).orderBy("period").collect()
    assert len(pts) == 16 and pts[0].x == 0 and pts[-1].x == 110 and {p.y for p in pts} == {30}


def test_densify_only_adds_nulls(spark, series):
    s = series([1, 2, 3, 4]).filter("period <> '2000-03-01'")
    assert values(W.densify(s)) == [1, 2, None, 4]
    yearly = series([1], start=(2000, 1)).unionByName(series([3], start=(2002, 1)))
    assert values(W.densify(yearly)) == [1, None, 3]


def test_gaps_and_homogeneity(series):
    s = series([1, 2, 3, 4])
    holed = s.filter("period <> '2000-02-01'")
    assert [r.complete for r in coverage.calendar_gaps(holed).collect()] == [False]
    assert [str(r.period) for r in coverage.missing_months(holed).collect()] == ["2000-02-01"]
    keys = ["indicator", "geography"]
    reason = lambda df: coverage.homogeneity(df, keys).first().reason
    assert reason(s) is None
    assert reason(s.withColumn("frequency", F.lit("annual"))) == "not_monthly"
    assert reason(s.unionByName(series([1], unit="x", start=(2010, 1)))) == "mixed_source_or_unit"
    assert reason(s.withColumn("period", F.lit(dt.date(2000, 1, 5)))) == "duplicate_periods"


def test_positions_are_exact_under_skew(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double")).alias("v"),
        F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("g"), "id",
    )
    got = ranking.positions_by(df, ["g"], [F.col("v"), F.col("id")], ranges=16).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values(["v", "id"])
        assert part.position.tolist() == list(range(1, len(part) + 1))


def test_correlations_follow_pandas(spark, series):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=40), 1)
    b = a + rng.normal(size=40)
    fact = series(a.tolist(), indicator="a").unionByName(series(b.tolist(), indicator="b"))
    pairs = compare.matched_pairs(fact, "a", "b", "Pakistan")
    row = compare.with_p_values(compare.correlations(pairs, ["geography"])).first()
    assert row.n == 40
    assert row.pearson == pytest.approx(pd.Series(a).corr(pd.Series(b)))
    ranks = pd.Series(a).rank(), pd.Series(b).rank()
    assert row.spearman == pytest.approx(ranks[0].corr(ranks[1]))
    assert 0 < row.pearson_p < 1e-3


def test_correlation_guards(series):
    fact = series([1, 1, 1], indicator="a").unionByName(series([1, 2, 3], indicator="b"))
    row = compare.correlations(compare.matched_pairs(fact, "a", "b"), ["geography"]).first()
    assert row.pearson is None and row.n == 3
    mixed = fact.unionByName(series([9], indicator="a", dataset="other", start=(2010, 1)))
    with pytest.raises(ContractError, match="several sources"):
        compare.compare(mixed, "a", "b", "Pakistan")
    annual = series([1, 2, 3], indicator="a", frequency="annual").unionByName(series([1, 2, 3], indicator="b"))
    with pytest.raises(ContractError, match="different frequencies"):
        compare.compare(annual, "a", "b", "Pakistan")


def test_matrices_with_missing_cells(spark):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame(rng.normal(size=(60, 4)).round(1), columns=list("abcd"))
    frame.loc[5:30, "b"] = np.nan
    frame.loc[::2, "d"] = np.nan
    frame.loc[:49, "c"] = np.nan
    frame.insert(0, "period", pd.date_range("2000-01-01", periods=60, freq="MS").date)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(),
                               "period date, a double, b double, c double, d double")
    columns = list("abcd")
    numeric = frame[columns].astype(float)
    for method, fn in (("pearson", compare.pearson_matrix), ("spearman", compare.spearman_matrix)):
        expected = numeric.corr(method="pearson", min_periods=12) if method == "pearson" else None
        for r in fn(df, [], columns).collect():
            both = numeric[[r.indicator_a, r.indicator_b]].dropna()
            assert r.n == len(both)
            if method == "spearman":
                both = both.rank()
            want = both.iloc[:, 0].corr(both.iloc[:, 1]) if len(both) >= 12 else None
            assert (r.coefficient is None) if want is None else r.coefficient == pytest.approx(want)
            if expected is not None and want is not None:
                assert want == pytest.approx(expected.loc[r.indicator_a, r.indicator_b])
    # Pairs that are complete on the same rows share their ranks: a row without gaps is copied once per column.
    pairs_of, entries = compare._shared_rows(["1111", "1101", "0110"], [(0, 1), (0, 3), (1, 3), (1, 2)])
    assert pairs_of == {0: [(0, 1), (0, 3), (1, 3)], 1: [(1, 2)]}
    assert entries == {"1111": [(0, 0), (1, 0), (1, 1), (2, 1), (3, 0)], "1101": [(0, 0), (1, 0), (3, 0)], "0110": [(1, 1), (2, 1)]}
    key = lambda rows: sorted((r.indicator_a, r.indicator_b, r.n, r.coefficient and round(r.coefficient, 12)) for r in rows)
    shared = key(compare.spearman_matrix(df, [], columns).collect())
    patterns = compare.MAX_PATTERNS
    try:
        compare.MAX_PATTERNS = 1
        assert key(compare.spearman_matrix(df, [], columns).collect()) == shared
    finally:
        compare.MAX_PATTERNS = patterns


def test_student_t_reference_points():
    from statweave.functions.distributions import t_quantile, two_sided_p

    # Table values of Student's t.
    assert t_quantile(0.95, 2) == pytest.approx(4.302652729911275, rel=1e-9)
    assert t_quantile(0.95, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert two_sided_p(2.0, 1) == pytest.approx(0.295167235300867, rel=1e-9)
    assert two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert two_sided_p(2.5758293035489004, 1e7) == pytest.approx(0.01, rel=1e-5)


def test_interval_and_difference(spark):
    df = spark.createDataFrame([("g", 1.0, True), ("g", 2.0, True), ("g", 3.0, True), ("g", 4.0, False), ("g", 5.0, False),
                                ("g", 6.5, False), ("g", float("inf"), False), ("c", 2.0, True), ("c", 2.0, True), ("c", 2.0, True)],
                               "g string, value double, a boolean")
    rows = {r.g: r for r in compare.mean_interval(df.filter("a"), ["g"], independent=True).collect()}
    assert rows["g"].mean == 2 and rows["g"].upper == pytest.approx(2 + 4.302652729911275 / 3**0.5)
    assert (rows["c"].lower, rows["c"].upper) == (2.0, 2.0)
    assert compare.mean_interval(df, ["g"]).first().reason == "independence_not_declared"
    t = compare.with_test_p(compare.difference_test(df.filter("g = 'g'"), ["g"], F.col("a"), independent=True)).first()
    va, vb = np.var([1, 2, 3], ddof=1) / 3, np.var([4, 5, 6.5], ddof=1) / 3
    assert t.statistic == pytest.approx((2 - 15.5 / 3) / np.sqrt(va + vb)) and t.n_b == 3
    assert 0 < t.p_value < 0.05
    few = compare.difference_test(df.filter("g = 'c'"), ["g"], F.col("a"), independent=True).first()
    assert few.reason == "too_few_observations"


def test_error_metrics(spark):
    e = lambda rows: compare.forecast_errors(spark.createDataFrame(rows, "actual double, predicted double"), []).first()
    assert e([(0.0, 1.0), (2.0, 1.0)]).mape_percent == 50
    zero = e([(0.0, 1.0), (0.0, 2.0)])
    assert zero.mape_percent is None and zero.mape_eligible_rows == 0 and zero.mae == 1.5


def test_reconciliation_reports_breaks(spark):
    child = spark.createDataFrame([("a", 2023, 1.0), ("b", 2023, 2.0), ("c", 2023, 5.0)], "geography string, y int, value double")
    parent = spark.createDataFrame([("P", 2023, 3.0), ("Q", 2023, 4.0), ("R", 2023, 1.0)], "geography string, y int, value double")
    link = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "Q")], "geography string, parent string")
    got = {r.parent: r.reconciled for r in reconcile.hierarchy_violations(child, parent, link, ["y"]).collect()}
    assert got == {"P": True, "Q": False, "R": False}


def test_breakdown_rest(series):
    fact = series([30, 40], indicator="x").unionByName(series([20], indicator="y"))
    got = {r.part: r.value for r in reconcile.breakdown(fact, {"x": "X", "y": "Y"}, ["geography"]).collect()}
    assert got == {"X": 30, "Y": 20, "Other": 50}
    full = series([60], indicator="x").unionByName(series([39.6], indicator="y"))
    assert reconcile.breakdown(full, {"x": "X", "y": "Y"}, ["geography"]).count() == 2


def test_topics_use_like_semantics(spark):
    df = spark.createDataFrame([("WorldBankXhealth", "a"), ("d", "fuel_imports_share"), ("d", "b")], "dataset string, indicator string")
    assert df.filter(select.topic_predicate("health")).count() == 1
    assert df.filter(select.topic_predicate("trade")).count() == 1


def test_search_is_case_insensitive(spark):
    df = spark.createDataFrame([("Census", 1), ("Prices", 2)], "title string, n int")
    assert select.search(df, "cENs").count() == 1 and select.search(df, "").count() == 2
