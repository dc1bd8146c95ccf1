"""Correlations of all pairs from merged sums of products."""

import math

import numpy as np
import pytest

from statweave.operators import compare, moments


def plain(rows, groups, columns, minimum):
    out = {}
    for g in {r[0] for r in rows} if groups else {None}:
        own = [r[1:] for r in rows if not groups or r[0] == g]
        for i in range(len(columns)):
            for j in range(i + 1, len(columns)):
                both = np.array([(r[i], r[j]) for r in own if r[i] is not None and r[j] is not None]).reshape(-1, 2)
                r = None
                if len(both) >= minimum and both[:, 0].min() < both[:, 0].max() and both[:, 1].min() < both[:, 1].max():
                    r = np.corrcoef(both.T)[0, 1] if np.isfinite(both).all() else math.nan
                out[g, columns[i], columns[j]] = (len(both), r)
    return out


def compare_with_plain(spark, rows, columns, groups, minimum=5, parts=6):
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in columns)).repartition(parts)
    got = compare.pearson_matrix(df, groups, columns, minimum).collect()
    want = plain(rows, groups, columns, minimum)
    assert len(got) == len(want)
    for r in got:
        n, c = want[r.g if groups else None, r.indicator_a, r.indicator_b]
        assert r.n == n
        assert (r.coefficient is None) if c is None else r.coefficient == pytest.approx(c, abs=1e-9, nan_ok=True)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_matrices_equal_a_plain_count(spark, monkeypatch, groups):
    monkeypatch.setattr(moments, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(4)
    columns = ["a", "b", "c", "flat", "rare", "far"]
    rows = []
    for k in range(400):
        x = rng.normal(size=3)
        values = [x[0], x[0] + x[1], x[2], 0.1, x[1] if k % 90 == 0 else None, 1e9 + x[0]]
        rows.append((rng.choice(["p", "q", "r", None]), *(None if rng.random() < 0.2 else (None if v is None else float(v)) for v in values)))
    rows = [(None if r[0] is None or r[0] == "None" else str(r[0]), *r[1:]) for r in rows]
    df_rows = [r for r in rows]
    want = plain(df_rows, groups, columns, 5)
    df = spark.createDataFrame(df_rows, "g string, " + ", ".join(f"{c} double" for c in columns)).repartition(6)
    got = compare.pearson_matrix(df, groups, columns, 5).collect()
    assert len(got) == len(want)
    for r in got:
        n, c = want[r.g if groups else None, r.indicator_a, r.indicator_b]
        assert r.n == n
        assert (r.coefficient is None) if c is None else r.coefficient == pytest.approx(c, abs=1e-6)


def test_values_that_are_no_numbers_spoil_only_their_pairs(spark):
    rows = [("g", float(k), float(k * k), float(-k), None if k == 3 else float(k)) for k in range(10)]
    rows[3] = ("g", math.inf, 9.0, -3.0, None)
    compare_with_plain(spark, rows, ["a", "b", "c", "d"], ["g"])


def test_many_indicators_take_one_pass(spark):
    rng = np.random.default_rng(1)
    columns = [f"i{k}" for k in range(120)]
    values = rng.normal(size=(60, 120))
    df = spark.createDataFrame([("g", *map(float, v)) for v in values], "g string, " + ", ".join(f"{c} double" for c in columns))
    found = compare.pearson_matrix(df, ["g"], columns, 5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    got = {(r.indicator_a, r.indicator_b): r.coefficient for r in found.collect()}
    r = np.corrcoef(values.T)
    assert len(got) == 120 * 119 // 2
    assert all(got[f"i{i}", f"i{j}"] == pytest.approx(r[i, j], abs=1e-9) for i in range(120) for j in range(i + 1, 120))


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, a double, b double")
    assert compare.pearson_matrix(df, ["g"], ["a", "b"], 3).count() == 0
