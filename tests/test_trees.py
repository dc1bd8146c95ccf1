"""Forest and boosting of single series against plain recursive versions."""

import numpy as np
import pytest

from statweave.plans import panel, trees
from statweave.schema import SERIES


def history(n, seed, plateau=False):
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    x = 100 + 0.3 * i + 8 * np.sin(i * np.pi / 6) + rng.normal(0, 3, n)
    return np.round(x / 5) * 5 if plateau else np.round(x, 2)


# ------------------------------------------------------------------ plain versions


def best_cut(x, y, w, least):
    """The first feature and threshold whose gain is the largest, up to a billionth of the node's sum of squares."""
    found = []
    whole, total = w.sum(), (w * y).sum()
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            nl, nr = w[left].sum(), w[~left].sum()
            if nl >= least and nr >= least:
                sl = (w * y)[left].sum()
                found.append((sl**2 / nl + (total - sl) ** 2 / nr - total**2 / whole, f, cut))
    noise = trees.TIE * (w * y * y).sum()
    if not found or max(found)[0] <= noise:
        return None
    top = max(g for g, _, _ in found)
    return next((top, f, cut) for g, f, cut in found if g >= top - noise)


def plain_tree(x, y, w, depth):
    keep = w > 0
    x, y, w = x[keep], y[keep], w[keep]
    cut = best_cut(x, y, w, 1) if depth else None
    if cut is None:
        mean = (w * y).sum() / w.sum()
        return lambda q: mean
    _, f, at = cut
    left = x[:, f] <= at
    a, b = (plain_tree(x[m], y[m], w[m], depth - 1) for m in (left, ~left))
    return lambda q: a(q) if q[f] <= at else b(q)


def plain_forest(x, y, weights, depth):
    centre = y.mean()
    grown = [plain_tree(x, y - centre, w, depth) for w in weights]
    return lambda q: centre + np.mean([t(q) for t in grown])


def plain_boosting(x, y, leaves, rounds, rate=0.1, least=20):
    start = y.mean()
    guess, grown = np.full(len(y), start), []
    for _ in range(rounds):
        r = y - guess
        tree = [(np.ones(len(y), bool), lambda q: True)]
        while len(tree) < leaves:
            cuts = [best_cut(x[m], r[m], np.ones(m.sum()), least) for m, _ in tree]
            if not any(cuts):
                break
            gains = [c[0] if c else -np.inf for c in cuts]
            k = int(np.argmax(gains))
            (_, f, at), (rows, test) = cuts[k], tree[k]
            left = x[:, f] <= at
            tree[k] = (rows & left, lambda q, t=test, f=f, at=at: t(q) and q[f] <= at)
            tree.append((rows & ~left, lambda q, t=test, f=f, at=at: t(q) and q[f] > at))
        parts = [(test, rate * r[rows].mean()) for rows, test in tree]
        for rows, _ in tree:
            guess[rows] += rate * r[rows].mean()
        grown.append(parts)
    return lambda q: start + sum(v for parts in grown for test, v in parts if test(q))


# ------------------------------------------------------------------ the fast ones


@pytest.mark.parametrize("depth", [1, 3, 6])
@pytest.mark.parametrize("plateau", [False, True])
def test_forest_equals_plain_trees(depth, plateau):
    x, y = trees.lag_table(history(72, 5, plateau), 4, 12)
    weights = trees.bootstrap(len(y), 7, 42)
    assert (weights.sum(1) == len(y)).all()
    got = trees.grow_forest(x[:50], y[:50], weights[:, :50], depth).predict(x)
    plain = plain_forest(x[:50], y[:50], weights[:, :50], depth)
    assert got == pytest.approx([plain(q) for q in x], rel=1e-9)


def test_forest_in_parts_is_the_same(monkeypatch):
    x, y = trees.lag_table(history(72, 6), 1, 12)
    weights = trees.bootstrap(len(y), 9, 1)
    whole = trees.grow_forest(x, y, weights, 4).predict(x)
    monkeypatch.setattr(trees, "CELLS", x.size * 2)
    assert trees.grow_forest(x, y, weights, 4).predict(x) == pytest.approx(whole, rel=1e-12)


def test_forest_of_a_constant():
    x = np.ones((5, 3))
    assert trees.grow_forest(x, np.full(5, 7.0), trees.bootstrap(5, 3, 0), 3).predict(x).tolist() == [7.0] * 5


@pytest.mark.parametrize("plateau", [False, True])
def test_boosting_side_by_side_equals_plain_boosting(plateau):
    jobs = [(*trees.lag_table(history(n, n, plateau), 2, 12), leaves) for n, leaves in ((60, 7), (140, 7), (140, 15), (96, 15))]
    model = trees.boost([x for x, _, _ in jobs], [y for _, y, _ in jobs], [n for _, _, n in jobs], rounds=12)
    for j, (x, y, leaves) in enumerate(jobs):
        plain = plain_boosting(x, y, leaves, 12)
        padded = np.zeros((len(jobs), len(x), x.shape[1]))
        padded[j] = x
        assert model.predict(padded)[j] == pytest.approx([plain(q) for q in x], rel=1e-9)


def test_boosting_in_parts_and_few_rows(monkeypatch):
    xs, ys = zip(*(trees.lag_table(history(n, n), 1, 12) for n in (30, 100, 80)))
    one = trees.boost(list(xs), list(ys), [7, 7, 15], rounds=5)
    assert (one.leaf[0] == -1).all()  # too few rows for two leaves of twenty
    monkeypatch.setattr(trees, "CELLS", 1)
    parts = trees.boost(list(xs), list(ys), [7, 7, 15], rounds=5)
    assert (one.leaf == parts.leaf).all() and one.value == pytest.approx(parts.value)


def test_bins_of_many_values():
    values = np.arange(1000.0)
    assert len(trees.bin_edges(values, 255)) == 254
    assert trees.bin_edges(np.array([1.0, 3, 3, 7]), 255).tolist() == [2.0, 5.0]


def test_report_equals_plain_models(series):
    values = history(84, 3)
    fact = series(values.tolist(), start=(2000, 3))
    report = panel.forecast(fact, models=("random_forest", "gradient_boosting"), rounds=6).first()
    found = {m.model: m for m in report.metrics}

    def plain(kind, x, y, parameter):
        if kind == "random_forest":
            return plain_forest(x, y, trees.bootstrap(len(y), 6, 42), parameter)
        return plain_boosting(x, y, parameter, 6)

    train = values[:-12]
    x, y = trees.lag_table(train, 3, 12)
    for kind, grid in (("random_forest", (3, 6)), ("gradient_boosting", (7, 15))):
        scores = []
        for parameter in grid:
            errors = []
            for a, b in trees.fold_ends(len(y), 3):
                model = plain(kind, x[:a], y[:a], parameter)
                errors.append(np.mean([abs(t - model(q)) for q, t in zip(x[a:b], y[a:b])]))
            scores.append(np.mean(errors))
        best = grid[int(np.argmin(scores))]
        assert (found[kind].parameter, found[kind].cv_one_step_mae) == (best, pytest.approx(min(scores), rel=1e-9))
        model, known = plain(kind, x, y, best), list(train)
        for step in range(12):
            month = (2 + len(known)) % 12 + 1
            tail = np.array(known[-12:])
            known.append(model([*tail[::-1], tail.mean(), np.sin(2 * np.pi * month / 12), np.cos(2 * np.pi * month / 12)]))
        assert found[kind].metrics.mae == pytest.approx(np.abs(values[-12:] - known[-12:]).mean(), rel=1e-9)


def test_series_do_not_share_a_model(series):
    one, other = history(72, 1), history(75, 2) * 50
    both = series(one.tolist()).union(series(other.tolist(), geography="Elsewhere"))
    kinds = ("random_forest", "gradient_boosting")
    alone = panel.forecast(series(one.tolist()), models=kinds, rounds=5).first()
    together = {r.geography: r for r in panel.forecast(both, models=kinds, rounds=5).collect()}
    assert together["Pakistan"].metrics == alone.metrics and together["Pakistan"].forecast == alone.forecast
    assert set(SERIES) <= set(alone.asDict()) and together["Elsewhere"].metrics != alone.metrics


def test_smaller_depths_are_cut_from_the_deepest_trees(monkeypatch):
    x, y = trees.lag_table(history(72, 8, True), 4, 12)
    weights = trees.bootstrap(len(y), 20, 3)
    deep = trees.grow_forest(x, y, weights, 6)
    assert deep.cut(3).predict(x) == pytest.approx(trees.grow_forest(x, y, weights, 3).predict(x), rel=1e-12)
    grown, grow = [], trees.grow_forest
    monkeypatch.setattr(trees, "grow_forest", lambda *a: grown.append(a[3]) or grow(*a))
    trees.forest_forecasts([(history(84, 2), 1)], 12, 12, 6, 3, (3, 6), 5, 42)
    assert grown[:3] == [6, 6, 6] and len(grown) == 5  # one forest per fold, one per path


def test_boosting_fits_once_what_the_rows_cannot_tell_apart(monkeypatch):
    fitted, boost = [], trees.boost
    monkeypatch.setattr(trees, "boost", lambda *a: fitted.append(len(a[0])) or boost(*a))
    short, long = history(84, 2), history(300, 4)
    one, other = trees.boosting_forecasts([(short, 1), (long, 1)], 12, 12, 6, 3, (7, 15), 5)
    # Only the last fold of the long series (69, 138 and 207 rows) can have more than seven leaves of twenty rows.
    assert fitted[0] == 3 + 4
    assert one[3] == 7  # the first of equal sizes
    alone = trees.boosting_forecasts([(long, 1)], 12, 12, 6, 3, (7, 15), 5)[0]
    assert other[0] == pytest.approx(alone[0], rel=1e-12) and other[3] == alone[3]


def test_boosting_without_a_possible_split_is_the_mean():
    x, y = trees.lag_table(history(60, 9), 1, 12)
    few, many = (x[:30], y[:30]), (x, y)
    model = trees.boost([few[0], many[0]], [few[1], many[1]], [15, 15], rounds=5)
    assert model.leaf.shape[2] <= 2 and (model.leaf[0] == -1).all() and (model.leaf[1] >= 0).any()
    padded = np.zeros((2, len(x), x.shape[1]))
    padded[0] = padded[1] = x
    assert model.predict(padded)[0] == pytest.approx(np.full(len(x), few[1].mean()))


# ------------------------------------------------------------------ the kernel in the JVM


GROUP = [(history(n, n), 1 + n % 12) for n in (60, 61, 84, 140, 330)]  # the last one has more distinct values than bins


def fitted(spark, kind, rounds, group):
    base = spark.createDataFrame([(k, v.tolist(), m) for k, (v, m) in enumerate(group)], "k int, values array<double>, first_month int")
    out = panel.tree_forecasts(base, [kind], 12, 12, 6, rounds)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    rows = {r.k: r for r in out.collect()}
    assert {r.model for r in rows.values()} == {kind} and len(rows) == len(group)
    return [(rows[k].held, rows[k].ahead, rows[k].cv_one_step_mae, rows[k].parameter) for k in range(len(group))]


def same(found, wanted):
    for got, want in zip(found, wanted, strict=True):
        assert got[0] == pytest.approx(want[0], rel=1e-9) and got[1] == pytest.approx(want[1], rel=1e-9)
        assert got[2] == pytest.approx(want[2], rel=1e-9) and got[3] == want[3]


def test_forest_runs_in_the_jvm_and_equals_python(spark):
    group = [*GROUP, (np.full(72, 5.0), 3), (np.arange(72.0), 12)]
    same(fitted(spark, "random_forest", 25, group), trees.forest_forecasts(group, 12, 12, 6, 3, panel.FOREST_DEPTHS, 25, 42))


def test_boosting_runs_in_the_jvm_and_equals_python(spark):
    group = [*GROUP, (history(72, 5, True), 3), (np.full(72, 5.0), 3)]
    same(fitted(spark, "gradient_boosting", 25, group), trees.boosting_forecasts(group, 12, 12, 6, 3, panel.BOOSTING_LEAVES, 25))


def test_trees_need_no_feature_rows(series, monkeypatch):
    monkeypatch.setattr(panel, "feature_rows", lambda *a, **k: pytest.fail("feature rows are for ridge"))
    report = panel.forecast(series(history(72, 1).tolist()), models=("gradient_boosting",), rounds=2).first()
    assert report.status == "trained" and {m.model for m in report.metrics} == {"seasonal_naive", "gradient_boosting"}


def test_ridge_errors_are_compiled(spark, series):
    """Methods beyond 8,000 bytes of code are never compiled by the JVM."""
    rows = panel.feature_rows(panel.rows_of(panel.ready_history(series(history(72, 1).tolist()))))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    fits = panel.ridge_coefficients(panel.moments(rows, SERIES), SERIES)
    fits = spark.createDataFrame(fits.collect(), fits.schema)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = panel.ridge_cv(rows, fits, SERIES)._jdf.queryExecution()
        text = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(part.split(";")[0]) for part in text.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) <= 8000
