"""Forecasts for every monthly series of a fact at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import jvm
from ..operators.series import along, lag_features, positions
from ..schema import SERIES
from ..session import materialized
from . import trees

SEASON, HOLDOUT, HORIZON, FOLDS = 12, 12, 6, 3

# The grids searched per model.
RIDGE_ALPHAS = (1.0, 10.0, 100.0)
FOREST_DEPTHS = (3, 6)
BOOSTING_LEAVES = (7, 15)
SERIES_PER_TASK, MANY_TASKS, SERIES_GROUP = (8, 1024), 256, 64  # series that a task fits (few, and once there are many tasks); that Python's boosting fits side by side
SOLVED_SERIES = 256  # series whose ridge is solved at a time
LIMITATIONS = [
    "Every model knows one series and its calendar, nothing else; a break in the series is not foreseen.",
    "The winner is the model with the smallest error over the last held-out months, so that error is a low estimate of later ones.",
    "The errors over the folds look one month ahead; those over the held-out months feed each forecast into the next one and are larger by nature.",
]
MODEL_ORDER = ["seasonal_naive", "ridge", "random_forest", "gradient_boosting"]


def profile(fact: DataFrame, season: int = SEASON, holdout: int = HOLDOUT, keys: list[str] = SERIES) -> DataFrame:
    """Status and ordered values of every series from a single aggregation.

    ``ready`` or ``blocked``; the first failed requirement is the reason.  The calendar
    bounds the arrays (see ``schema``).
    """
    month = lambda p: F.year(p) * 12 + F.month(p)
    gathered = fact.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("period", "value"))).alias("h"))
    n, p = F.size("h"), F.col("h.period")
    impossible = lambda x: x["value"].isNull() | F.isnan(x["value"]) | (F.abs(x["value"]) == float("inf"))
    reason = (
        F.when(F.size(F.array_distinct(p)) != n, "duplicate_periods")
        .when(F.exists("h", impossible), "missing_or_nonfinite")
        .when(F.exists(p, lambda x: F.dayofmonth(x) != 1) | (month(F.array_max(p)) - month(F.array_min(p)) + 1 != n), "not_contiguous_months")
        .when(n < season * 4 + holdout, "too_short")
    )
    return gathered.select(
        *keys, n.cast("long").alias("observations"), F.when(reason.isNull(), "ready").otherwise("blocked").alias("status"), reason.alias("reason"),
        p.alias("periods"), F.col("h.value").alias("values"),
    )


def eligibility(fact: DataFrame, season: int = SEASON, holdout: int = HOLDOUT, keys: list[str] = SERIES) -> DataFrame:
    """``ready`` or ``blocked`` per series, with the reason."""
    return profile(fact, season, holdout, keys).drop("periods", "values")


def rows_of(series: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Observations back from ordered arrays."""
    pairs = F.arrays_zip("periods", "values")
    return series.select(*keys, F.explode(pairs).alias("o")).select(*keys, F.col("o.periods").alias("period"), F.col("o.values").alias("value"))


def ready_series(fact: DataFrame, keys: list[str] = SERIES, **options) -> DataFrame:
    return rows_of(profile(fact, keys=keys, **options).filter("status = 'ready'"), keys)


def history(fact: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """One row per series with its ordered values, whatever its status."""
    return profile(fact, keys=keys).select(*keys, "periods", "values")


def ready_history(fact: DataFrame, keys: list[str] = SERIES, **options) -> DataFrame:
    """One row per series that meets all requirements, with its ordered values."""
    return profile(fact, keys=keys, **options).filter("status = 'ready'").select(*keys, "periods", "values")


def seasonal_naive(values: Column, steps: int, season: int = SEASON) -> Column:
    """The value one season earlier, repeated beyond the first season."""
    n = F.size(values)
    return F.transform(
        F.sequence(F.lit(1), F.lit(steps)),
        lambda h: F.element_at(values, (n - season + F.pmod(h - 1, F.lit(season)) + 1).cast("int")),
    )


def error_columns(actual: Column, predicted: Column) -> Column:
    """MAE, RMSE, MAPE and its eligible rows of two aligned arrays."""
    pairs = F.zip_with(actual, predicted, lambda a, p: F.struct(a.alias("a"), p.alias("p")))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    n = F.size(actual)
    eligible = F.filter(pairs, lambda r: F.abs(r["a"]) > 1e-10)
    return F.struct(
        (total(F.transform(pairs, lambda r: F.abs(r["a"] - r["p"]))) / n).alias("mae"),
        F.sqrt(total(F.transform(pairs, lambda r: (r["a"] - r["p"]) * (r["a"] - r["p"]))) / n).alias("rmse"),
        F.when(
            F.size(eligible) > 0,
            total(F.transform(eligible, lambda r: F.abs((r["a"] - r["p"]) / r["a"]))) / F.size(eligible) * 100.0,
        ).alias("mape_percent"),
        F.size(eligible).cast("long").alias("mape_eligible_rows"),
    )


# ------------------------------------------------------------------ features and folds


def features(season: int = SEASON) -> list[str]:
    return [*[f"lag_{i}" for i in range(1, season + 1)], "rolling_mean", "month_sin", "month_cos"]


def scaled(fact: DataFrame, holdout: int = HOLDOUT, keys: list[str] = SERIES) -> DataFrame:
    """Each series centred and scaled by its training part (``center``, ``spread``)."""
    rows = positions(fact, keys)
    everything = along(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    train = F.when(F.col("row") <= F.col("rows") - holdout, F.col("value"))
    spread = F.stddev_pop(train).over(everything)
    return rows.withColumns(
        {"center": F.avg(train).over(everything), "spread": F.when(spread > 0, spread).otherwise(1.0)}
    ).withColumn("value", (F.col("value") - F.col("center")) / F.col("spread"))


def with_blocks(rows: DataFrame, season: int = SEASON, holdout: int = HOLDOUT, folds: int = FOLDS) -> DataFrame:
    """``block`` of each feature row for expanding cross-validation.

    Fold i trains on blocks 0..i and validates on block i+1; blocks 1..folds have
    floor(m/(folds+1)) of the m training rows; block folds+1 is the holdout.
    """
    m = F.col("rows") - holdout - season
    size = F.floor(m / (folds + 1))
    index = F.col("row") - season - 1
    block = F.when(index >= m, F.lit(folds + 1)).when(index < m - folds * size, F.lit(0)).otherwise(
        F.lit(folds) - F.floor((m - 1 - index) / size)
    )
    return rows.withColumn("block", block.cast("int"))


def feature_rows(fact: DataFrame, season: int = SEASON, holdout: int = HOLDOUT, keys: list[str] = SERIES) -> DataFrame:
    """Scaled lag features with their fold block."""
    return with_blocks(lag_features(scaled(fact, holdout, keys), season, keys), season, holdout)


# ------------------------------------------------------------------ ridge from sums of products


def _terms(season: int) -> list[str]:
    return ["1D", *features(season), "value"]


def moments(rows: DataFrame, keys: list[str], season: int = SEASON) -> DataFrame:
    """Sums of products of (1, features, target) per series and block.

    Everything ridge needs from the data is in these sums; they combine on the map
    side and do not depend on the length of a series.
    """
    t = _terms(season)
    products = ", ".join(f"sum({t[i]} * {t[j]})" for i in range(len(t)) for j in range(i, len(t)))
    return rows.groupBy(*keys, "block").agg(F.expr(f"array({products})").alias("sums"))


def _solve(blocks: np.ndarray, alphas: tuple[float, ...], size: int) -> np.ndarray:
    """Ridge on standardised features (population deviation, free intercept) from summed moments.

    ``blocks``: (sets, size*(size+1)/2) -> coefficients (sets, alphas, size-1), intercept first.
    """
    upper = np.triu_indices(size)
    gram = np.zeros((len(blocks), size, size))
    gram[:, upper[0], upper[1]] = blocks
    gram = gram + np.transpose(np.triu(gram, 1), (0, 2, 1))
    n = gram[:, 0, 0][:, None, None]
    mean = gram[:, 0, 1:] / n[:, 0]
    cov = gram[:, 1:, 1:] - n * mean[:, :, None] * mean[:, None, :]
    xx, xy = cov[:, :-1, :-1], cov[:, :-1, -1]
    deviation = np.sqrt(np.clip(np.einsum("sii->si", xx), 0, None) / n[:, 0])
    deviation[deviation < 1e-12] = 1.0
    zz = xx / deviation[:, :, None] / deviation[:, None, :]
    zy = xy / deviation
    out = np.empty((len(blocks), len(alphas), size - 1))
    for k, alpha in enumerate(alphas):
        beta = np.linalg.solve(zz + alpha * np.eye(size - 2), zy[:, :, None])[:, :, 0] / deviation
        out[:, k, 1:] = beta
        out[:, k, 0] = mean[:, -1] - np.einsum("si,si->s", beta, mean[:, :-1])
    return out


def _solved(batches, keys: list[str], alphas: tuple[float, ...], size: int):
    """The coefficients of every row of sums per block, for SOLVED_SERIES rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), SOLVED_SERIES):
            rows = batch.slice(at, SOLVED_SERIES)
            stacked = rows.column("sums").flatten().flatten().to_numpy().reshape(len(rows), -1, size * (size + 1) // 2)
            flat = _solve(np.cumsum(stacked, axis=1).reshape(-1, stacked.shape[2]), alphas, size)
            made = pa.array(flat.ravel())
            for width in (size - 1, len(alphas), stacked.shape[1]):
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(made) + 1, width), pa.int32()), made)
            yield pa.record_batch([*[rows.column(k) for k in keys], made], names=[*keys, "fits"])


def ridge_coefficients(sums: DataFrame, keys: list[str], season: int = SEASON, alphas: tuple[float, ...] = RIDGE_ALPHAS,
                       folds: int = FOLDS) -> DataFrame:
    """Coefficients per series: ``fits[s][a]`` for training sets s = blocks 0..s and alpha a.

    Set ``folds`` is the whole training part, set ``folds+1`` the whole history.  The sums stay in Arrow and are solved for
    SOLVED_SERIES series at a time, which bounds a task's memory whatever its share of the series.
    """
    size = len(_terms(season))

    ordered = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "sums"))).alias("b")).select(*keys, F.col("b.sums").alias("sums"))
    schema = T.StructType([*ordered.select(*keys).schema.fields, T.StructField("fits", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
    return ordered.mapInArrow(lambda batches: _solved(batches, keys, alphas, size), schema)


def ridge_cv(rows: DataFrame, fits: DataFrame, keys: list[str], season: int = SEASON, folds: int = FOLDS,
             alphas: tuple[float, ...] = RIDGE_ALPHAS) -> DataFrame:
    """Best alpha per series by the mean over folds of the one-step MAE; the first wins ties.

    Terms are kept in an array: written out for every alpha they make a method too large for the JVM to compile.
    """
    terms = rows.filter(F.col("block").between(1, folds)).select(
        *keys, "block", "value", "spread", F.array(F.lit(1.0), *features(season)).alias("_x")
    )
    of_block = fits.select(*keys, F.posexplode(F.slice("fits", 1, folds)).alias("_set", "_fit")).withColumn("block", F.col("_set") + 1)
    guess = lambda a: f"aggregate(zip_with(_fit[{a}], _x, (c, x) -> c * x), 0D, (s, v) -> s + v)"
    errors = terms.join(of_block, [*keys, "block"]).select(
        *keys, "block", *[F.expr(f"abs(value - {guess(a)}) * spread").alias(f"e{a}") for a in range(len(alphas))]
    )
    per_fold = errors.groupBy(*keys, "block").agg(*[F.avg(f"e{a}").alias(f"e{a}") for a in range(len(alphas))])
    scored = per_fold.groupBy(*keys).agg(*[F.avg(f"e{a}").alias(f"e{a}") for a in range(len(alphas))])
    best = F.array_min(F.array(*[F.struct(F.col(f"e{a}").alias("mae"), F.lit(a).alias("a")) for a in range(len(alphas))]))
    return scored.select(*keys, best.alias("best")).select(
        *keys, F.col("best.mae").alias("cv_one_step_mae"), F.col("best.a").alias("alpha_index"),
        F.element_at(F.array(*[F.lit(x) for x in alphas]), F.col("best.a") + 1).alias("alpha"),
    )


def roll_forward(values: str, coefficients: str, first_month: str, steps: int, season: int = SEASON) -> Column:
    """Recursive linear forecast inside the JVM: every prediction becomes the next lag.

    ``values`` ends right before the first step; ``first_month`` is that step's month (1-12).
    """
    lags = [f"element_at(acc, -{i})" for i in range(1, season + 1)]
    angle = f"2D * pi() * (pmod({first_month} + k - 2, 12) + 1) / 12D"
    terms = ["1D", *lags, f"(({' + '.join(lags)}) / {season}D)", f"sin({angle})", f"cos({angle})"]
    step = " + ".join(f"{coefficients}[{i}] * {t}" for i, t in enumerate(terms))
    return F.expr(
        f"slice(aggregate(sequence(1, {steps}), slice({values}, -{season}, {season}), "
        f"(acc, k) -> concat(acc, array({step}))), {season + 1}, {steps})"
    )


# ------------------------------------------------------------------ tree models of every series


def tree_forecasts(base: DataFrame, kinds: list[str], season: int, holdout: int, horizon: int, rounds: int, seed: int = 42) -> DataFrame:
    """Every row once per kind, with columns model, held (holdout path), ahead (forecast), cv_one_step_mae and parameter.

    base has one row per series with its ordered values and first_month; the other columns pass through.  Each series has
    models of its own, fitted where the row lies: by the kernel in the JVM, or by its counterpart in ``trees`` where the session has none.
    """
    if not jvm.available(base.sparkSession):
        return _python_tree_forecasts(base, kinds, season, holdout, horizon, rounds, seed)
    circle = np.concatenate(trees.months_on_circle(np.arange(1, 13)))
    array = lambda xs: F.array(*[F.lit(x) for x in xs])

    def fit(kind: str) -> Column:
        name, sizes = {"random_forest": ("RandomForest", FOREST_DEPTHS), "gradient_boosting": ("GradientBoosting", BOOSTING_LEAVES)}[kind]
        call = jvm.function(base.sparkSession, "Trees", name, T.ArrayType(T.DoubleType()))
        settings = (season, holdout, horizon, FOLDS, rounds, seed, trees.LEAST, trees.BINS, *sizes)
        return F.struct(F.lit(kind).alias("model"), call("values", "first_month", array(settings), array(circle.tolist())).alias("made"))

    return base.select(*base.columns, F.explode(F.array(*[fit(k) for k in kinds])).alias("_fit")).select(
        *base.columns, "_fit.model", F.slice("_fit.made", 1, holdout).alias("held"), F.slice("_fit.made", holdout + 1, horizon).alias("ahead"),
        F.element_at("_fit.made", -2).alias("cv_one_step_mae"), F.element_at("_fit.made", -1).alias("parameter"),
    )


def _python_tree_forecasts(base: DataFrame, kinds: list[str], season: int, holdout: int, horizon: int, rounds: int, seed: int) -> DataFrame:
    def fit(group: list[tuple[np.ndarray, int]], kind: str) -> list[tuple]:
        if kind == "random_forest":
            return trees.forest_forecasts(group, season, holdout, horizon, FOLDS, FOREST_DEPTHS, rounds, seed)
        return trees.boosting_forecasts(group, season, holdout, horizon, FOLDS, BOOSTING_LEAVES, rounds)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), SERIES_GROUP):
                rows = batch.slice(at, SERIES_GROUP)
                months = rows.column("first_month").to_pylist()
                group = [(v.values.to_numpy(), m) for v, m in zip(rows.column("values"), months)]
                for kind in kinds:
                    held, ahead, error, parameter = zip(*fit(group, kind))
                    made = [
                        pa.array([kind] * len(rows)), pa.array(list(held), pa.list_(pa.float64())), pa.array(list(ahead), pa.list_(pa.float64())),
                        pa.array(error, pa.float64()), pa.array(parameter, pa.float64()),
                    ]
                    yield pa.record_batch([*rows.columns, *made], names=[*rows.schema.names, "model", "held", "ahead", "cv_one_step_mae", "parameter"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{schema}, model string, held array<double>, ahead array<double>, cv_one_step_mae double, parameter double")


# ------------------------------------------------------------------ the whole forecast


def forecast(
    fact: DataFrame,
    keys: list[str] = SERIES,
    models: tuple[str, ...] = ("ridge", "random_forest", "gradient_boosting"),
    season: int = SEASON,
    holdout: int = HOLDOUT,
    horizon: int = HORIZON,
    rounds: int = 100,
) -> DataFrame:
    """Report per series: holdout metrics of every model, the chosen one and its forecast.

    Every model is fitted per series: ridge from sums of products, the trees where the
    series lies.  The model with the lowest holdout MAE wins (earlier ones on ties) and is
    refitted on the whole history.  Series that fail a requirement appear as blocked.
    """
    # The fact is evaluated once; status, histories and feature rows follow from its series.
    every_series = materialized(profile(fact, season, holdout, keys), "series")
    status = every_series.drop("periods", "values")
    ready = every_series.filter("status = 'ready'").select(*keys, "periods", "values")
    base = ready.withColumns(
        {
            "training_rows": F.size("values") - holdout,
            "actual": F.slice("values", -holdout, holdout),
            "train": F.slice("values", F.lit(1), F.size("values") - holdout),
            "holdout_start": F.element_at("periods", -holdout),
            "last_period": F.element_at("periods", -1),
        }
    )
    unscale = lambda c: F.expr(f"transform({c}, v -> v * spread + center)")
    ids = [*keys, "training_rows", "holdout_start", "last_period"]

    def result(df: DataFrame, name: str, predicted: Column, future: Column, cv: Column, parameter: Column) -> DataFrame:
        return df.select(
            *ids, F.lit(name).alias("model"), F.lit(MODEL_ORDER.index(name)).alias("place"),
            error_columns(F.col("actual"), predicted).alias("metrics"), future.alias("future"),
            cv.cast("double").alias("cv_one_step_mae"), parameter.cast("double").alias("parameter"),
        )

    missing = F.lit(None)
    results = [
        result(base, "seasonal_naive", seasonal_naive(F.col("train"), holdout, season),
               seasonal_naive(F.col("values"), horizon, season), missing, missing)
    ]
    if "ridge" in models:
        rows = materialized(feature_rows(rows_of(ready, keys), season, holdout, keys), "features")
        fits = materialized(ridge_coefficients(moments(rows, keys, season), keys, season), "ridge")
        scale = rows.groupBy(*keys).agg(F.first("center").alias("center"), F.first("spread").alias("spread"))
        chosen = base.join(scale, keys).join(fits, keys).join(ridge_cv(rows, fits, keys, season), keys)
        rolled = chosen.withColumns(
            {
                "train_scaled": F.expr("transform(train, v -> (v - center) / spread)"),
                "all_scaled": F.expr("transform(values, v -> (v - center) / spread)"),
                "month": F.month("holdout_start"),
                "next_month": F.pmod(F.month("last_period"), F.lit(12)) + 1,
            }
        ).withColumns(
            {
                "_holdout": roll_forward("train_scaled", f"fits[{FOLDS}][alpha_index]", "month", holdout, season),
                "_future": roll_forward("all_scaled", f"fits[{FOLDS + 1}][alpha_index]", "next_month", horizon, season),
            }
        )
        results.append(
            result(rolled, "ridge", unscale("_holdout"), unscale("_future"), F.col("cv_one_step_mae"), F.col("alpha"))
        )
    kinds = [k for k in ("random_forest", "gradient_boosting") if k in models]
    if kinds:
        # Little data but long work: the rows are dealt to tasks by their number, not by their bytes.
        n, (few, many) = ready.count(), SERIES_PER_TASK
        tasks = max(1, min(-(-n // few), max(MANY_TASKS, -(-n // many))))
        fitted = base.withColumn("first_month", F.month(F.element_at("periods", 1))).select(*ids, "actual", "values", "first_month").repartition(tasks)
        fitted = materialized(tree_forecasts(fitted, kinds, season, holdout, horizon, rounds), "trees")
        for kind in kinds:
            own = fitted.filter(F.col("model") == kind)
            results.append(result(own, kind, F.col("held"), F.col("ahead"), F.col("cv_one_step_mae"), F.col("parameter")))

    every = reduce(DataFrame.unionByName, results)
    best = every.groupBy(*ids).agg(
        F.min_by(F.struct("model", "future"), F.struct("metrics.mae", "place")).alias("best"),
        F.array_sort(F.collect_list(F.struct("place", "model", "metrics", "cv_one_step_mae", "parameter"))).alias("m"),
    )
    report = best.select(
        *keys,
        F.col("best.model").alias("selected_model"),
        "training_rows",
        F.lit(holdout).alias("holdout_rows"),
        "holdout_start",
        F.transform("m", lambda x: F.struct(x["model"].alias("model"), x["metrics"].alias("metrics"),
                                            x["cv_one_step_mae"].alias("cv_one_step_mae"), x["parameter"].alias("parameter"))).alias("metrics"),
        F.transform(
            F.col("best.future"),
            lambda v, i: F.struct(F.add_months("last_period", (i + 1).cast("int")).alias("period"), v.alias("value")),
        ).alias("forecast"),
        F.array(*[F.lit(x) for x in LIMITATIONS]).alias("limitations"),
    )
    return status.withColumn("status", F.when(F.col("status") == "ready", "trained").otherwise("blocked")).join(
        report, keys, "left"
    )
