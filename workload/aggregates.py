"""Coverage, counters and correlations."""

from pyspark.sql import functions as F

from statweave.functions.distributions import t_two_sided_p
from statweave.operators import catalog, compare, coverage, reconcile
from statweave.functions.distributions import t_two_sided_p
from statweave.operators import series as W
from statweave.functions.distributions import t_two_sided_p
from statweave.operators import validate as V
from statweave.schema import SERIES

from .observations import (
    DICTIONARY, MANIFESTS, OBS, RAW2, SEQUENCE, RAW_URL, WORLD, dictionary, manifests, obs, raw, supplier_nation,
)
from .registry import query

_SERIES = "dataset, indicator, geography, unit, frequency"


@query(
    "indicator_coverage",
    f"""WITH {OBS} SELECT {_SERIES}, CAST(min(period) AS VARCHAR) AS start, CAST(max(period) AS VARCHAR) AS "end",
  count(*) AS observations FROM obs GROUP BY ALL""",
)
def indicator_coverage(spark, d):
    return coverage.indicator_coverage(obs(spark, d))


@query(
    "coverage_table",
    f"""WITH {OBS} SELECT dataset, indicator, geography, frequency, CAST(min(period) AS VARCHAR) AS first_period,
  CAST(max(period) AS VARCHAR) AS last_period, count(*) AS observations FROM obs GROUP BY ALL""",
)
def coverage_table(spark, d):
    return coverage.coverage_table(obs(spark, d))


@query("geography_counts", f"WITH {OBS} SELECT geography, count(*) AS observations FROM obs GROUP BY 1")
def geography_counts(spark, d):
    return coverage.geography_counts(obs(spark, d))


@query(
    "workspace_summary",
    f"""WITH {OBS} SELECT count(*) AS observations, count(DISTINCT indicator) AS indicators, count(DISTINCT dataset) AS datasets,
  count(DISTINCT geography) AS geographies, CAST(min(period) AS VARCHAR) AS start, CAST(max(period) AS VARCHAR) AS "end",
  count(*) FILTER (WHERE geography = '{WORLD}') AS national_observations FROM obs""",
)
def workspace_summary(spark, d):
    return coverage.workspace_summary(obs(spark, d), WORLD)


@query(
    "yearly_means",
    f"""WITH {OBS} SELECT indicator, CAST(year(period) AS INT) AS year, round(avg(value), 5) AS mean_value FROM obs GROUP BY 1, 2""",
)
def yearly_means(spark, d):
    return coverage.yearly_means(obs(spark, d)).withColumn("mean_value", F.round("mean_value", 5))


for _name, _columns in {
    "dim_dataset": "dataset, source_url, dataset_version",
    "dim_indicator": "indicator, unit, frequency",
    "dim_geography": "geography",
}.items():

    @query(_name, f"WITH {OBS} SELECT DISTINCT {_columns} FROM obs")
    def _dimension(spark, d, _name=_name):
        return coverage.dimensions(obs(spark, d))[_name]


@query(
    "dim_date",
    f"""WITH {OBS} SELECT DISTINCT CAST(period AS VARCHAR) AS period, CAST(year(period) AS INT) AS year,
  CAST(month(period) AS INT) AS month FROM obs""",
)
def dim_date(spark, d):
    return coverage.dimensions(obs(spark, d))["dim_date"]


_STAGED = """
staged AS (SELECT 'accepted' AS outcome, count(*) AS copies, sum(blanks) AS blanks,
    first(value ORDER BY s_order, s_line, s_part, s_supp, s_date, s_price) AS value
  FROM typed_v2 WHERE valid GROUP BY dataset, indicator, geography, period, unit, frequency
  UNION ALL SELECT 'rejected', count(*), sum(blanks), NULL FROM typed_v2 WHERE NOT valid)
"""


@query(
    "ingestion_counts",
    f"""WITH {RAW2}, {_STAGED} SELECT *,
  round(100.0::DOUBLE * processed_rows / raw_rows, 2) AS quality_score,
  round(100.0::DOUBLE * missing_values / (raw_rows * 8), 4) AS missing_data_percentage FROM (
  SELECT CAST(sum(copies) AS BIGINT) AS raw_rows, count(*) FILTER (WHERE outcome = 'accepted') AS processed_rows,
  CAST(sum(copies) FILTER (WHERE outcome = 'rejected') AS BIGINT) AS rejected_rows,
  CAST(sum(copies - 1) FILTER (WHERE outcome = 'accepted') AS BIGINT) AS duplicates,
  CAST(sum(blanks) AS BIGINT) AS missing_values, min(value) AS min_value, max(value) AS max_value,
  count(*) FILTER (WHERE abs(value) > 1e15) AS extreme_values FROM staged)""",
)
def ingestion_counts(spark, d):
    return V.ingestion_counts(V.staged(V.typed(raw(spark, d), RAW_URL), SEQUENCE))


@query(
    "source_summary",
    f"""WITH {OBS} SELECT dataset, count(*) AS observations, count(DISTINCT indicator) AS indicators,
  count(DISTINCT geography) AS geographies FROM obs GROUP BY 1""",
)
def source_summary(spark, d):
    return coverage.source_summary(obs(spark, d))


@query(
    "covered_total",
    f"""WITH {OBS} SELECT dataset, indicator, unit, CAST(period AS VARCHAR) AS period,
  CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS covered_value, count(*) AS geographies
  FROM obs WHERE indicator = 'ship_qty' AND dataset = 'shipments_supplier' AND year(period) = 1998 GROUP BY 1, 2, 3, 4""",
)
def covered_total(spark, d):
    rows = obs(spark, d, "shipments_supplier")
    return coverage.covered_total(rows, "ship_qty", "1998", "1998")


@query(
    "domain_counts",
    f"""WITH {OBS}, {DICTIONARY} SELECT domain, count(DISTINCT indicator) AS indicators FROM dictionary
  WHERE indicator IN (SELECT indicator FROM obs) GROUP BY 1""",
)
def domain_counts(spark, d):
    return coverage.domain_counts(obs(spark, d), dictionary(spark, d))


@query(
    "missing_series",
    f"""WITH {OBS}, {DICTIONARY} SELECT indicator, domain FROM dictionary WHERE indicator NOT IN (
  SELECT indicator FROM obs WHERE dataset IN ('shipments_annual', 'orders_nation'))""",
)
def missing_series(spark, d):
    fact = obs(spark, d, "shipments_annual", "orders_nation")
    return coverage.missing_series(dictionary(spark, d), fact).select("indicator", "domain")


@query(
    "series_homogeneity",
    f"""WITH {OBS}, s AS (SELECT indicator, geography, count(*) AS observations, count(DISTINCT frequency) AS f, min(frequency) AS one,
    count(DISTINCT unit) AS u, count(DISTINCT dataset) AS ds, count(DISTINCT date_trunc('month', period)) AS m FROM obs GROUP BY 1, 2),
  r AS (SELECT *, CASE WHEN f <> 1 OR lower(one) NOT IN ('monthly','m') THEN 'not_monthly'
    WHEN u <> 1 OR ds <> 1 THEN 'mixed_source_or_unit' WHEN m <> observations THEN 'duplicate_periods' END AS reason FROM s)
  SELECT indicator, geography, observations, CASE WHEN reason IS NULL THEN 'ready' ELSE 'blocked' END AS status, reason FROM r""",
)
def series_homogeneity(spark, d):
    return coverage.homogeneity(obs(spark, d), ["indicator", "geography"])


@query(
    "calendar_completeness",
    f"""WITH {OBS} SELECT {_SERIES}, count(*) AS observed,
  CAST(date_diff('month', min(period), max(period)) + 1 AS BIGINT) AS expected,
  count(*) = date_diff('month', min(period), max(period)) + 1 AS complete FROM obs WHERE frequency = 'monthly' GROUP BY ALL""",
)
def calendar_completeness(spark, d):
    return coverage.calendar_gaps(obs(spark, d).filter(F.col("frequency") == "monthly"))


@query(
    "missing_months",
    f"""WITH {OBS}, span AS (SELECT {_SERIES}, min(period) AS lo, max(period) AS hi FROM obs WHERE frequency = 'monthly' GROUP BY ALL),
  cal AS (SELECT {_SERIES}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM span)
  SELECT {_SERIES}, CAST(period AS VARCHAR) AS period FROM cal ANTI JOIN obs USING ({_SERIES}, period)""",
)
def missing_months(spark, d):
    return coverage.missing_months(obs(spark, d).filter("frequency = 'monthly'"))


@query(
    "duplicate_keys",
    f"""WITH {RAW2} SELECT dataset, indicator, geography, CAST(period AS VARCHAR) AS period, unit, frequency, count(*) AS copies
  FROM typed_v2 WHERE valid GROUP BY dataset, indicator, geography, typed_v2.period, unit, frequency HAVING count(*) > 1""",
)
def duplicate_keys(spark, d):
    from statweave.schema import KEY

    return reconcile.duplicate_keys(V.valid_rows(V.typed(raw(spark, d), RAW_URL)), KEY)


@query(
    "hierarchy_reconciliation",
    f"""WITH {OBS}, link AS (SELECT s_name AS geography, n_name AS parent FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT n_name, '{WORLD}' FROM nation),
  child AS (SELECT parent, indicator, period, sum(CAST(value AS DECIMAL(28,4))) AS child_total, count(*) AS children
    FROM obs JOIN link USING (geography) WHERE dataset IN ('shipments_supplier','shipments_nation') AND unit <> 'percent' GROUP BY 1, 2, 3),
  pub AS (SELECT geography AS parent, indicator, period, count(*) AS published_rows, max(CAST(value AS DECIMAL(28,4))) AS published_total
    FROM obs WHERE dataset IN ('shipments_nation','shipments_world') AND unit <> 'percent' GROUP BY 1, 2, 3)
  SELECT parent, indicator, CAST(period AS VARCHAR) AS period, CAST(child_total AS DOUBLE) AS child_total, children,
    published_rows, CAST(published_total AS DOUBLE) AS published_total,
    coalesce(published_rows, 0) = 1 AND child_total IS NOT DISTINCT FROM published_total AS reconciled
  FROM child FULL JOIN pub USING (parent, indicator, period)""",
)
def hierarchy_reconciliation(spark, d):
    rows = obs(spark, d, "shipments_supplier", "shipments_nation", "shipments_world").filter(F.col("unit") != "percent")
    district_of = supplier_nation(spark, d).select(F.col("s_name").alias("geography"), F.col("n_name").alias("parent"))
    nations = spark.read.parquet(f"{d}/nation.parquet").select(
        F.col("n_name").alias("geography"), F.lit(WORLD).alias("parent")
    )
    out = reconcile.hierarchy_violations(
        rows.filter(F.col("dataset").isin("shipments_supplier", "shipments_nation")),
        rows.filter(F.col("dataset").isin("shipments_nation", "shipments_world")),
        district_of.unionByName(nations),
        ["indicator", "period"],
    )
    return out.withColumns({c: F.col(c).cast("double") for c in ("child_total", "published_total")})


@query(
    "quality_totals",
    f"""WITH {MANIFESTS} SELECT *, (raw_rows - rejected_rows)::DOUBLE / raw_rows * 100.0::DOUBLE AS acceptance_rate FROM (
  SELECT CAST(sum(raw_rows) AS BIGINT) AS raw_rows, CAST(sum(rejected_rows) AS BIGINT) AS rejected_rows,
  CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(missing_values) AS BIGINT) AS missing_values FROM manifests)""",
)
def quality_totals(spark, d):
    return catalog.quality_totals(manifests(spark, d))


_LATEST = """latest AS (SELECT * FROM manifests QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY completed_at DESC, manifest_path) = 1)"""


@query(
    "catalog_totals",
    f"""WITH {MANIFESTS}, {_LATEST} SELECT count(*) AS publications, CAST(sum(processed_rows) AS BIGINT) AS accepted_rows,
  count(DISTINCT source) AS publishers FROM latest""",
)
def catalog_totals(spark, d):
    return catalog.catalog_totals(catalog.latest_publications(manifests(spark, d)))


@query(
    "latest_publications",
    f"""WITH {MANIFESTS}, {_LATEST}, stem AS (SELECT *, regexp_replace(regexp_extract(original_file, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM latest)
  SELECT source_url, manifest_path, completed_at, processed_rows,
    CASE WHEN starts_with(source, 'World Bank') THEN 'World Development Indicators · Orders ' || substr(stem, 8)
         WHEN starts_with(stem, 'table_1_') THEN 'Census 2023 · Year ' || substr(stem, 14)
         ELSE 'Monthly consumer and wholesale price indices' END AS title FROM stem""",
)
def latest_publications(spark, d):
    return catalog.latest_publications(manifests(spark, d)).select(
        "source_url", "manifest_path", "completed_at", "processed_rows", "title"
    )


# ------------------------------------------------------------------ comparison and inference

_PAIRS = """
pairs AS (SELECT a.geography, a.frequency, a.period, a.dataset AS dataset_a, b.dataset AS dataset_b, a.value AS value_a, b.value AS value_b
  FROM obs a JOIN obs b ON a.geography = b.geography AND a.frequency = b.frequency AND a.period = b.period
  WHERE a.indicator = 'ship_value' AND b.indicator = 'returned_share' AND a.dataset = b.dataset)
"""


def _t_p(t, n):
    """P(|T| >= |t|) for whole degrees of freedom, by the finite series in the angle's cosine."""
    angle, half = f"atan(abs({t}) / sqrt({n}))", f"CAST(floor({n} / 2) AS BIGINT)"
    even = f"""sin({angle}) * list_sum(list_transform(generate_series(0, {half} - 1),
      lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos({angle}), 2 * j)))"""
    odd = f"""2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(generate_series(0, {half} - 1),
      lambda j: exp(lgamma(j + 1) + lgamma(0.5) - lgamma(j + 1.5)) / 2 * pow(cos({angle}), 2 * j + 1))), 0))"""
    return f"greatest(0, 1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END)"


_RANKED = """ranked AS (SELECT *,
    rank() OVER (PARTITION BY dataset_a, geography ORDER BY value_a) + (count(*) OVER (PARTITION BY dataset_a, geography, value_a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY dataset_a, geography ORDER BY value_b) + (count(*) OVER (PARTITION BY dataset_a, geography, value_b) - 1) / 2.0 AS rb FROM pairs),
  coefficients AS (SELECT dataset_a, geography, count(*) AS n,
    CASE WHEN count(*) >= 3 AND count(DISTINCT value_a) > 1 AND count(DISTINCT value_b) > 1 THEN corr(value_a, value_b) END AS pearson,
    CASE WHEN count(*) >= 3 AND count(DISTINCT value_a) > 1 AND count(DISTINCT value_b) > 1 THEN corr(ra, rb) END AS spearman
  FROM ranked GROUP BY 1, 2)"""


def _corr_p(r):
    t = f"({r} * sqrt((n - 2) / ((1 - {r}) * (1 + {r}))))"
    return f"round(CASE WHEN {r} IS NULL OR n < 3 THEN NULL WHEN 1 - {r} * {r} <= 0 THEN 0 ELSE {_t_p(t, '(n - 2)')} END, 8)"


def _pairs(spark, d):
    rows = compare.matched_pairs(obs(spark, d), "ship_value", "returned_share")
    return rows.filter(F.col("dataset_a") == F.col("dataset_b"))


@query(
    "pair_correlations",
    f"""WITH {OBS}, {_PAIRS}, ranked AS (SELECT *,
    rank() OVER (PARTITION BY dataset_a, geography ORDER BY value_a) + (count(*) OVER (PARTITION BY dataset_a, geography, value_a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY dataset_a, geography ORDER BY value_b) + (count(*) OVER (PARTITION BY dataset_a, geography, value_b) - 1) / 2.0 AS rb FROM pairs)
  SELECT dataset_a, geography, count(*) AS n,
    round(CASE WHEN count(*) >= 3 AND count(DISTINCT value_a) > 1 AND count(DISTINCT value_b) > 1 THEN corr(value_a, value_b) END, 8) AS pearson,
    round(CASE WHEN count(*) >= 3 AND count(DISTINCT value_a) > 1 AND count(DISTINCT value_b) > 1 THEN corr(ra, rb) END, 8) AS spearman
  FROM ranked GROUP BY 1, 2""",
)
def pair_correlations(spark, d):
    out = compare.correlations(_pairs(spark, d), ["dataset_a", "geography"])
    return out.withColumns({c: F.round(c, 8) for c in ("pearson", "spearman")})


@query(
    "pair_p_values",
    f"""WITH {OBS}, {_PAIRS}, {_RANKED} SELECT dataset_a, geography, n, round(pearson, 8) AS pearson, round(spearman, 8) AS spearman,
  {_corr_p("pearson")} AS pearson_p, {_corr_p("spearman")} AS spearman_p FROM coefficients""",
)
def pair_p_values(spark, d):
    out = compare.with_p_values(compare.correlations(_pairs(spark, d), ["dataset_a", "geography"]))
    known = lambda c: F.round(F.when(~F.isnan(c), F.col(c)), 8)
    return out.withColumns({c: known(c) for c in ("pearson", "spearman", "pearson_p", "spearman_p")})


_SHIP5 = ["ship_value", "ship_qty", "ship_lines", "returned_share", "accepted_share", "order_value", "click_value"]
_WIDE = """
wide AS (SELECT frequency || ' ' || geography AS geography, period, {cols} FROM obs GROUP BY 1, 2)
""".format(cols=", ".join(f"max(value) FILTER (WHERE indicator = '{c}') AS {c}" for c in _SHIP5))


def _wide(spark, d):
    rows = obs(spark, d).withColumn("geography", F.concat_ws(" ", "frequency", "geography"))
    return compare.wide(rows, ["geography", "period"], _SHIP5)


def _pair_list():
    from itertools import combinations

    return list(combinations(_SHIP5, 2))


def _pearson_sql(source):
    return " UNION ALL ".join(
        f"""SELECT geography, '{a}' AS indicator_a, '{b}' AS indicator_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n,
  round(CASE WHEN count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) >= 12
    AND count(DISTINCT {a}) FILTER (WHERE {b} IS NOT NULL) > 1 AND count(DISTINCT {b}) FILTER (WHERE {a} IS NOT NULL) > 1
    THEN corr({a}, {b}) END, 8) AS coefficient FROM {source} GROUP BY geography"""
        for a, b in _pair_list()
    )


@query("correlation_matrix_pearson", f"WITH {OBS}, {_WIDE} {_pearson_sql('wide')}")
def correlation_matrix_pearson(spark, d):
    out = compare.pearson_matrix(_wide(spark, d), ["geography"], _SHIP5)
    return out.withColumn("coefficient", F.round("coefficient", 8))


_CHANGED = "changed AS (SELECT geography, period, " + ", ".join(
    f"{c} / nullif(lag({c}) OVER w, 0) - 1.0::DOUBLE AS {c}" for c in _SHIP5
) + " FROM wide WINDOW w AS (PARTITION BY geography ORDER BY period))"


@query("correlation_matrix_changes", f"WITH {OBS}, {_WIDE}, {_CHANGED} {_pearson_sql('changed')}")
def correlation_matrix_changes(spark, d):
    out = compare.pearson_matrix(compare.changes(_wide(spark, d), ["geography"], _SHIP5), ["geography"], _SHIP5)
    return out.withColumn("coefficient", F.round("coefficient", 8))


def _spearman_sql():
    parts = []
    for a, b in _pair_list():
        parts.append(
            f"""SELECT geography, '{a}' AS indicator_a, '{b}' AS indicator_b, count(*) AS n,
  round(CASE WHEN count(*) >= 12 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(rx, ry) END, 8) AS coefficient FROM (
  SELECT geography, {a} AS x, {b} AS y,
    rank() OVER (PARTITION BY geography ORDER BY {a}) + (count(*) OVER (PARTITION BY geography, {a}) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY geography ORDER BY {b}) + (count(*) OVER (PARTITION BY geography, {b}) - 1) / 2.0 AS ry
  FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY geography"""
        )
    return " UNION ALL ".join(parts)


@query("correlation_matrix_spearman", f"WITH {OBS}, {_WIDE} {_spearman_sql()}")
def correlation_matrix_spearman(spark, d):
    out = compare.spearman_matrix(_wide(spark, d), ["geography"], _SHIP5)
    return out.withColumn("coefficient", F.round("coefficient", 8))


@query(
    "comparison_in_range",
    f"""WITH {OBS}, p AS (SELECT a.value AS x, b.value AS y FROM obs a JOIN obs b USING (geography, frequency, period)
    WHERE a.indicator = 'ship_value' AND b.indicator = 'order_value' AND a.geography = 'NATION_6' AND a.dataset = 'shipments_nation' AND a.period >= DATE '1996-05-01' AND a.period <= DATE '2000-12-31'),
  r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
  SELECT count(*) AS n, round(corr(x, y), 8) AS pearson, round(corr(rx, ry), 8) AS spearman FROM r""",
)
def comparison_in_range(spark, d):
    """Both correlations of two series over the matched months of a range."""
    found = compare.comparison(obs(spark, d, "shipments_nation", "orders_nation"), "ship_value", "order_value", "NATION_6", "1996-05", "2000")
    return found["correlation"].select("n", F.round("pearson", 8).alias("pearson"), F.round("spearman", 8).alias("spearman"))


@query(
    "pairwise_observations",
    f"WITH {OBS}, {_WIDE} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS indicator_a, '{b}' AS indicator_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM wide"
        for a, b in _pair_list()
    ),
)
def pairwise_observations(spark, d):
    return compare.pearson_matrix(_wide(spark, d), [], _SHIP5).select("indicator_a", "indicator_b", "n")


@query(
    "mean_standard_error",
    f"""WITH {OBS} SELECT dataset, indicator, CASE WHEN count(*) < 3 THEN 'blocked' ELSE 'calculated' END AS status,
  count(*) AS n, round(CASE WHEN count(*) >= 3 THEN avg(value / 1e6) END, 6) AS mean,
  round(CASE WHEN count(*) >= 3 THEN stddev_samp(value / 1e6) / sqrt(count(*)) END, 6) AS sem FROM obs GROUP BY 1, 2""",
)
def mean_standard_error(spark, d):
    millions = obs(spark, d).withColumn("value", F.col("value") / 1e6)
    out = compare.mean_interval(millions, ["dataset", "indicator"], independent=True)
    return out.select("dataset", "indicator", "status", "n", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


@query(
    "mean_interval",
    f"""WITH {OBS} SELECT dataset, indicator, CASE WHEN count(*) < 3 THEN 'blocked' ELSE 'calculated' END AS status, count(*) AS n,
  round(CASE WHEN count(*) >= 3 THEN avg(value / 1e6) END, 6) AS mean,
  CASE WHEN count(*) >= 3 AND min(value) < max(value) THEN 0.05::DOUBLE END AS lower_p,
  CASE WHEN count(*) >= 3 AND min(value) < max(value) THEN 0.05::DOUBLE END AS upper_p FROM obs GROUP BY 1, 2""",
)
def mean_interval(spark, d):
    """Both bounds, given as the two-sided probability of a mean that far away: one minus the confidence."""
    millions = obs(spark, d).withColumn("value", F.col("value") / 1e6)
    out = compare.mean_interval(millions, ["dataset", "indicator"], independent=True)
    dof = (F.col("n") - 1).cast("double")
    chance = lambda c: F.round(F.when(F.col("sem") > 0, t_two_sided_p((F.col(c) - F.col("mean")) / F.col("sem"), dof)), 8)
    return out.select(
        "dataset", "indicator", "status", "n", F.round("mean", 6).alias("mean"), chance("lower").alias("lower_p"), chance("upper").alias("upper_p")
    )


@query(
    "welch_difference",
    f"""WITH {OBS}, s AS (SELECT dataset, indicator, count(*) FILTER (WHERE period < DATE '1998-01-01') AS n_a,
    count(*) FILTER (WHERE period >= DATE '1998-01-01') AS n_b,
    avg(value) FILTER (WHERE period < DATE '1998-01-01') AS ma, avg(value) FILTER (WHERE period >= DATE '1998-01-01') AS mb,
    var_samp(value) FILTER (WHERE period < DATE '1998-01-01') / nullif(count(*) FILTER (WHERE period < DATE '1998-01-01'), 0) AS va,
    var_samp(value) FILTER (WHERE period >= DATE '1998-01-01') / nullif(count(*) FILTER (WHERE period >= DATE '1998-01-01'), 0) AS vb
    FROM obs WHERE frequency = 'monthly' GROUP BY 1, 2)
  SELECT dataset, indicator, 'calculated' AS status, n_a, n_b, round((ma - mb) / sqrt(va + vb), 6) AS statistic,
    round((va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)), 4) AS degrees_of_freedom FROM s""",
)
def welch_difference(spark, d):
    rows = obs(spark, d).filter(F.col("frequency") == "monthly")
    early = F.col("period") < F.lit("1998-01-01").cast("date")
    out = compare.difference_test(rows, ["dataset", "indicator"], early, independent=True)
    return out.drop("reason").withColumns(
        {"statistic": F.round("statistic", 6), "degrees_of_freedom": F.round("degrees_of_freedom", 4)}
    )


_STEPS = 4000


def _simpson_p(t, n):
    """P(|T| >= |t|) for any degrees of freedom: Simpson's rule over the density, in the angle whose tangent is t / sqrt(n)."""
    angle = f"(atan(abs({t}) / sqrt({n})) / {_STEPS})"
    weight = f"CASE WHEN j = 0 OR j = {_STEPS} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(generate_series(0, {_STEPS}), lambda j: {weight} * pow(cos({angle} * j), {n} - 1))) * {angle} / 3"
    return f"greatest(0, 1 - 2 * exp(lgamma(({n} + 1) / 2) - lgamma({n} / 2)) / sqrt(pi()) * {area})"


_WELCH = """s AS (SELECT dataset, indicator, count(*) FILTER (WHERE period < DATE '1998-01-01') AS n_a,
    count(*) FILTER (WHERE period >= DATE '1998-01-01') AS n_b,
    avg(value) FILTER (WHERE period < DATE '1998-01-01') AS ma, avg(value) FILTER (WHERE period >= DATE '1998-01-01') AS mb,
    var_samp(value) FILTER (WHERE period < DATE '1998-01-01') / nullif(count(*) FILTER (WHERE period < DATE '1998-01-01'), 0) AS va,
    var_samp(value) FILTER (WHERE period >= DATE '1998-01-01') / nullif(count(*) FILTER (WHERE period >= DATE '1998-01-01'), 0) AS vb
    FROM obs WHERE frequency = 'monthly' GROUP BY 1, 2),
  w AS (SELECT *, (ma - mb) / sqrt(va + vb) AS t, (va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)) AS dof FROM s)"""


@query(
    "welch_p_values",
    f"WITH {OBS}, {_WELCH} SELECT dataset, indicator, n_a, n_b, round(t, 6) AS statistic, round({_simpson_p('t', 'dof')}, 7) AS p_value FROM w",
)
def welch_p_values(spark, d):
    rows = obs(spark, d).filter(F.col("frequency") == "monthly")
    early = F.col("period") < F.lit("1998-01-01").cast("date")
    out = compare.with_test_p(compare.difference_test(rows, ["dataset", "indicator"], early, independent=True))
    return out.select("dataset", "indicator", "n_a", "n_b", F.round("statistic", 6).alias("statistic"), F.round("p_value", 7).alias("p_value"))


@query(
    "forecast_error_metrics",
    f"""WITH {OBS}, p AS (SELECT {_SERIES}, value AS actual, lag(value, 12) OVER (PARTITION BY {_SERIES} ORDER BY period) AS predicted
    FROM obs WHERE frequency = 'monthly')
  SELECT {_SERIES}, round(avg(abs(actual - predicted)), 5) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 5) AS rmse,
    round(avg(CASE WHEN abs(actual) > 1e-10 THEN abs((actual - predicted) / actual) END) * 100, 6) AS mape_percent,
    count(*) FILTER (WHERE abs(actual) > 1e-10) AS mape_eligible_rows FROM p WHERE predicted IS NOT NULL GROUP BY ALL""",
)
def forecast_error_metrics(spark, d):
    rows = obs(spark, d).filter(F.col("frequency") == "monthly")
    lagged = rows.withColumns({"actual": F.col("value"), "predicted": F.lag("value", 12).over(W.along())})
    out = compare.forecast_errors(lagged.filter(F.col("predicted").isNotNull()), SERIES)
    return out.withColumns({"mae": F.round("mae", 5), "rmse": F.round("rmse", 5), "mape_percent": F.round("mape_percent", 6)})
