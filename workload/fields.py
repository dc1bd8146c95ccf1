"""Cell level: cleaning, parsing, validation, names, units, URLs and census rows."""

from pyspark.sql import functions as F

from statweave.functions import parse, text
from statweave.operators import catalog, normalize, reconcile
from statweave.operators import validate as V
from statweave.schema import COLUMNS, KEY
from statweave.sources import census, files

from .observations import MANIFESTS, OBS, RAW2, RAW_URL, SITE, manifests, obs, raw, table
from .registry import query

_SEQ = "s_order, s_line, s_part, s_supp, CAST(s_date AS VARCHAR) AS s_date, s_price"
_SEQ_COLUMNS = ["s_order", "s_line", "s_part", "s_supp", "s_date", "s_price"]


@query(
    "strip_fields",
    f"""WITH {RAW2} SELECT dataset, indicator, geography, period, value, unit, frequency, source_url, {_SEQ} FROM stripped_v2""",
)
def strip_fields(spark, d):
    return V.strip_fields(raw(spark, d))


@query(
    "numeric_parse",
    f"""WITH {RAW2} SELECT r.value AS text, p.value, count(*) AS cells FROM parsed_v2 p JOIN stripped_v2 r USING (s_order, s_line, s_part, s_supp, s_date, s_price)
  GROUP BY 1, 2""",
)
def numeric_parse(spark, d):
    cell = raw(spark, d).select(parse.strip(F.col("value")).alias("text"))
    return cell.groupBy("text").agg(F.count("*").alias("cells")).withColumn("value", parse.finite_number(F.col("text")))


@query(
    "date_parse",
    f"""WITH {RAW2} SELECT r.period AS text, CAST(p.period AS VARCHAR) AS period, count(*) AS cells FROM parsed_v2 p
  JOIN stripped_v2 r USING (s_order, s_line, s_part, s_supp, s_date, s_price) GROUP BY r.period, p.period""",
)
def date_parse(spark, d):
    cell = raw(spark, d).select(parse.strip(F.col("period")).alias("text"))
    return cell.groupBy("text").agg(F.count("*").alias("cells")).withColumn("period", parse.iso_date(F.col("text")))


@query(
    "row_validity",
    f"""WITH {RAW2} SELECT dataset, indicator, geography, CAST(period AS VARCHAR) AS period, value, unit, frequency, source_url, valid, {_SEQ} FROM typed_v2""",
)
def row_validity(spark, d):
    return V.typed(raw(spark, d), RAW_URL).select(*COLUMNS, "valid", *_SEQ_COLUMNS)


@query(
    "reject_reasons",
    f"""WITH {RAW2} SELECT reason, count(*) AS rejected_rows FROM (SELECT unnest(list_filter([
    CASE WHEN dataset = '' THEN 'blank_dataset' END, CASE WHEN period IS NULL THEN 'bad_period' END,
    CASE WHEN value IS NULL THEN 'bad_value' END, CASE WHEN source_url <> '{RAW_URL}' THEN 'other_source' END,
    CASE WHEN frequency = 'hourly' THEN 'unknown_frequency' END], lambda x: x IS NOT NULL)) AS reason FROM typed_v2 WHERE NOT valid) GROUP BY 1""",
)
def reject_reasons(spark, d):
    return V.reject_reasons(V.typed(raw(spark, d), RAW_URL))


@query(
    "blank_cells",
    f"""WITH {RAW2} SELECT CAST(sum(blanks) AS BIGINT) AS missing_values, count(*) AS raw_rows FROM parsed_v2""",
)
def blank_cells(spark, d):
    return V.strip_fields(raw(spark, d)).agg(
        F.sum(V.blank_cells()).alias("missing_values"), F.count("*").alias("raw_rows")
    )


@query(
    "geography_aliases",
    f"""WITH {OBS} SELECT o.dataset, indicator, CAST(period AS VARCHAR) AS period, coalesce(r_name, geography) AS geography, value
  FROM obs o LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) a ON o.geography = a.n_name""",
)
def geography_aliases(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    aliases = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("alias"), F.col("r_name").alias("name"))
    out = normalize.rename_geographies(obs(spark, d), aliases)
    return out.select("dataset", "indicator", "period", "geography", "value")


@query(
    "unit_conversion",
    f"""WITH {RAW2} SELECT unit, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM (
  SELECT 'million usd' AS unit, value * (CASE WHEN unit = 'thousand usd' THEN 1000.0::DOUBLE * 0.5 ELSE 0.5 END) AS value FROM typed_v2 WHERE valid) GROUP BY 1""",
)
def unit_conversion(spark, d):
    """Chained conversions: thousands become dollars, dollars become half millions (factors kept exact)."""
    rows = V.valid_rows(V.typed(raw(spark, d), RAW_URL))
    out = normalize.convert_units(rows, {"thousand usd": ("usd", 1000.0), "usd": ("million usd", 0.5)})
    return out.groupBy("unit").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("total")
    )


@query(
    "normalized_rows",
    f"""WITH {RAW2} SELECT s.geography, s.indicator, CASE s.unit WHEN 'thousand usd' THEN 'usd' ELSE s.unit END AS unit, p.value *
    CASE s.unit WHEN 'thousand usd' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS value, count(*) AS n
  FROM stripped_v2 s JOIN parsed_v2 p USING (s_order, s_line, s_part, s_supp, s_date, s_price) GROUP BY ALL""",
)
def normalized_rows(spark, d):
    out = normalize.normalized(raw(spark, d), units={"thousand usd": ("usd", 1000.0)})
    return out.withColumn("indicator", parse.strip(F.col("indicator"))).groupBy("geography", "indicator", "unit", "value").agg(
        F.count("*").alias("n")
    )


@query(
    "collapsed_names",
    r"""SELECT doc_id, replace(upper(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ẞ', 'SS') AS name FROM documents""",
)
def collapsed_names(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collapse_upper(F.col("text")).alias("name"))


@query(
    "title_case_names",
    """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_type || ' ' || p_name || '.' || p_brand, '[A-Za-z]+|[^A-Za-z]+'),
    lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS name FROM part""",
)
def title_case_names(spark, d):
    name = F.concat("p_type", F.lit(" "), "p_name", F.lit("."), "p_brand")
    return table(spark, d, "part").select("p_partkey", text.title_case(name).alias("name"))


@query(
    "dataset_from_file",
    """SELECT n_name, 'pbs_census_2023_' || CASE WHEN n_nationkey = 0 THEN 'national' WHEN n_nationkey = 1 THEN 'kp'
    WHEN n_nationkey = 2 THEN 'islamabad_districts' ELSE lower(n_name) || '_districts' END AS dataset, count(*) AS suppliers
  FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""",
)
def dataset_from_file(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    file_name = F.expr(
        "concat('raw/census/table_1_', CASE n_nationkey WHEN 0 THEN 'national' WHEN 1 THEN 'kp_districts' "
        "WHEN 2 THEN 'islamabad' ELSE concat(lower(n_name), '_districts') END, '.xlsx')"
    )
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name", text.census_dataset(file_name).alias("dataset")).agg(
        F.count("*").alias("suppliers")
    )


@query(
    "publication_titles",
    f"""WITH {MANIFESTS} SELECT manifest_path, CASE WHEN starts_with(source, 'World Bank') THEN 'World Development Indicators · Orders ' || substr(original_file, 12, 4)
    WHEN original_file LIKE '%table_1%' THEN 'Census 2023 · Year ' || substr(original_file, 18, 4)
    ELSE 'Monthly consumer and wholesale price indices' END AS title FROM manifests""",
)
def publication_titles(spark, d):
    return manifests(spark, d).select(
        "manifest_path", text.publication_title(F.col("source"), F.col("original_file")).alias("title")
    )


@query(
    "unit_labels",
    f"""WITH {OBS} SELECT indicator, unit, frequency,
  CASE unit WHEN 'current_usd' THEN 'Current US dollars' WHEN 'tonnes' THEN 'Tonnes' WHEN 'percent' THEN 'Percent' ELSE replace(unit, '_', ' ') END AS label,
  array_to_string(list_transform(string_split(replace(indicator, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title,
  count(*) AS observations FROM obs GROUP BY ALL""",
)
def unit_labels(spark, d):
    counted = obs(spark, d).groupBy("indicator", "unit", "frequency").agg(F.count("*").alias("observations"))
    return counted.withColumns(
        {"label": text.unit_label(F.col("unit")), "title": text.indicator_title(F.col("indicator"))}
    )


@query(
    "display_scaling",
    f"""WITH {OBS} SELECT dataset, indicator, geography, CAST(period AS VARCHAR) AS period,
  value / CASE unit WHEN 'current_usd' THEN 1e9 WHEN 'persons' THEN 1e6 WHEN 'tonnes' THEN 1e6 ELSE 1 END AS shown,
  CASE unit WHEN 'current_usd' THEN 'US$ bn' WHEN 'tonnes' THEN 'Million tonnes' WHEN 'percent' THEN 'Percent' ELSE unit END AS shown_unit FROM obs""",
)
def display_scaling(spark, d):
    return obs(spark, d).select(
        "dataset", "indicator", "geography", "period",
        (F.col("value") / text.display_divisor(F.col("unit"))).alias("shown"),
        text.display_unit(F.col("unit")).alias("shown_unit"),
    )


_HOSTS = ("example.com", "example.org")


@query(
    "official_hosts",
    r"""SELECT page_id, url, regexp_matches(url, '^(?i:https)://([^/?#@:]+\.)?(?i:example\.com|example\.org)(:(443)?)?([/?#]|$)') AS official FROM pages""",
)
def official_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", "url", files.official_url(F.col("url"), _HOSTS).alias("official"))


# ------------------------------------------------------------------ census workbooks built from orders


def _cells(spark, d):
    """One row per customer nation with order counts by status as parts and total."""
    return spark.sql(f"""SELECT concat('  ', n_name, chr(10), ' district ') AS c0, count(*) AS c2,
      count_if(o_orderstatus = 'F') AS c3, count_if(o_orderstatus = 'O') AS c4, count_if(o_orderstatus = 'P') AS c5,
      CASE WHEN n_nationkey % 2 = 0 THEN CAST(count(*) / 10.0D AS DOUBLE) END AS c7,
      100.0D * count_if(o_orderpriority = '1-URGENT') / count(*) AS c8,
      CAST(count(DISTINCT o_custkey) AS DOUBLE) AS c9, count_if(o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00') AS c10,
      CAST(n_regionkey AS DOUBLE) AS c11
      FROM parquet.`{d}/orders.parquet` JOIN parquet.`{d}/customer.parquet` ON o_custkey = c_custkey
      JOIN parquet.`{d}/nation.parquet` ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey, n_regionkey""")


_CELLS = """cells AS (SELECT n_name, count(*) AS c2, count(*) FILTER (WHERE o_orderstatus = 'F') AS c3, count(*) FILTER (WHERE o_orderstatus = 'O') AS c4,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS c5, CASE WHEN n_nationkey % 2 = 0 THEN count(*) / 10.0::DOUBLE END AS c7,
    100.0::DOUBLE * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) AS c8, count(DISTINCT o_custkey) AS c9,
    count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS c10, n_regionkey AS c11
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey, n_regionkey)"""


@query(
    "wide_row_checks",
    f"""WITH {_CELLS} SELECT n_name, concat_ws(',', CASE WHEN c2 <> c3 + c4 THEN 'parts_differ_from_total' END,
    CASE WHEN c8 * 5 NOT BETWEEN 0 AND 100 THEN 'five_shares_out_of_range' END) AS violations FROM cells
  WHERE c2 <> c3 + c4 OR c8 * 5 NOT BETWEEN 0 AND 100""",
)
def wide_row_checks(spark, d):
    """Two of three parts and five times a share: rows that must be reported."""
    cells = _cells(spark, d).withColumn("five_shares", F.col("c8") * 5)
    bad = reconcile.parts_violations(cells, ["c3", "c4"], "c2", ["five_shares"])
    name = F.regexp_replace(text.collapse_upper(F.col("c0")), " DISTRICT$", "")
    return bad.select(name.alias("n_name"), "violations")


@query(
    "census_observations",
    f"""WITH {_CELLS}, l AS (SELECT n_name, unnest([
    {{'i': 'population', 'u': 'persons', 'v': c2::DOUBLE}}, {{'i': 'population_male', 'u': 'persons', 'v': c3::DOUBLE}},
    {{'i': 'population_female', 'u': 'persons', 'v': c4::DOUBLE}}, {{'i': 'population_transgender', 'u': 'persons', 'v': c5::DOUBLE}},
    {{'i': 'population_density', 'u': 'persons_per_sq_km', 'v': c7::DOUBLE}}, {{'i': 'urban_population_share', 'u': 'percent', 'v': c8::DOUBLE}},
    {{'i': 'household_size', 'u': 'persons_per_household', 'v': c9::DOUBLE}}, {{'i': 'population_growth_annual', 'u': 'percent', 'v': c11::DOUBLE}}]) AS m FROM cells)
  SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS geography, m.i AS indicator, m.u AS unit, m.v AS value, '2023-01-01' AS period FROM l WHERE m.v IS NOT NULL
  UNION ALL SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)), 'population', 'persons', c10::DOUBLE, '2017-01-01' FROM cells""",
)
def census_observations(spark, d):
    return census.census_rows(_cells(spark, d), national=False).select("geography", "indicator", "unit", "value", "period")


@query(
    "geography_levels",
    """SELECT n_name AS label, NULL AS national, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS district, count(*) AS suppliers
    FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2, 3
  UNION ALL SELECT r_name, CASE r_name WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' END, NULL, count(*)
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""",
)
def geography_levels(spark, d):
    rows = spark.sql(f"""SELECT n_name, r_name FROM parquet.`{d}/supplier.parquet` JOIN parquet.`{d}/nation.parquet` ON s_nationkey = n_nationkey
      JOIN parquet.`{d}/region.parquet` ON n_regionkey = r_regionkey""")
    labels = rows.select(F.concat("n_name", F.lit(" District")).alias("c0"), F.col("n_name").alias("label")).unionByName(
        rows.select(F.concat(F.lit("  "), "r_name").alias("c0"), F.col("r_name").alias("label"))
    )
    known = {"ASIA": "Asia", "EUROPE": "Europe"}
    return labels.groupBy(
        "label",
        census.geography_of(F.col("c0"), True, known).alias("national"),
        census.geography_of(F.col("c0"), False).alias("district"),
    ).agg(F.count("*").alias("suppliers"))
