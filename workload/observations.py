"""Observations derived from the given tables, as DataFrames and as SQL.

Levels follow a geographic hierarchy: supplier (district) -> nation (province) ->
``World`` (national).  Money is summed as decimals, so totals do not depend on the
order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.functions.text import indicator_title

SITE = "https://data.example.org/"
WORLD = "World"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        f"SELECT s_suppkey, s_name, n_name FROM parquet.`{sf_dir}/supplier.parquet` "
        f"JOIN parquet.`{sf_dir}/nation.parquet` ON s_nationkey = n_nationkey"
    )


# Dataset -> (grouping set, grouping id over s_name, n_name, month, year).
_SHIP_LEVELS = {
    "shipments_supplier": ("(s_name, month)", 5),
    "shipments_nation": ("(n_name, month)", 9),
    "shipments_world": ("(month)", 13),
    "shipments_annual": ("(n_name, year)", 10),
}
_ORDER_LEVELS = {"orders_nation": ("(n_name, month)", 0), "orders_world": ("(month)", 2)}

_FACT = (
    "dataset, indicator, geography, period, value, unit, frequency, "
    f"concat('{SITE}', dataset) AS source_url, 'v1' AS dataset_version, concat('run-', dataset) AS ingestion_id"
)


def _case(levels: dict, column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {gid} THEN '{name}'" for name, (_, gid) in levels.items()) + " END"


def _shipments(d: str, levels: dict) -> str:
    """Lines shrink to (supplier, month) once; the levels are grouping sets over that."""
    sets = ", ".join(s for s, _ in levels.values())
    return f"""SELECT {_FACT} FROM (
  SELECT dataset, coalesce(s_name, n_name, '{WORLD}') AS geography, coalesce(month, year) AS period,
    if(dataset = 'shipments_annual', 'annual', 'monthly') AS frequency,
    stack(5, 'ship_value', CAST(price AS DOUBLE), 'current_usd', 'ship_qty', CAST(qty AS DOUBLE), 'tonnes',
      'ship_lines', CAST(n AS DOUBLE), 'count', 'returned_share', 100.0D * n_r / n, 'percent',
      'accepted_share', 100.0D * n_a / n, 'percent') AS (indicator, value, unit)
  FROM (
    SELECT {_case(levels, 'grouping_id(s_name, n_name, month, year)')} AS dataset, s_name, n_name, month, year,
      sum(price) AS price, sum(qty) AS qty, sum(n) AS n, sum(n_r) AS n_r, sum(n_a) AS n_a
    FROM (
      SELECT s_name, n_name, month, trunc(month, 'YEAR') AS year, price, qty, n, n_r, n_a
      FROM (
        SELECT l_suppkey, trunc(CAST(l_shipdate AS DATE), 'MM') AS month,
          sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty,
          count(*) AS n, count_if(l_returnflag = 'R') AS n_r, count_if(l_returnflag = 'A') AS n_a
        FROM parquet.`{d}/lineitem.parquet` GROUP BY 1, 2)
      JOIN parquet.`{d}/supplier.parquet` ON l_suppkey = s_suppkey
      JOIN parquet.`{d}/nation.parquet` ON s_nationkey = n_nationkey)
    GROUP BY s_name, n_name, month, year GROUPING SETS ({sets})))
  WHERE dataset <> 'shipments_annual' OR indicator IN ('ship_value', 'ship_qty')"""


def _orders(d: str, levels: dict) -> str:
    sets = ", ".join(s for s, _ in levels.values())
    return f"""SELECT {_FACT} FROM (
  SELECT dataset, coalesce(n_name, '{WORLD}') AS geography, month AS period, 'monthly' AS frequency,
    stack(2, 'order_value', CAST(price AS DOUBLE), 'current_usd', 'order_count', CAST(n AS DOUBLE), 'count')
      AS (indicator, value, unit)
  FROM (
    SELECT {_case(levels, 'grouping_id(n_name, month)')} AS dataset, n_name, month, sum(price) AS price, sum(n) AS n
    FROM (
      SELECT c_nationkey, trunc(CAST(o_orderdate AS DATE), 'MM') AS month,
        sum(CAST(o_totalprice AS DECIMAL(18,2))) AS price, count(*) AS n
      FROM parquet.`{d}/orders.parquet` JOIN parquet.`{d}/customer.parquet` ON o_custkey = c_custkey GROUP BY 1, 2)
    JOIN parquet.`{d}/nation.parquet` ON c_nationkey = n_nationkey
    GROUP BY n_name, month GROUPING SETS ({sets})))"""


def _events(d: str) -> str:
    """Two indicators per event type: ``<type>_value`` and ``<type>_count``."""
    return f"""SELECT {_FACT} FROM (
  SELECT 'events_daily' AS dataset, '{WORLD}' AS geography, period, 'daily' AS frequency,
    stack(2, concat(event_type, '_value'), CAST(price AS DOUBLE), 'score', concat(event_type, '_count'), CAST(n AS DOUBLE), 'count')
      AS (indicator, value, unit)
  FROM (SELECT event_type, CAST(ts AS DATE) AS period, sum(CAST(value AS DECIMAL(18,2))) AS price, count(*) AS n
    FROM parquet.`{d}/events.parquet` GROUP BY 1, 2))"""


def obs(spark: SparkSession, sf_dir: str, *datasets: str) -> DataFrame:
    """Observations of the named datasets, or all of them; each table is read once."""
    wanted = set(datasets) or {*_SHIP_LEVELS, *_ORDER_LEVELS, "events_daily"}
    ship = {k: v for k, v in _SHIP_LEVELS.items() if k in wanted}
    order = {k: v for k, v in _ORDER_LEVELS.items() if k in wanted}
    parts = [_shipments(sf_dir, ship)] if ship else []
    parts += [_orders(sf_dir, order)] if order else []
    parts += [_events(sf_dir)] if "events_daily" in wanted else []
    return spark.sql(" UNION ALL ".join(f"({p})" for p in parts))


def _sql_long(rows: str, dataset: str, frequency: str, measures: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, {i} AS indicator, geography, period, CAST({v} AS DOUBLE) AS value, "
        f"'{u}' AS unit, '{frequency}' AS frequency, '{SITE}{dataset}' AS source_url, 'v1' AS dataset_version, "
        f"'run-{dataset}' AS ingestion_id FROM {rows}"
        for i, u, v in measures
    )


_SHIP_SQL = [
    ("'ship_value'", "current_usd", "price"),
    ("'ship_qty'", "tonnes", "qty"),
    ("'ship_lines'", "count", "n"),
    ("'returned_share'", "percent", "100.0::DOUBLE * n_r / n"),
    ("'accepted_share'", "percent", "100.0::DOUBLE * n_a / n"),
]
_ORDER_SQL = [("'order_value'", "current_usd", "price"), ("'order_count'", "count", "n")]
_SUMS = "sum(price) AS price, sum(qty) AS qty, sum(n) AS n, sum(n_r) AS n_r, sum(n_a) AS n_a"

OBS = f"""
ship_month AS (
  SELECT s_name, n_name, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
    sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty,
    count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
by_supplier AS (SELECT s_name AS geography, period, price, qty, n, n_r, n_a FROM ship_month),
by_nation AS (SELECT n_name AS geography, period, {_SUMS} FROM ship_month GROUP BY 1, 2),
by_world AS (SELECT '{WORLD}' AS geography, period, {_SUMS} FROM ship_month GROUP BY 1, 2),
by_year AS (SELECT n_name AS geography, CAST(date_trunc('year', period) AS DATE) AS period, {_SUMS} FROM ship_month GROUP BY 1, 2),
order_nation AS (
  SELECT n_name AS geography, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
    sum(CAST(o_totalprice AS DECIMAL(18,2))) AS price, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
order_world AS (SELECT '{WORLD}' AS geography, period, sum(price) AS price, sum(n) AS n FROM order_nation GROUP BY 1, 2),
event_day AS (
  SELECT event_type, '{WORLD}' AS geography, CAST(ts AS DATE) AS period,
    sum(CAST(value AS DECIMAL(18,2))) AS price, count(*) AS n FROM events GROUP BY 1, 2, 3),
obs AS (
  {_sql_long('by_supplier', 'shipments_supplier', 'monthly', _SHIP_SQL)} UNION ALL
  {_sql_long('by_nation', 'shipments_nation', 'monthly', _SHIP_SQL)} UNION ALL
  {_sql_long('by_world', 'shipments_world', 'monthly', _SHIP_SQL)} UNION ALL
  {_sql_long('by_year', 'shipments_annual', 'annual', _SHIP_SQL[:2])} UNION ALL
  {_sql_long('order_nation', 'orders_nation', 'monthly', _ORDER_SQL)} UNION ALL
  {_sql_long('order_world', 'orders_world', 'monthly', _ORDER_SQL)} UNION ALL
  {_sql_long('event_day', 'events_daily', 'daily',
             [("event_type || '_value'", 'score', 'price'), ("event_type || '_count'", 'count', 'n')])})
"""


# ---------------------------------------------------------------- raw text batches

SEQUENCE = ["s_order", "s_line", "s_part", "s_supp", "s_date", "s_price"]
RAW_URL = SITE + "ship"


def raw(spark: SparkSession, sf_dir: str, vintage: int = 2) -> DataFrame:
    """One text row per order line, with the faults published files have.

    Vintage 1 is the publication as it stood at the end of 1999; vintage 2 is the whole
    table with the prices of returned lines revised by one percent.
    """
    price = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,4))"
    if vintage == 2:
        price = (
            "CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 1.01BD AS DECIMAL(18,4)) "
            f"ELSE {price} END"
        )
    where = "WHERE l_shipdate < TIMESTAMP_NTZ '2000-01-01 00:00:00'" if vintage == 1 else ""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k, iso, plain_name = "l_orderkey", "date_format(l_shipdate, 'yyyy-MM-dd')", "lower(concat('price_', l_returnflag, l_linestatus))"
    return spark.sql(f"""SELECT
  if({k} % 97 = 0, '', 'ship_lines') AS dataset,
  CASE WHEN {k} % 5 = 0 THEN concat('  ', {plain_name}, char(9)) WHEN {k} % 17 = 3 THEN concat({plain_name}, char(10)) ELSE {plain_name} END AS indicator,
  if({k} % 11 = 0, concat(' ', n_name, ' '), n_name) AS geography,
  CASE WHEN {k} % 13 = 0 THEN date_format(l_shipdate, 'yyyyMMdd') WHEN {k} % 13 = 1 THEN concat({iso}, 'T23:30:00-05:00')
       WHEN {k} % 13 = 2 THEN concat({iso}, ' 10:15:00') WHEN {k} % 13 = 3 THEN concat(date_format(l_shipdate, 'yyyyMMdd'), 'T101500')
       WHEN {k} % 13 = 4 THEN concat({iso}, 'T23:30-05') WHEN {k} % 91 = 3 THEN 'not-a-date' ELSE {iso} END AS period,
  CASE WHEN {k} % 89 = 0 THEN 'bad' WHEN {k} % 83 = 0 THEN 'inf' WHEN {k} % 79 = 0 THEN '' WHEN {k} % 73 = 0 THEN '1d'
       ELSE CAST({price} AS STRING) END AS value,
  if({k} % 7 = 0, 'thousand usd', 'usd') AS unit,
  if({k} % 101 = 0, 'hourly', 'daily') AS frequency,
  if({k} % 103 = 0, '{SITE}elsewhere', '{RAW_URL}') AS source_url,
  l_orderkey AS s_order, l_linenumber AS s_line, l_partkey AS s_part, l_suppkey AS s_supp,
  CAST(l_shipdate AS DATE) AS s_date, l_extendedprice AS s_price
FROM {{lines}} JOIN parquet.`{sf_dir}/supplier.parquet` ON l_suppkey = s_suppkey
JOIN parquet.`{sf_dir}/nation.parquet` ON s_nationkey = n_nationkey {where}""", lines=lines)


def _raw_sql(vintage: int) -> str:
    price = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,4))"
    if vintage == 2:
        price = (
            "CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST('1.01' AS DECIMAL(3,2)) "
            f"AS DECIMAL(18,4)) ELSE {price} END"
        )
    where = "WHERE l_shipdate < TIMESTAMP '2000-01-01'" if vintage == 1 else ""
    return f"""
raw_v{vintage} AS (SELECT
  CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE 'ship_lines' END AS dataset,
  CASE WHEN l_orderkey % 5 = 0 THEN '  price_' || lower(l_returnflag) || lower(l_linestatus) || chr(9)
       WHEN l_orderkey % 17 = 3 THEN 'price_' || lower(l_returnflag) || lower(l_linestatus) || chr(10)
       ELSE 'price_' || lower(l_returnflag) || lower(l_linestatus) END AS indicator,
  CASE WHEN l_orderkey % 11 = 0 THEN ' ' || n_name || ' ' ELSE n_name END AS geography,
  CASE WHEN l_orderkey % 13 = 0 THEN strftime(l_shipdate, '%Y%m%d')
       WHEN l_orderkey % 13 = 1 THEN strftime(l_shipdate, '%Y-%m-%d') || 'T23:30:00-05:00'
       WHEN l_orderkey % 13 = 2 THEN strftime(l_shipdate, '%Y-%m-%d') || ' 10:15:00'
       WHEN l_orderkey % 13 = 3 THEN strftime(l_shipdate, '%Y%m%d') || 'T101500'
       WHEN l_orderkey % 13 = 4 THEN strftime(l_shipdate, '%Y-%m-%d') || 'T23:30-05'
       WHEN l_orderkey % 91 = 3 THEN 'not-a-date' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS period,
  CASE WHEN l_orderkey % 89 = 0 THEN 'bad' WHEN l_orderkey % 83 = 0 THEN 'inf' WHEN l_orderkey % 79 = 0 THEN ''
       WHEN l_orderkey % 73 = 0 THEN '1d' ELSE CAST({price} AS VARCHAR) END AS value,
  CASE WHEN l_orderkey % 7 = 0 THEN 'thousand usd' ELSE 'usd' END AS unit,
  CASE WHEN l_orderkey % 101 = 0 THEN 'hourly' ELSE 'daily' END AS frequency,
  CASE WHEN l_orderkey % 103 = 0 THEN '{SITE}elsewhere' ELSE '{RAW_URL}' END AS source_url,
  l_orderkey AS s_order, l_linenumber AS s_line, l_partkey AS s_part, l_suppkey AS s_supp,
  CAST(l_shipdate AS DATE) AS s_date, l_extendedprice AS s_price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey {where})"""


def _typed_sql(vintage: int) -> str:
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"""
stripped_v{vintage} AS (SELECT {strip('dataset')} AS dataset, {strip('indicator')} AS indicator, {strip('geography')} AS geography,
  {strip('period')} AS period, {strip('value')} AS value, unit, frequency, source_url,
  s_order, s_line, s_part, s_supp, s_date, s_price FROM raw_v{vintage}),
parsed_v{vintage} AS (SELECT * EXCLUDE (period, value),
  CASE WHEN regexp_full_match(period, '\\d{{8}}(T\\d{{6}})?') THEN CAST(try_strptime(substr(period, 1, 8), '%Y%m%d') AS DATE)
       WHEN period LIKE '%T23:30:00-05:00' OR period LIKE '%T23:30-05' THEN CAST(substr(period, 1, 10) AS DATE) + 1
       WHEN regexp_full_match(period, '\\d{{4}}-\\d{{2}}-\\d{{2}}.*') THEN CAST(substr(period, 1, 10) AS DATE) END AS period,
  CASE WHEN regexp_full_match(value, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(value AS DOUBLE) END AS value,
  (dataset = '')::INT + (indicator = '')::INT + (geography = '')::INT + (period = '')::INT + (value = '')::INT
  + (unit = '')::INT + (frequency = '')::INT + (source_url = '')::INT AS blanks FROM stripped_v{vintage}),
typed_v{vintage} AS (SELECT *, dataset <> '' AND period IS NOT NULL AND value IS NOT NULL AND source_url = '{RAW_URL}'
  AND frequency IN ('daily','weekly','monthly','quarterly','annual','census','irregular') AS valid FROM parsed_v{vintage}),
accepted_v{vintage} AS (SELECT dataset, indicator, geography, period, value, unit, frequency, source_url,
    'v{vintage}' AS dataset_version, 'run-{vintage}' AS ingestion_id FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, indicator, geography, period, unit, frequency
    ORDER BY s_order, s_line, s_part, s_supp, s_date, s_price) AS rn FROM typed_v{vintage} WHERE valid) WHERE rn = 1)"""


RAW1 = _raw_sql(1) + "," + _typed_sql(1)
RAW2 = _raw_sql(2) + "," + _typed_sql(2)


# ---------------------------------------------------------------- dictionary and manifests


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator dictionary of the national series; the event counts are left undefined."""
    return (
        obs(spark, sf_dir, "shipments_world", "orders_world", "events_daily")
        .filter("NOT endswith(indicator, '_count') OR indicator = 'order_count'")
        .select("indicator", "unit", "frequency")
        .distinct()
        .select(
            "indicator", "unit", "frequency",
            indicator_title(F.col("indicator")).alias("title"),
            F.expr(
                "CASE WHEN startswith(indicator, 'ship_') THEN 'trade' WHEN startswith(indicator, 'order_') THEN 'economy' "
                "WHEN endswith(indicator, '_share') THEN 'trade' ELSE 'digital' END"
            ).alias("domain"),
        )
    )


DICTIONARY = """
dictionary AS (SELECT DISTINCT indicator, unit, frequency,
  list_aggregate(list_transform(string_split(replace(indicator, '_', ' '), ' '),
    lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ') AS title,
  CASE WHEN indicator LIKE 'ship\\_%' ESCAPE '\\' THEN 'trade' WHEN indicator LIKE 'order\\_%' ESCAPE '\\' THEN 'economy'
       WHEN indicator LIKE '%\\_share' ESCAPE '\\' THEN 'trade' ELSE 'digital' END AS domain
  FROM obs WHERE dataset IN ('shipments_world','orders_world','events_daily')
    AND (indicator NOT LIKE '%\\_count' ESCAPE '\\' OR indicator = 'order_count'))
"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records: one ingestion per order month and priority, published per order year."""
    p, year = "substr(o_orderpriority, 1, 1)", "date_format(period, 'yyyy')"
    return spark.sql(f"""SELECT concat('{SITE}orders/', {year}, '/', {p}) AS source_url,
  if({p} = '1', 'World Bank · World Development Indicators', 'Statistics Bureau') AS source,
  if({p} = '2', concat('raw/table_1_year_', {year}, '.xlsx'), concat('raw/orders ', {year}, '.csv')) AS original_file,
  concat(date_format(trunc(period, 'QUARTER'), 'yyyy-MM-dd'), 'T00:00:00+00:00') AS completed_at,
  concat('manifests/', date_format(period, 'yyyyMM'), '-', {p}, '.json') AS manifest_path,
  concat('license ', {p}) AS license,
  raw_rows, rejected_rows, duplicates, missing_values, raw_rows - rejected_rows - duplicates AS processed_rows
FROM (SELECT trunc(CAST(o_orderdate AS DATE), 'MM') AS period, o_orderpriority, count(*) AS raw_rows,
    count_if(o_orderstatus = 'P') AS rejected_rows, count_if(o_orderstatus = 'F' AND o_custkey % 10 = 0) AS duplicates,
    count_if(o_custkey % 7 = 0) AS missing_values
  FROM parquet.`{sf_dir}/orders.parquet` GROUP BY 1, 2)""")


MANIFESTS = f"""
manifests AS (SELECT '{SITE}orders/' || strftime(period, '%Y') || '/' || substr(o_orderpriority, 1, 1) AS source_url,
  CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'World Bank · World Development Indicators' ELSE 'Statistics Bureau' END AS source,
  CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'raw/table_1_year_' || strftime(period, '%Y') || '.xlsx'
       ELSE 'raw/orders ' || strftime(period, '%Y') || '.csv' END AS original_file,
  strftime(date_trunc('quarter', period), '%Y-%m-%d') || 'T00:00:00+00:00' AS completed_at,
  'manifests/' || strftime(period, '%Y%m') || '-' || substr(o_orderpriority, 1, 1) || '.json' AS manifest_path,
  'license ' || substr(o_orderpriority, 1, 1) AS license,
  raw_rows, rejected_rows, duplicates, missing_values, raw_rows - rejected_rows - duplicates AS processed_rows
  FROM (SELECT date_trunc('month', o_orderdate) AS period, o_orderpriority, count(*) AS raw_rows,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS rejected_rows,
    count(*) FILTER (WHERE o_orderstatus = 'F' AND o_custkey % 10 = 0) AS duplicates,
    count(*) FILTER (WHERE o_custkey % 7 = 0) AS missing_values FROM orders GROUP BY 1, 2))
"""
