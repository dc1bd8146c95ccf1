"""Filters, paging, searching, ordering."""

import datetime as dt

from pyspark.sql import functions as F

from statweave.operators import select as S
from statweave.operators import series as W
from statweave.schema import KEY

from .observations import DICTIONARY, MANIFESTS, OBS, WORLD, dictionary, manifests, obs
from .registry import query

_ID = "dataset, indicator, geography, CAST(period AS VARCHAR) AS period, unit, frequency"
_PCT = "(value / nullif(lag(value) OVER w, 0) - 1.0::DOUBLE) * 100.0::DOUBLE"
_SERIES = "PARTITION BY dataset, indicator, geography, unit, frequency ORDER BY period"


@query(
    "series_pct_change_page",
    f"""WITH {OBS} SELECT {_ID}, round(value, 6) AS value, source_url FROM (
  SELECT * EXCLUDE (value), {_PCT} AS value FROM obs WHERE indicator = 'ship_value' AND geography = '{WORLD}'
  WINDOW w AS ({_SERIES})) ORDER BY dataset, frequency, period LIMIT 50 OFFSET 10""",
)
def series_pct_change_page(spark, d):
    rows = S.timeseries(obs(spark, d), "ship_value", WORLD, how="pct_change", limit=50, offset=10)
    return rows.select(*KEY, F.round("value", 6).alias("value"), "source_url")


@query(
    "series_page_with_total",
    f"""WITH {OBS} SELECT {_ID}, round(value, 6) AS value, count(*) OVER () AS total FROM (
  SELECT * EXCLUDE (value), {_PCT} AS value FROM obs WHERE indicator = 'ship_value' AND geography = 'NATION_2' AND frequency = 'monthly'
    AND period BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' WINDOW w AS ({_SERIES})) ORDER BY dataset, frequency, period, unit LIMIT 12 OFFSET 24""",
)
def series_page_with_total(spark, d):
    """A page of a transformed series in a range, with the number of all its rows."""
    found = S.timeseries_page(obs(spark, d), "ship_value", "NATION_2", how="pct_change", frequency="monthly", start="1996", end="1999", limit=12, offset=24)
    return found["rows"].select(*KEY, F.round("value", 6).alias("value"), F.lit(found["total"]).cast("long").alias("total"))


@query(
    "page_after_key",
    f"""WITH {OBS} SELECT {_ID}, value FROM obs WHERE (dataset, indicator, geography, period, unit, frequency)
  > ('shipments_nation', 'ship_qty', 'NATION_4', DATE '1998-03-01', 'tonnes', 'monthly') ORDER BY ALL LIMIT 100""",
)
def page_after_key(spark, d):
    """The hundred observations behind a key."""
    after = dict(dataset="shipments_nation", indicator="ship_qty", geography="NATION_4", period=dt.date(1998, 3, 1), unit="tonnes", frequency="monthly")
    return S.page_after(obs(spark, d).select(*KEY, "value"), KEY, after, 100)


@query(
    "series_selection",
    f"""WITH {OBS} SELECT {_ID}, value, source_url FROM obs WHERE indicator = 'ship_value' AND geography = 'NATION_7'
  AND frequency = 'monthly' AND dataset = 'shipments_nation'""",
)
def series_selection(spark, d):
    rows = S.series_of(obs(spark, d), "ship_value", "NATION_7", dataset="shipments_nation", frequency="monthly")
    return rows.select(*KEY, "value", "source_url")


@query(
    "period_range_partial_dates",
    f"""WITH {OBS} SELECT {_ID}, value FROM obs WHERE indicator = 'ship_qty' AND geography = 'NATION_3'
  AND CAST(period AS VARCHAR) >= '1997' AND CAST(period AS VARCHAR) <= '1999-06' || '-31'""",
)
def period_range(spark, d):
    return S.series_of(obs(spark, d), "ship_qty", "NATION_3", start="1997", end="1999-06").select(*KEY, "value")


def _topic_sql(topic):
    tests = " OR ".join(
        f"lower(dataset) LIKE '%{t}%' OR lower(indicator) LIKE '%{t}%'" for t in S.TOPICS[topic]
    )
    return f"({tests})"


# Topic words are matched inside names; these observations use shipment and order names,
# so the terms of the query are given by the caller as a topic of their own.
S_TOPICS = {"deliveries": ("ship_v", "order_", "click")}


@query(
    "topic_rows",
    f"""WITH {OBS} SELECT {_ID}, value FROM obs WHERE lower(dataset) LIKE '%ship_v%' OR lower(indicator) LIKE '%ship_v%'
  OR lower(dataset) LIKE '%order_%' OR lower(indicator) LIKE '%order_%' OR lower(dataset) LIKE '%click%' OR lower(indicator) LIKE '%click%'""",
)
def topic_rows(spark, d):
    return obs(spark, d).filter(S.topic_predicate("deliveries", S_TOPICS)).select(*KEY, "value")


@query(
    "topic_coverage",
    f"WITH {OBS} "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS topic, count(*) AS observations FROM obs WHERE {_topic_sql(t)}" for t in S.TOPICS
    ),
)
def topic_coverage(spark, d):
    rows = obs(spark, d)
    counted = rows.agg(*[F.count_if(S.topic_predicate(t)).alias(t) for t in S.TOPICS])
    return counted.unpivot([], list(S.TOPICS), "topic", "observations")


@query(
    "recent_first_page",
    f"""WITH {OBS} SELECT {_ID}, value FROM obs ORDER BY period DESC, dataset, indicator, geography, unit, frequency
  LIMIT 100 OFFSET 25""",
)
def recent_first_page(spark, d):
    return S.recent_first(obs(spark, d), limit=100, offset=25).select(*KEY, "value")


@query(
    "report_publisher_years",
    f"""WITH {OBS} SELECT {_ID}, value FROM obs WHERE year(period) BETWEEN 1996 AND 1999 AND starts_with(dataset, 'orders_')""",
)
def report_publisher_years(spark, d):
    rows = S.report_rows(obs(spark, d), 1996, 1999, "orders", {"orders": "orders_"})
    return rows.select(*KEY, "value")


_EXTRA = {"economy": ["returned_share", "click_count"]}  # the dictionary lacks click_count


@query(
    "subject_export",
    f"""WITH {OBS}, {DICTIONARY}
  SELECT 'overview' AS subject, {_ID}, value FROM obs WHERE geography = '{WORLD}' UNION ALL
  SELECT 'geographies' AS subject, {_ID}, value FROM obs WHERE geography = 'NATION_4' UNION ALL
  SELECT 'economy' AS subject, {_ID}, value FROM obs WHERE indicator IN (SELECT indicator FROM dictionary WHERE domain = 'economy')
    OR indicator IN ('returned_share', 'click_count')""",
)
def subject_export(spark, d):
    rows, words = obs(spark, d), dictionary(spark, d)
    parts = [
        S.subject_rows(rows, words, subject, geography, _EXTRA).select(F.lit(subject).alias("subject"), *KEY, "value")
        for subject, geography in (("overview", WORLD), ("geographies", "NATION_4"), ("economy", ""))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "catalog_search",
    f"""WITH {MANIFESTS} SELECT source_url, manifest_path, processed_rows FROM manifests
  WHERE lower(source || '|' || source_url || '|' || original_file || '|' || completed_at || '|' || license || '|' || manifest_path)
    LIKE '%year_1997%'""",
)
def catalog_search(spark, d):
    return S.search(manifests(spark, d), "YEAR_1997").select("source_url", "manifest_path", "processed_rows")


@query("sorted_by_value", f"WITH {OBS} SELECT {_ID}, value FROM obs ORDER BY value DESC, dataset, indicator, geography, obs.period, unit, frequency")
def sorted_by_value(spark, d):
    return S.sorted_by(obs(spark, d), "value", descending=True).select(*KEY, "value")


@query(
    "top_geographies",
    f"""WITH {OBS} SELECT geography, value FROM obs WHERE dataset = 'shipments_supplier' AND indicator = 'ship_value'
  AND period = DATE '1998-03-01' ORDER BY value DESC, geography LIMIT 10""",
)
def top_geographies(spark, d):
    rows = S.series_of_dataset(obs(spark, d, "shipments_supplier"), "shipments_supplier", "ship_value", "1998-03")
    return S.top(rows, 10, F.desc("value"), F.asc("geography")).select("geography", "value")


@query(
    "bounded_workspace",
    f"""WITH {OBS} SELECT {_ID}, value FROM obs""",
)
def bounded_workspace(spark, d):
    """The whole workspace in the order of its key."""
    return S.snapshot(obs(spark, d)).select(*KEY, "value")
