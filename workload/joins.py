"""Batch against fact, dictionary and provenance joins, merges."""

from pyspark.sql import functions as F

from statweave.operators import catalog, compare, merge, reconcile
from statweave.operators import validate as V
from statweave.schema import FACT_COLUMNS, KEY
from statweave.session import materialized

from .observations import (
    DICTIONARY, MANIFESTS, OBS, RAW1, RAW2, RAW_URL, SEQUENCE, SITE, WORLD, dictionary, manifests, obs, raw, table,
)
from .registry import query

_K = "dataset, indicator, geography, period, unit, frequency"
_ID = "dataset, indicator, geography, CAST(period AS VARCHAR) AS period, unit, frequency"


def accepted(spark, d, vintage):
    """First valid row per key of a raw batch, as fact rows."""
    rows = V.staged(V.typed(raw(spark, d, vintage), RAW_URL), SEQUENCE).filter("outcome = 'accepted'")
    return rows.select(
        *KEY, "value", "source_url", F.lit(f"v{vintage}").alias("dataset_version"), F.lit(f"run-{vintage}").alias("ingestion_id")
    ).select(*FACT_COLUMNS)


def stored(spark, d, vintage):
    """The accepted batch as a written table, the way an ingestion merges it."""
    return materialized(accepted(spark, d, vintage), f"accepted-v{vintage}")


@query("keep_first", f"WITH {RAW2} SELECT {_ID}, value FROM accepted_v2")
def keep_first(spark, d):
    return accepted(spark, d, 2).select(*KEY, "value")


@query("unseen_rows", f"WITH {RAW1}, {RAW2} SELECT {_ID}, value FROM accepted_v2 ANTI JOIN accepted_v1 USING ({_K})")
def unseen_rows(spark, d):
    return merge.unseen(stored(spark, d, 2), stored(spark, d, 1)).select(*KEY, "value")


@query(
    "inserted_by_dataset",
    f"""WITH {RAW1}, {RAW2} SELECT dataset, indicator, count(*) AS inserted_rows FROM accepted_v2 ANTI JOIN accepted_v1 USING ({_K}) GROUP BY 1, 2""",
)
def inserted_by_dataset(spark, d):
    fresh = merge.unseen(stored(spark, d, 2), stored(spark, d, 1))
    return fresh.groupBy("dataset", "indicator").agg(F.count("*").alias("inserted_rows"))


@query(
    "value_revisions",
    f"""WITH {RAW1}, {RAW2} SELECT {_ID}, f.value AS old_value, a.value AS new_value, f.ingestion_id AS previous_ingestion_id, a.ingestion_id
  FROM accepted_v2 a JOIN accepted_v1 f USING ({_K}) WHERE a.value <> f.value""",
)
def value_revisions(spark, d):
    return merge.revisions(stored(spark, d, 2), stored(spark, d, 1))


@query(
    "upserted_fact",
    f"""WITH {RAW1}, {RAW2} SELECT {_ID}, value, dataset_version, ingestion_id FROM accepted_v2 UNION ALL
  SELECT {_ID}, value, dataset_version, ingestion_id FROM accepted_v1 ANTI JOIN accepted_v2 USING ({_K})""",
)
def upserted_fact(spark, d):
    return merge.upsert(stored(spark, d, 1), stored(spark, d, 2)).select(*KEY, "value", "dataset_version", "ingestion_id")


@query(
    "audited_upsert",
    f"""WITH {RAW1}, {RAW2} SELECT {_ID}, coalesce(a.value, f.value) AS value, CASE WHEN a.value IS NULL THEN 'kept' WHEN f.value IS NULL THEN 'inserted'
    WHEN a.value <> f.value THEN 'revised' ELSE 'refreshed' END AS change,
    CASE WHEN a.value IS NOT NULL THEN f.value END AS prior_value, CASE WHEN a.value IS NOT NULL THEN f.ingestion_id END AS prior_ingestion_id
  FROM accepted_v2 a FULL JOIN accepted_v1 f USING ({_K})""",
)
def audited_upsert(spark, d):
    return merge.audited_upsert(stored(spark, d, 1), stored(spark, d, 2)).select(
        *KEY, "value", "change", "prior_value", "prior_ingestion_id"
    )


@query(
    "matched_pairs",
    f"""WITH {OBS} SELECT a.geography, a.frequency, CAST(a.period AS VARCHAR) AS period, a.value AS value_a, b.value AS value_b
  FROM obs a JOIN obs b ON a.geography = b.geography AND a.frequency = b.frequency AND a.period = b.period
  WHERE a.indicator = 'ship_value' AND b.indicator = 'order_value'""",
)
def matched_pairs(spark, d):
    return compare.matched_pairs(obs(spark, d), "ship_value", "order_value").select(
        "geography", "frequency", "period", "value_a", "value_b"
    )


@query(
    "series_comparison",
    f"""WITH {OBS} SELECT CAST(a.period AS VARCHAR) AS period, a.value AS value_a, b.value AS value_b
  FROM obs a JOIN obs b ON a.period = b.period WHERE a.indicator = 'ship_value' AND b.indicator = 'order_value'
    AND a.geography = '{WORLD}' AND b.geography = '{WORLD}'""",
)
def series_comparison(spark, d):
    return compare.compare(obs(spark, d), "ship_value", "order_value", WORLD)


@query(
    "dictionary_lookup",
    f"""WITH {OBS}, {DICTIONARY} SELECT {_ID.replace('indicator', 'obs.indicator').replace('unit', 'obs.unit').replace('frequency', 'obs.frequency')},
    value, title, domain FROM obs LEFT JOIN dictionary ON obs.indicator = dictionary.indicator""",
)
def dictionary_lookup(spark, d):
    return catalog.with_dictionary(obs(spark, d), dictionary(spark, d)).select(*KEY, "value", "title", "domain")


@query(
    "indicator_metadata",
    f"""WITH {OBS}, {DICTIONARY}, o AS (SELECT DISTINCT ON (indicator) indicator, unit, source_url FROM obs
    ORDER BY indicator, period, geography, dataset, unit)
  SELECT o.indicator, coalesce(title, list_aggregate(list_transform(string_split(replace(o.indicator, '_', ' '), ' '),
      lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ')) AS title,
    coalesce(domain, 'population') AS domain, CASE WHEN title IS NULL THEN 'Statistics Bureau' END AS default_source,
    o.unit, source_url, title IS NOT NULL AS in_dictionary
  FROM o LEFT JOIN dictionary d ON o.indicator = d.indicator""",
)
def indicator_metadata(spark, d):
    return catalog.indicator_metadata(obs(spark, d), dictionary(spark, d), "Statistics Bureau")


def _publications(spark, d):
    """Observations carrying the publication URL of the order manifests."""
    return spark.sql(f"""SELECT DISTINCT concat('orders_', substr(o_orderpriority, 1, 1)) AS dataset,
      concat('{SITE}orders/', year(o_orderdate), '/', substr(o_orderpriority, 1, 1)) AS source_url FROM parquet.`{d}/orders.parquet`
      UNION ALL SELECT DISTINCT concat('unlisted_', o_orderstatus), concat('{SITE}unlisted/', year(o_orderdate)) FROM parquet.`{d}/orders.parquet`""")


_PUB = f"""fact AS (SELECT DISTINCT 'orders_' || substr(o_orderpriority, 1, 1) AS dataset,
    '{SITE}orders/' || year(o_orderdate) || '/' || substr(o_orderpriority, 1, 1) AS source_url FROM orders
  UNION ALL SELECT DISTINCT 'unlisted_' || o_orderstatus, '{SITE}unlisted/' || year(o_orderdate) FROM orders)"""


@query(
    "provenance",
    f"""WITH {MANIFESTS}, {_PUB} SELECT dataset, f.source_url, runs, license, last_completed_at FROM fact f LEFT JOIN (
  SELECT source_url, count(*) AS runs, arg_max(license, completed_at || manifest_path) AS license, max(completed_at) AS last_completed_at
  FROM manifests GROUP BY 1) m ON f.source_url = m.source_url""",
)
def provenance(spark, d):
    return catalog.provenance(_publications(spark, d), manifests(spark, d))


@query(
    "missing_provenance",
    f"""WITH {MANIFESTS}, {_PUB} SELECT dataset, source_url FROM fact WHERE source_url NOT IN (SELECT source_url FROM manifests)""",
)
def missing_provenance(spark, d):
    return catalog.without_provenance(_publications(spark, d), manifests(spark, d)).select("dataset", "source_url")


@query(
    "geography_matches",
    f"""WITH {OBS}, l AS (SELECT DISTINCT geography FROM obs WHERE dataset IN ('shipments_nation', 'shipments_world')),
  r AS (SELECT n_name AS geography FROM nation UNION SELECT r_name FROM region)
  SELECT coalesce(l.geography, r.geography) AS geography, CASE WHEN r.geography IS NULL THEN 'left_only' WHEN l.geography IS NULL
    THEN 'right_only' ELSE 'both' END AS "match" FROM l FULL JOIN r ON l.geography = r.geography""",
)
def geography_matches(spark, d):
    places = table(spark, d, "nation").select(F.col("n_name").alias("geography")).unionByName(
        table(spark, d, "region").select(F.col("r_name").alias("geography"))
    )
    return reconcile.match_geographies(obs(spark, d, "shipments_nation", "shipments_world"), places)


@query(
    "comparable_indicators",
    f"""WITH {OBS}, {DICTIONARY} SELECT b.indicator, b.domain, b.unit, b.frequency FROM dictionary a JOIN dictionary b
  ON a.domain = b.domain AND a.unit = b.unit AND a.frequency = b.frequency WHERE a.indicator = 'click_value' AND b.indicator <> 'click_value'""",
)
def comparable_indicators(spark, d):
    return reconcile.comparable_indicators(dictionary(spark, d), "click_value").select("indicator", "domain", "unit", "frequency")


def _part_config(spark, d):
    return table(spark, d, "part").select(
        F.concat(F.lit("P."), "p_partkey").alias("code"),
        F.concat(F.translate("p_name", " ", "_"), F.lit("_"), "p_partkey").alias("indicator"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") > 25, "tonnes").otherwise("persons").alias("unit"),
        F.lower("p_type").alias("domain"),
    )


def _definitions(spark, d):
    """Publisher definitions exist for the parts returned from one large order line."""
    ordered = table(spark, d, "lineitem").filter("l_quantity > 45 AND l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return ordered.select(
        F.concat(F.lit("P."), "l_partkey").alias("code"), F.concat(F.lit("ordered "), "n", F.lit(" times")).alias("definition")
    )


_CONFIG = """config AS (SELECT 'P.' || p_partkey AS code, replace(p_name, ' ', '_') || '_' || p_partkey AS indicator, p_name AS title,
    CASE WHEN p_size > 25 THEN 'tonnes' ELSE 'persons' END AS unit, lower(p_type) AS domain FROM part),
  definitions AS (SELECT 'P.' || l_partkey AS code, 'ordered ' || count(*) || ' times' AS definition FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' GROUP BY l_partkey)"""


@query(
    "dictionary_build",
    f"""WITH {_CONFIG} SELECT code, indicator, title, unit, CASE WHEN indicator IN ('small_ring_0', 'red_widget_1') THEN 'services' ELSE domain END AS domain,
  definition FROM config JOIN definitions USING (code)""",
)
def dictionary_build(spark, d):
    return catalog.build_dictionary(
        _part_config(spark, d), _definitions(spark, d), {"small_ring_0": "services", "red_widget_1": "services"}
    ).select("code", "indicator", "title", "unit", "domain", "definition")


@query("undefined_codes", f"WITH {_CONFIG} SELECT code, indicator FROM config ANTI JOIN definitions USING (code)")
def undefined_codes(spark, d):
    return catalog.undefined_codes(_part_config(spark, d), _definitions(spark, d)).select("code", "indicator")


@query(
    "dictionary_merge",
    f"""WITH {_CONFIG}, fresh AS (SELECT indicator, upper(title) AS title, unit FROM config JOIN definitions USING (code) WHERE unit = 'tonnes')
  SELECT indicator, title, unit FROM fresh UNION ALL SELECT indicator, title, unit FROM config ANTI JOIN fresh USING (indicator)""",
)
def dictionary_merge(spark, d):
    old = _part_config(spark, d).select("indicator", "title", "unit")
    fresh = _part_config(spark, d).join(_definitions(spark, d), "code", "left_semi").filter("unit = 'tonnes'")
    return merge.merge_dictionary(old, fresh.select("indicator", F.upper("title").alias("title"), "unit"))


@query(
    "dimension_insert_absent",
    f"""WITH {OBS}, dim AS (SELECT n_name AS geography, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT geography, parent FROM dim UNION ALL SELECT DISTINCT geography, NULL FROM obs WHERE geography NOT IN (SELECT geography FROM dim)""",
)
def dimension_insert_absent(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    dim = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("geography"), F.col("r_name").alias("parent"))
    return merge.insert_absent(dim, obs(spark, d), "geography")


@query(
    "multi_source_union",
    f"""WITH {OBS} SELECT {_ID}, value, 'shipments' AS origin FROM obs WHERE dataset = 'shipments_nation' UNION ALL
  SELECT {_ID}, value, 'orders' AS origin FROM obs WHERE dataset = 'orders_nation'""",
)
def multi_source_union(spark, d):
    a = obs(spark, d, "shipments_nation").withColumn("origin", F.lit("shipments"))
    b = obs(spark, d, "orders_nation").withColumn("origin", F.lit("orders"))
    return a.unionByName(b).select(*KEY, "value", "origin")
