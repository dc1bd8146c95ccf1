"""Sources and sinks, each written to the shared folder and read back."""

from pyspark.sql import functions as F

from statweave.functions import text
from statweave.operators import validate as V
from statweave.plans.mirror import Mirror
from statweave.plans.warehouse import Metadata, Warehouse
from statweave.schema import COLUMNS, KEY
from statweave.session import scratch_path
from statweave.sources import files
from statweave.streaming import firsts
from statweave.streaming import ingest as streaming

from .observations import (
    MANIFESTS, OBS, RAW1, RAW2, RAW_URL, SEQUENCE, SITE, WORLD, manifests, obs, raw, table,
)
from .registry import query

_K = "dataset, indicator, geography, period, unit, frequency"
_ID = "dataset, indicator, geography, CAST(period AS VARCHAR) AS period, unit, frequency"


def _meta(version: str) -> Metadata:
    return Metadata(
        source="Statistics Bureau", source_url=RAW_URL, retrieval_date="2024-01-31T00:00:00Z", original_file="ship.csv",
        dataset_version=version, geographic_level="national", time_period="1995/2001",
    )


FILE_ROWS = 500_000  # rows that one task sorts and one file holds; files grow in number, not in size


def _file_count(df, least):
    return max(least, -(-df.count() // FILE_ROWS))


def _as_csv(df, path, sort=SEQUENCE):
    """Rows as CSV files whose (file, position) order is the order of ``sort``."""
    # A further column, as published files have them; readers drop it.
    df.repartitionByRange(_file_count(df, 8), *sort).sortWithinPartitions(*sort).select(F.lit("n/a").alias("note"), *COLUMNS).write.options(
        header=True, quote='"', escape='"', quoteAll=True
    ).csv(path)
    return path


@query(
    "csv_scan",
    f"""WITH {RAW2} SELECT dataset, trim(indicator, ' ' || chr(9) || chr(10)) AS indicator, trim(geography) AS geography, period, value, unit, frequency,
  source_url, count(*) AS n FROM raw_v2 GROUP BY ALL""",
)
def csv_scan(spark, d):
    path = _as_csv(raw(spark, d), scratch_path(spark, "csv"))
    rows = V.strip_fields(files.read_csv(spark, path))
    return rows.groupBy(*COLUMNS).agg(F.count("*").alias("n"))


@query("content_digest", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents")
def content_digest(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", files.content_digest(F.col("text")).alias("sha256"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


_DIGESTED = {
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "pages": ["page_id", "url", "html"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def _digest_sql(name, columns):
    row = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '?')" for c in columns)
    sums = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))
    return f"""SELECT n, sha256(concat_ws(':', CAST(n AS VARCHAR), s[1], s[2], s[3], s[4])) AS digest, '{name}' AS "table"
  FROM (SELECT count(*) AS n, [{sums}] AS s FROM (SELECT sha256(concat_ws('|', {row})) AS h FROM {name}))"""


@query("table_digest", " UNION ALL ".join(_digest_sql(*item) for item in _DIGESTED.items()))
def table_digest(spark, d):
    """Order-free identity of whole tables, all columns."""
    parts = []
    for name, columns in _DIGESTED.items():
        row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns])
        digests = table(spark, d, name).select(files.content_digest(row).alias("sha256"))
        parts.append(files.multiset_digest(digests).withColumn("table", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ingested(spark, d, *vintages):
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    for v in vintages:
        warehouse.ingest(raw(spark, d, v), SEQUENCE, _meta(f"v{v}"), f"vintage-{v}")
    return warehouse


@query("silver_rows", f"WITH {RAW2} SELECT {_ID}, value, source_url FROM accepted_v2")
def silver_rows(spark, d):
    warehouse = _ingested(spark, d, 2)
    silver = warehouse.manifests().first().silver_path
    return spark.read.parquet(f"{silver}/outcome=accepted").select(*KEY, "value", "source_url")


@query(
    "gold_years",
    f"""WITH {RAW2} SELECT CAST(year(period) AS INT) AS partition_year, count(*) AS observations, CAST(min(period) AS VARCHAR) AS first_period,
  CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS total FROM accepted_v2 GROUP BY 1""",
)
def gold_years(spark, d):
    gold = _ingested(spark, d, 2).manifests().first().gold_path
    return spark.read.parquet(gold).groupBy("partition_year").agg(
        F.count("*").alias("observations"), F.min("period").alias("first_period"),
        F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("total"),
    )


@query(
    "fact_after_two_ingestions",
    f"""WITH {RAW1}, {RAW2} SELECT {_ID}, value, dataset_version FROM accepted_v2 UNION ALL
  SELECT {_ID}, value, dataset_version FROM accepted_v1 ANTI JOIN accepted_v2 USING ({_K})""",
)
def fact_after_two_ingestions(spark, d):
    return _ingested(spark, d, 1, 2).fact().select(*KEY, "value", "dataset_version")


@query(
    "revision_audit",
    f"""WITH {RAW1}, {RAW2} SELECT {_ID}, f.value AS old_value, a.value AS new_value FROM accepted_v2 a JOIN accepted_v1 f USING ({_K})
  WHERE a.value <> f.value""",
)
def revision_audit(spark, d):
    return _ingested(spark, d, 1, 2).revisions().select(*KEY, "old_value", "new_value")


def _manifest_sql(v, revised, inserted):
    return f"""SELECT 'v{v}' AS dataset_version, (SELECT count(*) FROM typed_v{v}) AS raw_rows, (SELECT count(*) FROM accepted_v{v}) AS processed_rows,
    (SELECT count(*) FROM typed_v{v} WHERE NOT valid) AS rejected_rows,
    (SELECT count(*) FROM typed_v{v} WHERE valid) - (SELECT count(*) FROM accepted_v{v}) AS duplicates,
    (SELECT CAST(sum(blanks) AS BIGINT) FROM typed_v{v}) AS missing_values, ({revised}) AS revisions, ({inserted}) AS inserted_rows,
    (SELECT min(value) FROM accepted_v{v}) AS min_value, (SELECT max(value) FROM accepted_v{v}) AS max_value"""


@query(
    "ingestion_manifests",
    f"""WITH {RAW1}, {RAW2} {_manifest_sql(1, "SELECT 0", "SELECT count(*) FROM accepted_v1")} UNION ALL {_manifest_sql(
        2, f"SELECT count(*) FROM accepted_v2 a JOIN accepted_v1 f USING ({_K}) WHERE a.value <> f.value",
        f"SELECT count(*) FROM accepted_v2 ANTI JOIN accepted_v1 USING ({_K})")}""",
)
def ingestion_manifests(spark, d):
    return _ingested(spark, d, 1, 2).manifests().select(
        "dataset_version", "raw_rows", "processed_rows", "rejected_rows", "duplicates", "missing_values", "revisions",
        "inserted_rows", "quality.min_value", "quality.max_value",
    )


@query("repeated_ingestion", "SELECT 'already_ingested' AS status, 1 AS runs, count(*) AS source_rows FROM lineitem")
def repeated_ingestion(spark, d):
    """The same source a second time leaves one run in the log."""
    path = _as_csv(raw(spark, d), scratch_path(spark, "csv"))
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    warehouse.ingest_csv(path, _meta("v2"))
    again = warehouse.ingest_csv(path, _meta("v2"))
    return warehouse.manifests().agg(
        F.lit(again["ingestion_status"]).alias("status"), F.count("*").cast("int").alias("runs"),
        F.sum("raw_rows").alias("source_rows"),
    )


@query(
    "fact_scan",
    f"""WITH {RAW2} SELECT CAST(period AS VARCHAR) AS period, value FROM accepted_v2 WHERE indicator = 'price_rf' AND geography = 'NATION_5'
  AND period BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' AND unit = 'usd'""",
)
def fact_scan(spark, d):
    rows = _ingested(spark, d, 2).fact("1997", "1998-06")
    return rows.filter("indicator = 'price_rf' AND geography = 'NATION_5' AND unit = 'usd'").select("period", "value")


@query(
    "indexed_series",
    f"""WITH {RAW2} SELECT {_ID}, value FROM accepted_v2 WHERE indicator = 'price_af' AND geography = 'NATION_7' AND period >= DATE '1996-01-01'""",
)
def indexed_series(spark, d):
    """One indicator of one geography, through the index of parts."""
    return _ingested(spark, d, 1, 2).series("price_af", "NATION_7", start="1996").select(*KEY, "value")


@query(
    "json_records",
    """SELECT event_type AS indicator, CAST(event_id AS VARCHAR) AS record, json_extract_string(props, '$.k') AS value FROM events""",
)
def json_records(spark, d):
    rows = spark.sql(
        f"SELECT event_id AS id, event_type AS kind, from_json(props, 'k STRING').k AS amount FROM parquet.`{d}/events.parquet`"
    )
    path = scratch_path(spark, "json")
    # Reports of some hundred records, one list and file each.
    lists = rows.groupBy(F.floor(F.col("id") / 500).alias("part")).agg(F.to_json(F.collect_list(F.struct("id", "kind", "amount"))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.json_records(spark, path, {"kind": "indicator", "id": "record", "amount": "value"})


def _payloads(spark, d):
    """One API response per event type and year-like id, with nulls where the source has none."""
    return spark.sql(f"""SELECT event_type, concat('[{{"page":1}},', to_json(collect_list(named_struct(
        'indicator', named_struct('id', concat('EV.', upper(event_type))), 'countryiso3code', 'WLD', 'date', CAST(1000 + day AS STRING), 'value', v))), ']') AS payload
      FROM (SELECT event_type, dayofyear(ts) AS day, if(dayofyear(ts) % 5 = 0, NULL, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)) AS v
            FROM parquet.`{d}/events.parquet` GROUP BY 1, 2) GROUP BY event_type""")


def _codes(spark, d):
    return spark.sql(f"""SELECT DISTINCT concat('EV.', upper(event_type)) AS code, concat(event_type, '_total') AS indicator, 'score' AS unit,
      if(event_type = 'error', 'environment', 'digital') AS domain FROM parquet.`{d}/events.parquet`""")


@query(
    "payload_observations",
    f"""SELECT CASE WHEN event_type = 'error' THEN 'worldbank_environment' ELSE 'worldbank_digital' END AS dataset, event_type || '_total' AS indicator,
  '{WORLD}' AS geography, (1000 + dayofyear(ts)) || '-01-01' AS period, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, 'score' AS unit,
  'annual' AS frequency, '{SITE}api' AS source_url FROM events WHERE dayofyear(ts) % 5 <> 0 GROUP BY event_type, dayofyear(ts)""",
)
def payload_observations(spark, d):
    records = files.payload_records(_payloads(spark, d))
    return files.payload_observations(records, _codes(spark, d), WORLD, SITE + "api")


@query(
    "payload_violations",
    """SELECT 'EV.' || upper(event_type) AS code, 'unrequested' AS reason, count(*) AS records FROM (
  SELECT DISTINCT event_type, dayofyear(ts) AS day FROM events) WHERE event_type = 'error' AND day % 5 <> 0 GROUP BY 1""",
)
def payload_violations(spark, d):
    requested = _codes(spark, d).filter("code <> 'EV.ERROR'")
    bad = files.payload_violations(files.payload_records(_payloads(spark, d)), requested, "WLD")
    return bad.groupBy("code", "reason").agg(F.count("*").alias("records"))


@query(
    "manifest_files",
    f"WITH {MANIFESTS} SELECT source_url, completed_at, raw_rows, rejected_rows, duplicates, processed_rows FROM manifests",
)
def manifest_files(spark, d):
    path = scratch_path(spark, "manifests")
    one_per_file = manifests(spark, d).select(F.to_json(F.struct("*")).alias("value"))
    one_per_file.write.option("maxRecordsPerFile", 1).text(path)
    read = files.read_manifests(spark, path)
    return read.select("source_url", "completed_at", "raw_rows", "rejected_rows", "duplicates", "processed_rows")


@query(
    "csv_export_lines",
    """SELECT page_id, '"' || page_id || '","' || replace(url, '"', '""') || '","' || replace(html, '"', '""') || '"' AS line FROM pages""",
)
def csv_export_lines(spark, d):
    return table(spark, d, "pages").select("page_id", text.csv_line(F.col("page_id"), F.col("url"), F.col("html")).alias("line"))


@query("csv_export_roundtrip", "SELECT page_id, url, sha256(html) AS sha256 FROM pages")
def csv_export_roundtrip(spark, d):
    """Whole pages, line breaks and quotes included, through the quoted export and back."""
    path = scratch_path(spark, "export")
    files.write_csv(table(spark, d, "pages"), path)
    # Windows line ends inside fields must come back unchanged, so only LF separates records.
    back = spark.read.options(header=True, multiLine=True, quote='"', escape='"', lineSep="\n").schema(
        "page_id bigint, url string, html string"
    ).csv(path)
    return back.select("page_id", "url", files.content_digest(F.col("html")).alias("sha256"))


_REPORT = ["ship_value", "ship_qty", "ship_lines", "order_value"]


def _report(spark, d):
    """The monthly report of each nation as printed lines, with a section after the marker."""
    return spark.sql(f"""SELECT n_name, concat('Indices', chr(10), array_join(transform(array_sort(collect_list(struct(y, m, line))), x -> x.line), chr(10)),
        chr(10), 'Historical Inflation Rate', chr(10), '2099 1 1.0 1.0 1.0 1.0', chr(10)) AS text
      FROM (SELECT n_name, y, m, concat('  ', 2000 + y - 1995, '  ', m, '  ', price, ' ', qty, ' ', n, ' ', disc, ' x') AS line
        FROM (SELECT n_name, year(l_shipdate) AS y, month(l_shipdate) AS m, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price,
            CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,1)) AS qty, count(*) AS n, sum(CAST(l_discount AS DECIMAL(18,2))) AS disc
          FROM parquet.`{d}/lineitem.parquet` JOIN parquet.`{d}/supplier.parquet` ON l_suppkey = s_suppkey
          JOIN parquet.`{d}/nation.parquet` ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)) GROUP BY n_name""")


@query(
    "report_lines",
    """WITH r AS (SELECT n_name, 2000 + year(l_shipdate) - 1995 AS year, month(l_shipdate) AS month, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS a,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS c, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS d
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)
  SELECT n_name, CAST(year AS INT) AS year, CAST(month AS INT) AS month, unnest(['ship_value', 'ship_qty', 'ship_lines', 'discount']) AS indicator,
    unnest([a, b, c, d]) AS value FROM r""",
)
def report_lines(spark, d):
    return files.report_rows(_report(spark, d), ["ship_value", "ship_qty", "ship_lines", "discount"])


# ------------------------------------------------------------------ streams and the mirror


@query("streamed_fact", f"WITH {RAW2} SELECT {_ID}, value FROM accepted_v2")
def streamed_fact(spark, d):
    """File stream, a quarter of the files per micro-batch; the result equals the one-batch ingestion."""
    rows = raw(spark, d)
    folder = _as_csv(rows, scratch_path(spark, "stream-csv"))
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    streaming.ingest_stream(warehouse, folder, _meta("v2"), "stream", files_per_trigger=-(-_file_count(rows, 8) // 4))
    return warehouse.fact().select(*KEY, "value")


@query(
    "streamed_first_seen",
    f"WITH {RAW2} SELECT DISTINCT {_ID} FROM typed_v2 WHERE valid",
)
def streamed_first_seen(spark, d):
    """Deduplication in the state store of a stream over the typed rows."""
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("typed", "seen", "checkpoint"))
    typed = V.valid_rows(V.typed(raw(spark, d), RAW_URL)).select(*KEY, "value")
    typed.repartition(4).write.parquet(folder)
    rows = spark.readStream.schema(typed.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    stream = (
        streaming.first_seen(rows).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    return spark.read.schema(typed.schema).parquet(out).select(*KEY)


@query("streamed_keep_first", f"WITH {RAW2} SELECT {_ID}, value FROM accepted_v2")
def streamed_keep_first(spark, d):
    """First occurrences from a state store that meets the rows of the source from the last to the first."""
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("typed", "firsts", "checkpoint"))
    rows = raw(spark, d)
    n = _file_count(rows, 4)
    typed = V.valid_rows(V.typed(rows, RAW_URL)).select(*KEY, "value", "s_order", "s_line", "s_part", "s_supp", F.col("s_date").cast("string"), "s_price")
    typed.repartitionByRange(n, F.desc("s_order")).write.parquet(folder)
    rows = spark.readStream.schema(typed.schema).option("maxFilesPerTrigger", -(-n // 2)).parquet(folder)
    firsts.improving_firsts(rows, SEQUENCE).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return V.keep_first(spark.read.schema(typed.schema).parquet(out), SEQUENCE).select(*KEY, "value")


def _mirrored(spark, d):
    warehouse = _ingested(spark, d, 1, 2)
    mirror = Mirror(spark, scratch_path(spark, "mirror"))
    mirror.load(warehouse.fact(), warehouse.manifests())
    return warehouse, mirror


@query(
    "mirror_coverage",
    f"""WITH {RAW1}, {RAW2}, fact AS (SELECT {_K}, value FROM accepted_v2 UNION ALL SELECT {_K}, value FROM accepted_v1 ANTI JOIN accepted_v2 USING ({_K}))
  SELECT dataset, indicator, geography, frequency, CAST(min(period) AS VARCHAR) AS first_period, CAST(max(period) AS VARCHAR) AS last_period,
    count(*) AS observations FROM fact GROUP BY 1, 2, 3, 4""",
)
def mirror_coverage(spark, d):
    return _mirrored(spark, d)[1].table("indicator_coverage")


@query(
    "mirror_streamed_batches",
    f"WITH {RAW2} SELECT {_ID}, value, dataset_version FROM accepted_v2",
)
def mirror_streamed_batches(spark, d):
    warehouse = _ingested(spark, d, 2)
    mirror = Mirror(spark, scratch_path(spark, "mirror"))
    gold = warehouse.manifests().first().gold_path
    streaming.mirror_stream(spark, gold, mirror, scratch_path(spark, "mirror-stream"), files_per_trigger=6)
    return mirror.fact().select(*KEY, "value", "dataset_version")
