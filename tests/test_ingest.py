import json

import pytest
from pyspark.sql import functions as F

from statweave.operators.validate import ContractError, keep_first
from statweave.plans.mirror import Mirror
from statweave.plans.warehouse import Metadata, Warehouse
from statweave.schema import KEY
from statweave.sources import files
from statweave.sources.commits import Commits
from statweave.streaming import ingest as streaming

ROWS = [("2020-01-01", "100"), ("2020-01-01", "100"), ("2020-02-01", "bad"), ("2020-03-01", "103")]


def test_counts_idempotence_and_revisions(spark, tmp_path, meta, write_csv):
    source = write_csv(tmp_path / "source.csv", ROWS)
    warehouse = Warehouse(spark, str(tmp_path / "data"))
    result = warehouse.ingest_csv(source, meta)
    assert (result["raw_rows"], result["processed_rows"], result["duplicates"], result["rejected_rows"]) == (4, 2, 1, 1)
    assert result["raw_rows"] == result["processed_rows"] + result["duplicates"] + result["rejected_rows"]
    assert result["quality"] == {"min_value": 100.0, "max_value": 103.0, "extreme_values": 0}
    assert result["quality_score"] == 50.0 and result["missing_data_percentage"] == 0.0
    assert warehouse.ingest_csv(source, meta)["idempotent"]
    write_csv(tmp_path / "source.csv", [("2020-01-01", "101")])
    result = warehouse.ingest_csv(source, {**meta, "dataset_version": "fixture-v2"})
    assert (result["revisions"], result["inserted_rows"]) == (1, 0)
    assert warehouse.fact().count() == 2
    assert [(r.old_value, r.new_value) for r in warehouse.revisions().collect()] == [(100.0, 101.0)]
    assert warehouse.ingestion_log().count() == 2


def test_refreshed_value_takes_the_new_version(spark, tmp_path, meta, write_csv):
    warehouse = Warehouse(spark, str(tmp_path / "data"))
    warehouse.ingest_csv(write_csv(tmp_path / "a.csv", ROWS), meta)
    result = warehouse.ingest_csv(write_csv(tmp_path / "b.csv", [("2020-01-01", "100"), ("2021-01-01", "7")]), {**meta, "dataset_version": "v2"})
    assert (result["revisions"], result["inserted_rows"]) == (0, 1)
    versions = {str(r.period): r.dataset_version for r in warehouse.fact().collect()}
    assert versions == {"2020-01-01": "v2", "2020-03-01": "fixture-v1", "2021-01-01": "v2"}


def test_missing_columns_leave_the_fact_alone(spark, tmp_path, meta, write_csv):
    warehouse = Warehouse(spark, str(tmp_path / "data"))
    (tmp_path / "bad.csv").write_text("value\n1\n")
    with pytest.raises(ContractError, match="Missing canonical"):
        warehouse.ingest_csv(str(tmp_path / "bad.csv"), meta)
    assert warehouse.fact().count() == 0 and warehouse.manifests().count() == 0


def test_failure_before_the_commit_leaves_the_fact_alone(spark, tmp_path, meta, write_csv, monkeypatch):
    warehouse = Warehouse(spark, str(tmp_path / "data"))
    warehouse.ingest_csv(write_csv(tmp_path / "a.csv", ROWS), meta)
    before = sorted(map(str, warehouse.fact().collect()))
    monkeypatch.setattr(Commits, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        warehouse.ingest_csv(write_csv(tmp_path / "b.csv", [("2020-01-01", "9")]), {**meta, "dataset_version": "v2"})
    assert sorted(map(str, warehouse.fact().collect())) == before
    assert warehouse.manifests().count() == 1 and warehouse.revisions().count() == 0
    (record,) = (tmp_path / "data" / "commits" / "failed").glob("*.json")
    assert json.loads(record.read_text())["reason"] == "lost"


def test_concurrent_commit_is_refused(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "commits"))
    commits.publish(1, {"a": 1})
    with pytest.raises(RuntimeError):
        commits.publish(1, {"a": 2})
    assert commits.latest() == {"a": 1, "version": 1}


def test_invalid_dates_and_values_are_rejected(spark, tmp_path, meta, write_csv):
    source = write_csv(tmp_path / "i.csv", [("not-a-date", "1"), ("2020-01-01", "inf"), ("2020-02-01", "4")])
    result = Warehouse(spark, str(tmp_path / "data")).ingest_csv(source, meta)
    assert (result["rejected_rows"], result["processed_rows"]) == (2, 1)


def test_other_source_and_unknown_frequency_are_rejected(spark, tmp_path, meta, write_csv):
    warehouse = Warehouse(spark, str(tmp_path / "data"))
    source = write_csv(tmp_path / "o.csv", [("2020-01-01", "1")], source_url="https://elsewhere.example/")
    assert warehouse.ingest_csv(source, meta)["rejected_rows"] == 1
    source = write_csv(tmp_path / "f.csv", [("2020-01-01", "1")], frequency="hourly")
    result = warehouse.ingest_csv(source, meta)
    assert (result["rejected_rows"], result["quality_score"]) == (1, 0.0)
    assert warehouse.fact().count() == 0


def test_metadata_contract(meta):
    with pytest.raises(ValueError, match="source says nothing"):
        Metadata(**{**meta, "source": " "})
    with pytest.raises(ValueError, match="https address"):
        Metadata(**{**meta, "source_url": "http://x"})
    with pytest.raises(ValueError):
        Metadata(**{**meta, "retrieval_date": "yesterday"})


def test_quoted_line_breaks_and_literal_na(spark, tmp_path, meta):
    path = tmp_path / "q.csv"
    head = "extra,dataset,indicator,geography,period,value,unit,frequency,source_url\n"
    url = meta["source_url"]
    path.write_text(
        head
        + f'1,test,cpi,"Two\nlines ""x""",2020-01-01,1,NA,monthly,{url}\n'
        + f"2,test,cpi,NA,2020-02-01,2,NA,monthly,{url}\n"
        + f"3,test,cpi,,2020-03-01,3,NA,monthly,{url}\n"
    )
    assert [(breaks, len(own)) for _, breaks, own in files.csv_layouts(spark, str(path))] == [(True, 1)]
    warehouse = Warehouse(spark, str(tmp_path / "data"))
    result = warehouse.ingest_csv(str(path), meta)
    assert (result["raw_rows"], result["processed_rows"], result["missing_values"]) == (3, 2, 1)
    assert {(r.geography, r.unit) for r in warehouse.fact().collect()} == {('Two\nlines "x"', "NA"), ("NA", "NA")}


def test_first_occurrence_wins_in_file_order(spark, tmp_path, meta, write_csv):
    source = write_csv(tmp_path / "s.csv", [("2020-01-01", str(i)) for i in range(500, 0, -1)])
    warehouse = Warehouse(spark, str(tmp_path / "data"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert warehouse.ingest_csv(source, meta)["duplicates"] == 499
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert warehouse.fact().first().value == 500.0


def test_keep_first_of_a_hot_key(spark):
    rows = spark.range(3000).select(
        *[F.lit("k").alias(k) if k != "period" else F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias(k) for k in KEY],
        F.col("id").alias("value"), (-F.col("id")).alias("s"),
    )
    out = keep_first(rows, ["s"])
    assert out.count() == 2001
    hot = out.filter("period = 'hot'").first()
    assert (hot.value, hot.copies) == (2997, 1000)


def test_identity_follows_content_and_order_not_splits(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"".join(b"line %d\r\n" % i for i in range(3000)) + b"\xff\n")
    (tmp_path / "y.csv").write_bytes((tmp_path / "x.csv").read_bytes().replace(b"line 1\r\nline 2\r\n", b"line 2\r\nline 1\r\n"))
    x, size = files.source_identity(spark, str(tmp_path / "x.csv"))
    assert size == (tmp_path / "x.csv").stat().st_size
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert files.source_identity(spark, str(tmp_path / "x.csv"))[0] == x
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.source_identity(spark, str(tmp_path / "y.csv"))[0] != x


def test_swapped_files_are_another_source(spark, tmp_path, meta, write_csv):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    values = []
    for name, first, second in (("a", "1", "2"), ("b", "2", "1")):
        folder = tmp_path / name
        folder.mkdir()
        write_csv(folder / "p0.csv", [("2020-01-01", first)])
        write_csv(folder / "p1.csv", [("2020-01-01", second)])
        result = warehouse.ingest_csv(str(folder), meta)
        assert not result["idempotent"]
        values.append(warehouse.fact().first().value)
    assert values == [1.0, 2.0]


def test_a_trailing_line_break_makes_no_second_series(spark, tmp_path, meta, write_csv):
    path = write_csv(tmp_path / "n.csv", [("2020-01-01", "1")])
    with open(path, "a") as f:
        f.write(open(path).read().splitlines()[1].replace("test,", '"test\n",', 1) + "\n")
    result = Warehouse(spark, str(tmp_path / "w")).ingest_csv(path, meta)
    assert (result["processed_rows"], result["duplicates"]) == (1, 1)


def test_an_open_quote_is_an_error(spark, tmp_path, meta, write_csv):
    path = write_csv(tmp_path / "n.csv", [("2020-01-01", "1")])
    with open(path, "a") as f:
        f.write('"test,cpi\n')
    with pytest.raises(ContractError, match="never closed"):
        Warehouse(spark, str(tmp_path / "w")).ingest_csv(path, meta)


def test_rejects_bronze_and_provenance_are_kept(spark, tmp_path, meta, write_csv):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    path = write_csv(tmp_path / "r.csv", [("x", " 1"), ("2020-01-01", "bad"), ("2020-02-01", "2")])
    result = warehouse.ingest_csv(path, meta)
    rows = {(r.period, r.value): r.reasons for r in warehouse.rejected(result["ingestion_id"]).collect()}
    assert rows == {("x", " 1"): ["bad_period"], ("2020-01-01", "bad"): ["bad_value"]}
    (bronze,) = (tmp_path / "w" / "bronze").iterdir()
    (part,) = (bronze / "lines" / "file=r.csv" / "block=0").glob("part-*")
    assert part.read_bytes() == (tmp_path / "r.csv").read_bytes()
    assert spark.read.json(str(bronze / "provenance")).first().source_url == meta["source_url"]


def test_revisions_before_any(spark, tmp_path, meta, write_csv):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    warehouse.ingest_csv(write_csv(tmp_path / "a.csv", ROWS), meta)
    assert warehouse.revisions().count() == 0


def test_stream_reads_files_like_a_batch(spark, tmp_path, meta, write_csv):
    folder = tmp_path / "in"
    folder.mkdir()
    write_csv(folder / "a.csv", [("2020-01-01", "1")])
    lines = open(folder / "a.csv").read().splitlines()
    (folder / "b.csv").write_text("note," + lines[0] + "\n" + 'x,"te\nst",' + lines[1].split(",", 1)[1].replace("2020-01", "2020-02") + "\n")
    batch = Warehouse(spark, str(tmp_path / "batch"))
    one = batch.ingest_csv(str(folder), meta)
    stream = Warehouse(spark, str(tmp_path / "stream"))
    two = streaming.ingest_stream(stream, str(folder), Metadata(**meta), "h1")
    for k in ("raw_rows", "processed_rows", "rejected_rows", "duplicates"):
        assert one[k] == two[k]
    assert sorted(map(str, batch.fact().select(*KEY, "value").collect())) == sorted(map(str, stream.fact().select(*KEY, "value").collect()))
    write_csv(folder / "c.csv", [("2021-01-01", "3")])  # a later call reads only what is new
    assert streaming.ingest_stream(stream, str(folder), Metadata(**meta), "h2")["raw_rows"] == 1
    assert stream.fact().count() == 3


def _stream(spark, tmp_path, meta, write_csv, name, per_trigger):
    folder = tmp_path / "in"
    if not folder.exists():
        folder.mkdir()
        for i in range(6):
            write_csv(folder / f"part-{i}.csv", [("2020-01-01", str(100 + i)), (f"2020-{i + 1:02d}-01", str(i)), ("x", "1")])
    warehouse = Warehouse(spark, str(tmp_path / name))
    result = streaming.ingest_stream(warehouse, str(folder), Metadata(**meta), "h", per_trigger)
    return warehouse, result


def test_stream_result_does_not_depend_on_chunks(spark, tmp_path, meta, write_csv):
    one, r1 = _stream(spark, tmp_path, meta, write_csv, "one", 1)
    all_, r2 = _stream(spark, tmp_path, meta, write_csv, "all", 100)
    key = lambda w: sorted((str(r.period), r.value) for r in w.fact().collect())
    assert key(one) == key(all_)
    assert key(one)[0] == ("2020-01-01", 100.0)
    for r in (r1, r2):
        assert (r["raw_rows"], r["processed_rows"], r["rejected_rows"], r["duplicates"]) == (18, 6, 6, 6)
    assert streaming.ingest_stream(one, str(tmp_path / "in"), Metadata(**meta), "h")["idempotent"]


def test_mirror_is_idempotent_and_needs_manifests(spark, tmp_path, meta, write_csv):
    warehouse = Warehouse(spark, str(tmp_path / "data"))
    warehouse.ingest_csv(write_csv(tmp_path / "a.csv", ROWS), meta)
    mirror = Mirror(spark, str(tmp_path / "mirror"))
    for _ in range(2):
        mirror.load(warehouse.fact(), warehouse.manifests())
    assert mirror.fact().count() == 2 and mirror.commits.latest()["version"] == 2
    assert mirror.table("indicator_coverage").first().observations == 2
    assert [r.geographic_level for r in mirror.table("dim_geography").collect()] == ["national"]
    assert mirror.table("dim_dataset").count() == 1
    with pytest.raises(ContractError, match="provenance"):
        mirror.load(warehouse.fact().withColumn("source_url", F.lit("https://unknown.example/")), warehouse.manifests())


def test_payload_contract(spark):
    record = lambda code, date, value, country="PAK": {"indicator": {"id": code}, "countryiso3code": country, "date": date, "value": value}
    words = spark.createDataFrame([("A.1", "gdp", "usd", "economy")], "code string, indicator string, unit string, domain string")
    good = json.dumps([{"pages": 1}, [record("A.1", "2020", 1.5), record("A.1", "2021", None), record("Z.9", "2021", None)]])
    records = files.payload_records(spark.createDataFrame([(good,)], "payload string"))
    assert files.payload_violations(records, words, "PAK").count() == 0
    row = files.payload_observations(records, words, "Pakistan", "https://api.example/").first()
    assert (row.dataset, row.indicator, str(row.period), row.value) == ("worldbank_economy", "gdp", "2020-01-01", 1.5)
    bad = json.dumps([{}, [record("B", "2020", 1), record("A.1", "20", 1), record("A.1", "2022", 1, "IND"),
                           record("A.1", "2023", 1), record("A.1", "2023", 2), record("A.1", "2024", "NaN")]])
    found = files.payload_violations(files.payload_records(spark.createDataFrame([(bad,)], "payload string")), words, "PAK")
    assert sorted(r.reason for r in found.collect()) == ["duplicate", "invalid_value", "invalid_year", "unrequested", "unrequested"]


def test_report_parser(spark):
    lines = "title\n 2020 1 100.1 99 98.5 97 x\n 2020   2  101 99 98 97\nHistorical Inflation Rate\n2020 3 1 1 1 1\n"
    report = lambda text: files.report_observations(
        spark.createDataFrame([(text,)], "text string"), "prices", "Pakistan", "index", "https://x/")
    out = report(lines)
    assert out.count() == 8 and {r.indicator for r in out.collect()} == set(files.REPORT_MEASURES)
    with pytest.raises(ContractError, match="no valid month"):
        report(" 2020 13 1 1 1 1\n")
    with pytest.raises(ContractError, match="skips a month"):
        report(" 2020 1 1 1 1 1\n 2020 3 1 1 1 1\n")
    with pytest.raises(ContractError, match="names a month twice"):
        report(" 2020 1 1 1 1 1\n 2020 1 2 1 1 1\n")
    with pytest.raises(ContractError, match="has no lines"):
        report("nothing")


def test_json_conversion(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"Region": "A", "V": 1}, {"Region": "B", "V": 2.5}]))
    out = files.json_records(spark, str(tmp_path / "r.json"), {"Region": "geography", "V": "value"})
    assert sorted((r.geography, r.value) for r in out.collect()) == [("A", "1"), ("B", "2.5")]
    with pytest.raises(ContractError, match="does not have"):
        files.json_records(spark, str(tmp_path / "r.json"), {"Nope": "x"})


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"economy": [["A", "gdp", "GDP", "usd"]], "trade": [["B", "exp", "Exports", "usd"]]}, indent=1))
    assert sorted(tuple(r) for r in files.read_dictionary(spark, str(tmp_path / "d.json")).collect()) == [
        ("economy", "A", "gdp", "GDP", "usd"), ("trade", "B", "exp", "Exports", "usd")]


def test_census_workbook(spark):
    from statweave.schema import COLUMNS
    from statweave.sources import census

    names = ", ".join(f"c{i} string" for i in range(12))
    row = lambda label: [label, None, "10", "4", "5", "1", None, "2.5", "40", "6", "9", "1.1"]
    head = [["CENSUS-2023 table", *[None] * 11], [None, None, "POPULATION", *[None] * 9]]
    cells = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"r int, {names}")
    out = census.census_observations(cells([*head, row("Upper-Dir  District"), row("TOTAL")]), "raw/table_1_kp_districts.xlsx", "https://x/")
    assert out.columns == COLUMNS and out.count() == 9
    assert {(r.dataset, r.geography, r.frequency) for r in out.collect()} == {("pbs_census_2023_kp", "Upper-Dir", "annual")}
    with pytest.raises(ContractError, match="header"):
        census.census_observations(cells([row("x"), row("y")]), "table_1_kp_districts.xlsx", "https://x/")
    with pytest.raises(ContractError, match="no known geography"):
        census.census_observations(cells([*head, row("TOTAL")]), "table_1_kp_districts.xlsx", "https://x/")


def test_source_files_grow_in_number(spark, sf, tmp_path, monkeypatch):
    from workload import files as queries
    from workload.observations import SEQUENCE, raw

    monkeypatch.setattr(queries, "FILE_ROWS", 500)
    rows = raw(spark, sf)
    path = queries._as_csv(rows, str(tmp_path / "csv"))
    read = files.read_csv(spark, path)
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) == -(-rows.count() // 500) > 8
    given = [r[0] for r in rows.orderBy(*SEQUENCE).select("value").collect()]
    assert [r.value for r in read.orderBy("seq").select("value").collect()] == [v or None for v in given]


def test_stream_rows_are_reduced_per_task(monkeypatch):
    import pyarrow as pa

    from statweave.streaming import firsts

    n = 30_000
    rows = pa.table({"k": [None if i % 7 == 0 else f"k{i % 7}" for i in range(n)], "place": [None if i == 15 else (n - i) for i in range(n)], "text": ["x"] * n})
    out = list(firsts._earliest(["k"], ["place", "text"])(iter(rows.to_batches(max_chunksize=1_000))))
    got = {r["k"]: r["place"] for b in out for r in b.to_pylist()}
    assert sum(map(len, out)) == 7 and got["k1"] is None and got[None] == min(n - i for i in range(0, n, 7))
    monkeypatch.setattr(firsts, "HELD_ROWS", 2_000)
    alone = list(firsts._earliest(["place"], ["place"])(iter(rows.to_batches(max_chunksize=1_000))))
    assert sum(map(len, alone)) == n and max(map(len, alone)) <= 10_000  # keys of their own are passed on


def test_staging_compares_hashes_not_texts(spark, meta):
    """Sorted by the key's hash first, and no reason is collected by a function that Spark cannot compile."""
    from statweave.operators import validate as V
    from statweave.schema import COLUMNS

    good = ("d", "i", "g", "2020-01-01", "2", "u", "monthly", meta["source_url"])
    rows = [(*good, 1), (*good[:4], "3", *good[5:], 0), (*good[:3], "never", "bad", *good[5:], 2)]
    typed = V.typed(spark.createDataFrame(rows, [*COLUMNS, "n"]), meta["source_url"])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    staged = V.staged(typed, ["n"])
    assert "Sort [_hash" in plan(staged)
    assert "lambda" not in plan(typed) and plan(typed).count("RLIKE") < plan(typed).count("ascii(")
    assert sorted((r.outcome, r.value, r.copies, r.blanks) for r in staged.collect()) == [("accepted", 3.0, 2, 0), ("rejected", None, 1, 0)]
    assert sorted(r.reasons for r in typed.collect()) == [[], [], ["bad_period", "bad_value"]]
