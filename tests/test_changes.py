"""State kept from changes alone: coverage, the index of parts, first occurrences, marks of streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from statweave.operators import validate as V
from statweave.operators.coverage import changed_coverage, coverage_table
from statweave.plans.mirror import MIRROR_COLUMNS, Mirror
from statweave.plans.warehouse import Metadata, Warehouse
from statweave.schema import FACT_SCHEMA, KEY
from statweave.sources.commits import PartTable
from statweave.streaming import firsts
from statweave.streaming import ingest as streaming


def facts(spark, rows):
    """(geography, unit, year, month, value)"""
    made = [("d", "i", g, dt.date(y, m, 1), float(v), u, "monthly", "https://x.example/", "v1", "r") for g, u, y, m, v in rows]
    return spark.createDataFrame(made, FACT_SCHEMA)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def columns(df):
    return df.select("dataset", "indicator", "geography", "frequency", "first_period", "last_period", "observations")


@pytest.mark.parametrize("seed", range(3))
def test_changed_coverage_equals_a_recount(spark, seed):
    rng = random.Random(seed)
    every = [(g, "u", y, m, 1) for g in "abcdef" for y in (2000, 2001) for m in range(1, 13)]
    before = rng.sample(every, 60)
    gone = rng.sample(before, 20) + [r for r in before if r[0] == "f"]  # one series goes entirely
    gone = list(dict.fromkeys(gone))
    came = [r for r in every if r not in before and r[0] != "e"][:15]
    after = facts(spark, [r for r in before if r not in gone] + came)
    got = changed_coverage(columns(coverage_table(facts(spark, before))), facts(spark, came), facts(spark, gone), after)
    same(columns(got), columns(coverage_table(after)))


def test_coverage_of_the_mirror_follows_every_commit(spark, tmp_path, monkeypatch):
    mirror = Mirror(spark, str(tmp_path / "mirror"), buckets=4)
    check = lambda: same(columns(mirror.table("indicator_coverage")), columns(coverage_table(mirror.fact())))
    first = [(g, "u", y, m, 1) for g in "abcd" for y in (2000, 2001, 2002) for m in (1, 6)]
    mirror.upsert_facts(facts(spark, first).select(*MIRROR_COLUMNS))
    check()
    opened = []
    read = PartTable.read
    monkeypatch.setattr(PartTable, "read", lambda self, parts, wanted=None: opened.append(wanted) or read(self, parts, wanted))
    mirror.upsert_facts(facts(spark, [("a", "u", 2001, 6, 5), ("a", "u", 2001, 7, 1), ("new", "w", 2001, 1, 1)]).select(*MIRROR_COLUMNS))
    assert opened and all(w is not None and {p.split("/")[0] for p in w} == {"2001"} for w in opened)  # no scan of all facts
    monkeypatch.undo()
    check()
    assert mirror.fact().filter("value = 5").count() == 1
    # The last period of a, all of b, and a key that is not there; another unit of c counts in the same row.
    mirror.upsert_facts(facts(spark, [("c", "other", 2003, 1, 1)]).select(*MIRROR_COLUMNS))
    check()
    gone = [("a", "u", 2002, 6, 0), ("c", "other", 2003, 1, 0), ("z", "u", 2000, 1, 0)] + [r for r in first if r[0] == "b"]
    mirror.remove_facts(facts(spark, gone).select(*KEY))
    check()
    assert {r.geography for r in mirror.table("indicator_coverage").collect()} == {"a", "c", "d", "new"}


def _warehouse(spark, tmp_path, meta, write_csv):
    warehouse = Warehouse(spark, str(tmp_path / "data"))
    for k, place in enumerate(["Pakistan", "Punjab", "Sindh", "Balochistan"]):
        rows = [(f"{y}-0{m}-01", str(y + m)) for y in (2019, 2020, 2021) for m in (1, 2)] + [("2020-01-01", "late"), ("bad", "1")]
        warehouse.ingest_csv(write_csv(tmp_path / f"{k}.csv", rows, geography=place), {**meta, "dataset_version": f"v{k}"})
    return warehouse


def test_a_series_opens_only_its_parts(spark, tmp_path, meta, write_csv):
    warehouse = _warehouse(spark, tmp_path, meta, write_csv)
    rows = warehouse.series("cpi", "Punjab", start="2020")
    same(rows, warehouse.fact("2020").filter("indicator = 'cpi' and geography = 'Punjab'"))
    assert rows.count() == 4
    assert len(rows.inputFiles()) == 2 < len(warehouse.fact("2020").inputFiles())
    assert len(warehouse.series("cpi", "Punjab").inputFiles()) == 3
    assert warehouse.series("cpi", "Nowhere").count() == 0


def test_a_known_source_is_found_without_reading_all_manifests(spark, tmp_path, meta, write_csv, monkeypatch):
    warehouse = _warehouse(spark, tmp_path, meta, write_csv)
    monkeypatch.setattr(Warehouse, "manifests", lambda self: pytest.fail("all manifests were read"))
    rows = [(f"{y}-0{m}-01", str(y + m)) for y in (2019, 2020, 2021) for m in (1, 2)] + [("2020-01-01", "late"), ("bad", "1")]
    again = warehouse.ingest_csv(write_csv(tmp_path / "again.csv", rows, geography="Sindh"), {**meta, "dataset_version": "v2"})
    assert again["idempotent"] and again["dataset_version"] == "v2" and again["rejected_rows"] == 2
    assert warehouse.already_ingested("unknown", Metadata(**meta)) is None


def test_a_source_is_parsed_once(spark, tmp_path, meta, write_csv, monkeypatch):
    calls = []
    typed = V.typed
    monkeypatch.setattr(V, "typed", lambda *a: calls.append(1) or typed(*a))
    monkeypatch.setattr(V, "rejected_rows", lambda *a: pytest.fail("rejected rows were parsed again"))
    warehouse = Warehouse(spark, str(tmp_path / "data"))
    report = warehouse.ingest_csv(write_csv(tmp_path / "a.csv", [("2020-01-01", "1"), ("bad", " x "), ("2020-01-01", "2")]), meta)
    assert len(calls) == 1 and (report["rejected_rows"], report["duplicates"], report["missing_values"]) == (1, 1, 0)
    kept = warehouse.rejected(report["ingestion_id"]).first()
    assert kept.value == " x " and sorted(kept.reasons) == ["bad_period", "bad_value"]


def test_observed_counters_equal_the_aggregation(spark, sf):
    from workload.observations import RAW_URL, SEQUENCE, raw

    staged = V.staged(V.typed(raw(spark, sf), RAW_URL), SEQUENCE)
    whole = V.ingestion_counts(staged).first().asDict()
    assert V.with_percentages({k: v for k, v in whole.items() if k not in ("quality_score", "missing_data_percentage")}) == whole
    assert V.with_percentages(V.ingestion_counts(staged.limit(0)).first().asDict())["quality_score"] == 0.0


def _folder(spark, path, rows, per_file):
    """Rows of (geography, at, place, value) in files, a batch each, in the order given."""
    for k in range(0, len(rows), per_file):
        part = spark.createDataFrame(rows[k : k + per_file], "geography string, at timestamp, place long, value double")
        part.coalesce(1).write.mode("append").parquet(path)


def _firsts(spark, tmp_path, rows, name, per_file=8, delay=None):
    """What the stream passes on, and the number of keys in its state at the end."""
    path, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    _folder(spark, path, rows, per_file)
    stream = spark.readStream.schema("geography string, at timestamp, place long, value double").option("maxFilesPerTrigger", 1).parquet(path)
    time = "at" if delay is not None else None
    found = firsts.improving_firsts(stream, ["place"], ["geography"], time, delay)
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
    query = query.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_firsts_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(7)
    start = dt.datetime(2020, 1, 1)
    rows = [(f"g{rng.randrange(6)}", start + dt.timedelta(days=i), i, float(i)) for i in range(24)]
    wanted = {}
    for g, _, place, value in rows:
        wanted.setdefault(g, (place, value))
    for name, order in (("forward", rows), ("mixed", rng.sample(rows, 24))):
        found, _ = _firsts(spark, tmp_path, order, name)
        settled = V.keep_first(found, ["place"], ["geography"])
        assert {r.geography: r.value for r in settled.collect()} == {g: v for g, (_, v) in wanted.items()}
        if name == "forward":
            assert found.count() == len(wanted)  # later rows of a known key are not passed on


def test_timers_bound_the_state(spark, tmp_path):
    start = dt.datetime(2020, 1, 1)
    rows = [(f"g{i}", start + dt.timedelta(days=i), i, float(i)) for i in range(24)]
    day = 24 * 3600 * 1000
    found, kept = _firsts(spark, tmp_path, rows, "timed", per_file=6, delay=2 * day)
    assert found.count() == 24 and kept < 24


def test_a_mirror_stream_goes_on_where_it_stopped(spark, tmp_path, meta, write_csv, monkeypatch):
    gold = str(tmp_path / "gold")
    mirror, place = Mirror(spark, str(tmp_path / "mirror")), str(tmp_path / "stream")
    write = lambda rows: facts(spark, rows).withColumn("partition_year", F.year("period")).write.mode("append").partitionBy("partition_year").parquet(gold)
    write([("a", "u", 2020, 1, 1), ("a", "u", 2020, 2, 1)])
    streaming.mirror_stream(spark, gold, mirror, place, 1)
    version, mark = mirror.commits.latest()["version"], mirror.stream_state(place)
    streaming.mirror_stream(spark, gold, mirror, place, 1)  # nothing new: no commit
    assert (mirror.commits.latest()["version"], mirror.stream_state(place)) == (version, mark)
    write([("b", "u", 2021, 1, 7)])
    merged = []
    upsert = Mirror.upsert_facts
    monkeypatch.setattr(Mirror, "upsert_facts", lambda self, batch, streams=None: merged.append(batch.count()) or upsert(self, batch, streams))
    streaming.mirror_stream(spark, gold, mirror, place, 1)
    assert merged == [1] and mirror.fact().count() == 3 and mirror.stream_state(place) > mark
