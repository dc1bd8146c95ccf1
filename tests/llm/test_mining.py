"""Collocations, resampling and SimHash against plain versions and SQL."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from statweave.llm import collocations, resampling, simhash  # noqa: E402
from statweave.llm.frames import read_table  # noqa: E402
from statweave.llm.queries import ORACLES, QUERIES  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, f int, n int, score int, rank string, print int, words string, weight int"


@pytest.fixture(scope="module")
def table(spark):
    def build(rows):
        """(doc_id, text, lang) with further columns whose names the operators use themselves."""
        return spark.createDataFrame([(i, t, la, "s", 1, 2, 3, "r", 4, "w", 5) for i, t, la in rows], SCHEMA)

    return build


@pytest.fixture()
def many_ranges(spark):
    """Small ranges, so that phrases and their extensions lie in different tasks."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = sorted(d[0] for d in found.description)
    order = [[d[0] for d in found.description].index(c) for c in names]
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in QUERIES[name](spark, sf).select(*names).collect()), key=repr) == want


# ------------------------------------------------------------------ collocations


def plain_collocations(rows, longest, least):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                count[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, f in count.items():
        frequent = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        for p, a in frequent.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            if any(inside(q) and 100 * n >= 50 * a for q, n in frequent.items()):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out[lang, " ".join(p)] = (a, left, right, total[lang], score)
    return out


def collocation_rows(seed, docs=60):
    rng = random.Random(seed)
    words = ["the", "the", "the", "of", "cat", "sat", "Mat", "é", "été", "x\x01", "x", "#1", "über", "Ä"]
    sep = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " ; ", "!"]
    text = lambda: "".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.randrange(40)))
    rows = [(i, text(), rng.choice(["en", "de", None, "und"])) for i in range(docs)]
    return rows + [(None, "the cat sat", "en"), (7, None, "en"), (8, "", "de"), (9, "...", "xx"), (10, "solo", None)] + [(11, "the cat sat on it", "en")] * 12


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_a_plain_count(table, many_ranges, monkeypatch, longest):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 500)
    monkeypatch.setattr(collocations, "CELL_BYTES", 100)
    monkeypatch.setattr(collocations, "FOLD_ROWS", 40)
    rows = collocation_rows(longest)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(table(rows), longest, 5).collect()}
    assert got == plain_collocations(rows, longest, 5) and len(got) > 10


def test_collocations_of_nothing(table):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, "a b c", "en")]):
        assert collocations.collocations(table(rows)).count() == 0


def test_collocation_counts_beyond_64_bits(spark):
    stream = spark.createDataFrame([("en", ["a"], 4 * 10**9), ("en", ["b"], 4 * 10**9), ("en", ["a", "b"], 3 * 10**9)], "lang string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 10**10)], "lang string, n long")
    module = pytest.MonkeyPatch()
    module.setattr(collocations, "phrase_counts", lambda *a: (stream, totals))
    row = collocations.collocations(spark.createDataFrame([], "text string, lang string")).first()
    module.undo()
    assert row.score == 10**6 * (3 * 10**9) ** 2 // (4 * 10**9) ** 2


def test_one_word_begins_most_phrases(table, many_ranges):
    """Its phrases lie in many ranges; those behind the first take its count from the summaries."""
    rows = [(i, f"hub spoke{i % 90} end{i % 90}", "en") for i in range(1800)]
    found = {r.phrase: r for r in collocations.collocations(table(rows), 3, 10).collect()}
    assert len(found) == 90 and all(r.l in (1800, 20) and r.a == 20 for r in found.values())
    assert found["hub spoke7 end7"].score == 10**6 * 400 // (1800 * 20)


def test_best_of_a_language(table, spark):
    rows = [("en", f"p{i:03d} q", i % 7, 10 + i % 3) for i in range(300)] + [("de", "a b", 1, 1)]
    found = spark.createDataFrame(rows, "lang string, phrase string, score long, a long")
    got = [(r.lang, r["rank"], r.phrase) for r in collocations.best_of_language(found, 25).collect()]
    order = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[2], -r[3], r[1].encode()))[:25]
    assert sorted(got) == sorted([("de", 1, "a b")] + [("en", k + 1, r[1]) for k, r in enumerate(order)])


def test_collocation_query(spark, sf):
    against_sql(spark, sf, "op11_phrase_collocations")


# ------------------------------------------------------------------ resampling


def test_checksums_of_ranges():
    words = [b"", b"a", b"the", "é".encode(), b"x" * 1000, b"123456789"]
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    got = resampling.crc32_of_ranges(buf, end - [len(w) for w in words], end)
    assert got.tolist() == [zlib.crc32(w) for w in words]


def plain_resample(rows, target, longest, buckets, percent, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.ASCII_LOWER))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    source, wanted = collections.Counter(), collections.Counter()
    for _, t, _ in rows:
        source.update(features(t))
    for t in target:
        wanted.update(features(t))
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text, _ in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = features(text)
        weight = sum(gain[b] for b in f)
        out.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((*r, drawn.get(id(r))) for r in out if r[0] is not None), len(drawn)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_equals_a_plain_version(spark, table, longest):
    rng = random.Random(longest)
    words = ["Alpha", "beta", "γάμμα", "delta1", "z", "über"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))), "en") for i in range(200)]
    rows += [(500, None, None), (501, "", "en"), (502, "-- !!", "en"), (None, "alpha beta", "en")]
    target = ["alpha alpha delta1", None, "", "z-z z"]
    bench = spark.createDataFrame([(k, t, 9) for k, t in enumerate(target)], "item_id long, text string, weight int")
    got = resampling.resample(table(rows), bench, longest, 97, 30, 5).collect()
    want, drawn = plain_resample(rows, target, longest, 97, 30, 5)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want and len(got) == len(rows)
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, drawn + 1))
    assert resampling.resample(table([]), bench).count() == 0
    assert resampling.resample(table(rows), bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("count", [0, 1, 40, 700])
def test_ranks_of_sampled_sorting(spark, monkeypatch, count):
    monkeypatch.setattr(resampling, "RUN_ROWS", 64)
    monkeypatch.setattr(resampling, "RUN_SAMPLES", 8)
    rng = random.Random(count)
    # A third of all rows ties in score and id, another third has no id.
    rows = [(rng.choice([None, 5, k]), rng.choice([3, 3, k % 11]), k) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, score long, row long").repartition(7)
    got = resampling.highest(df, count, segment_rows=30).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    want = {r[2]: k + 1 if k < count else None for k, r in enumerate(order)}
    assert {r.row: r["rank"] for r in got} == want and len(got) == 600


def test_resampling_query(spark, sf):
    against_sql(spark, sf, "op12_importance_resampling")


# ------------------------------------------------------------------ simhash


def plain_print(text):
    words = brute.WORD.findall((text or "").translate(brute.ASCII_LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain_simhash(rows):
    prints = {(i, t): plain_print(t) for i, t in rows}
    own = [(i, prints[i, t]) for i, t in rows if i is not None]
    nodes = {p for _, p in own}
    least = {p: min(i for i, q in own if q == p) for p in nodes}
    root = plain_components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    component = collections.defaultdict(lambda: math.inf)
    for p in nodes:
        component[root[p]] = min(component[root[p]], least[p])
    return sorted((i is None, i or 0, f"{prints[i, t]:016x}", component[root[prints[i, t]]] if i is not None else None) for i, t in rows)


def test_simhash_cases(spark, table):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "one two"), (6, "é ü ß"), (None, "one"), (None, None), (3, "two"), (3, "one")]
    for k in range(60):  # near copies
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(300)] = f"v{rng.randrange(50)}"
        rows.append((100 + k, rng.choice([" ", "  ", "\n"]).join(words)))
    rows += [(200, " ".join(base * 40)), (201, " ".join(f"u{k % 977}" for k in range(200_000)))]  # very long
    got = simhash.near_duplicates(table([(i, t, "en") for i, t in rows])).collect()
    digest = lambda r: (r.doc_id is None, r.doc_id or 0, f"{r.print & (2**64 - 1):016x}", r.component)
    assert sorted(map(digest, got)) == plain_simhash(rows)
    assert simhash.near_duplicates(table([])).count() == 0


@pytest.mark.parametrize(("distance", "limit"), [(2, 256), (2, 3), (3, 3), (1, 3), (0, 3)])
def test_crowded_variants_lose_no_link(spark, distance, limit):
    rng = np.random.default_rng(distance + limit)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)}
    for centre in rng.integers(0, 1 << 63, 2, dtype=np.uint64):
        for _ in range(250):
            x = int(centre)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            prints.add(x)
    half = int(rng.integers(0, 1 << 32)) << 32
    prints |= {half | int(x) for x in rng.integers(0, 1 << 32, 150)}  # one half that many have
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints}
    df = spark.createDataFrame([(x,) for x in signed.values()], "print long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.near_links(df, distance, limit).distinct().collect()]
    want = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance]
    assert plain_components(prints, links) == plain_components(prints, want)


def test_simhash_takes_three_bits_at_most(spark):
    with pytest.raises(ValueError, match="three"):
        simhash.near_links(spark.range(3).select(F.col("id").alias("print")), 4)


def test_simhash_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = QUERIES["op13_simhash_near_dedup"](spark, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == plain_simhash(rows)
