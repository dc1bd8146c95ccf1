"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import collections
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from statweave.llm import (  # noqa: E402
    frames,
    kernel,
    license_scan,
    metric_search,
    mixing,
    ngram_join,
    packing,
    phrase_dedup,
    pii,
    quality,
    suffix_dedup,
    toxicity,
)
from statweave.llm.queries import tokenizer_path  # noqa: E402

WORDS = [f"w{i:03d}" for i in range(400)]
BASE = " ".join(WORDS[:120])
NEAR = " ".join(WORDS[:60] + ["changed"] + WORDS[61:120])
SCHEMA = "doc_id long, text string, lang string, source string, node long, kept boolean, spans string, `row` int, size int, key int"


@pytest.fixture()
def table(spark):
    def build(texts, source="a"):
        rows = [(i, t, "en", source, 7, True, "x", 1, 2, 3) for i, t in texts]
        return spark.createDataFrame(rows, SCHEMA)

    return build


CASES = [
    (1, BASE), (2, NEAR), (3, BASE), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "ONE"), (9, "one two"),
    (10, "é " * 30), (11, " ".join(WORDS * 40)), (None, BASE), (12, "x" * 5000),
]


def named(cases):
    return [(d, t) for d, t in cases if d is not None]


def test_ngram_cases(table):
    got = ngram_join.gram_components(table(CASES)).select("doc_id", "n_grams", "component").collect()
    assert {tuple(r) for r in got if r.doc_id is not None} == brute.ngram_join(named(CASES))
    assert [(r.n_grams, r.component) for r in got if r.doc_id is None] == [(116, None)]
    assert ngram_join.gram_components(table([])).count() == 0
    twice = ngram_join.first_of_groups(table([(1, BASE), (1, BASE), (2, NEAR), (None, BASE)]))
    assert sorted((r.doc_id or 0, r.key) for r in twice.collect()) == [(0, 3), (1, 3)]


def test_ngram_large_family(table, monkeypatch):
    """A family of many blocks, long runs of one n-gram, and a chain that only links step by step."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 5)
    monkeypatch.setattr(ngram_join, "PAIR_RUN", 4)
    monkeypatch.setattr(ngram_join, "RUN_BLOCK", 6)
    texts = [(i, " ".join(WORDS[3 * i : 3 * i + 100])) for i in range(30)]
    texts += [(100 + i, " ".join(WORDS[:150][: 60 + i % 3] + [f"v{i}"] + WORDS[61:150])) for i in range(25)]
    got = ngram_join.gram_components(table(texts)).select("doc_id", "n_grams", "component").collect()
    assert {tuple(r) for r in got} == brute.ngram_join(texts)


def test_trie_links_random():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2000, 60).astype(np.uint64)) for _ in range(8)]
    sets = []
    for b in base:
        for _ in range(6):
            s = b.copy()
            s[rng.integers(0, len(s), rng.integers(0, 9))] = rng.integers(2000, 9000)
            sets.append(np.unique(s))
    forest = ngram_join.trie_links(sets, 80)
    plain = ngram_join.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                plain.join(i, j)
    assert [forest.find(i) for i in range(len(sets))] == [plain.find(i) for i in range(len(sets))]


def test_sketch_never_understates():
    rng = np.random.default_rng(3)
    for n in (5, 60, 64, 65, 300):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.union1d(a[: max(1, n * 9 // 10)], rng.integers(0, 1 << 60, n // 8).astype(np.uint64))
        assert ngram_join.sketch_distance(ngram_join.parity_sketch(a), ngram_join.parity_sketch(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 100)]
    got = dict(frames.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 100}
    assert frames.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_cases(table, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.quality_rules(table(CASES), labels).collect()
    want = brute.quality([(d if d is not None else -1, t) for d, t in CASES])
    assert {(r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert quality.quality_rules(table([]), labels).count() == 0
    assert quality.quality_rules(table(CASES), labels.limit(0)).where("kept").count() == 4
    kept = quality.keep_good(table(CASES), labels)
    assert kept.columns == table([]).columns and kept.count() == 4


def test_quality_certificate():
    good, junk = np.zeros(202, np.int64), np.zeros(202, np.int64)
    good[:11], junk[100:110] = 1000, 50
    assert quality.choose_cutoff(good, junk, 0.006, 0.0025, 10.0) == 99
    assert quality.choose_cutoff(good // 100, junk, 0.006, 0.0025, 10.0) is None  # too few labels for the bound
    # The bound is the exact binomial one: with no rejection in n, (1 - limit) ** n <= risk.
    assert quality.within_limit(0, 1000, 0.006, 0.0025) and not quality.within_limit(0, 990, 0.006, 0.0025)
    # A rule that would lose good documents for little junk stays loose.
    assert quality.choose_cutoff(good + junk, junk, 0.5, 0.0025, 10.0) is None


def test_quality_certificate_of_all_rules_together(table, spark):
    """150 good labels suffice for a language; languages with fewer share a certificate; good documents with high marks stay."""
    junk = lambda i: BASE + f" {i} " + "# $ % " * 20
    good = lambda i: BASE + f" {i} " + "now, then; " * (30 if i % 10 == 0 else 1)
    sizes = {"en": (160, 30), "de": (100, 20), "fr": (60, 10), None: (0, 5)}
    rows, labels = [], []
    for lang, (n_good, n_junk) in sizes.items():
        for i in range(n_good + n_junk):
            rows.append((len(rows), good(i) if i < n_good else junk(i), lang))
            labels.append((len(labels), int(i < n_good)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    lost = [r.doc_id for r in quality.quality_rules(docs, known).where("not kept").collect()]
    assert sorted(lost) == [i for i, q in labels if q == 0 and rows[i][2] is not None]  # no certificate without good labels
    few = docs.where("doc_id % 2 = 0")  # 80, 50 and 30 good: too few each, enough together
    assert few.where("lang is not null").join(quality.keep_good(few, known), "doc_id", "left_anti").count() == 30


def test_quality_path_is_nested():
    junk, others = np.zeros((2, 5, quality.STEPS + 2), np.int64)
    junk[0, 100], junk[1, 50] = 40, 10
    others[:] = 1
    others[0, 100], others[1, 50] = 41, 400
    level = quality.nested_path(junk, others)
    assert (np.diff(level, axis=1) >= 0)[:, : quality.STEPS].all() and not level[2:].any()
    assert level[0, 100] > level[1, 201] and level[0, 99] == level[1, 49] == 0


def test_mixing_cases(spark, table):
    docs = table(CASES).withColumn("sources", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("b"))).otherwise(F.array("source")))
    got = mixing.mix(docs).collect()
    assert len(got) == len(CASES) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed(table([(1, "a b c"), (2, "a b"), (2, "a b"), (3, None), (None, "x y")], source=None))
    assert out.columns == table([]).columns
    assert {r.doc_id for r in out.collect()} <= {1, 2, None}


def test_mixed_rows_keep_their_own_copies(table):
    """The words of the mix are those that mix() takes, whatever ids are null or repeated."""
    rows = [(None, "a b c"), (None, "d e"), (None, "f g h i"), (2, "k l"), (2, "m n o p q"), (2, "k l"), (3, None), (4, "r s t u v w")]
    docs = table(rows)
    taken = mixing.mix(docs.select("doc_id", F.array("source").alias("sources"), "text")).collect()
    out = mixing.mixed(docs).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in taken)
    assert max(collections.Counter((r.doc_id, r.text) for r in out).values()) <= 4  # the row that stands twice may come four times
    assert mixing.mixed(table([])).count() == 0


def test_mixing_of_overlapping_sources(spark):
    sources = [["a"], ["b"], ["a", "b"], ["b", "c"], None]
    docs = spark.createDataFrame([(i, sources[i % 5], "w " * (i % 9)) for i in range(400)], "doc_id long, sources array<string>, text string")
    got = mixing.mix(docs, lambda sizes: {s: 0.5 * n for s, n in sizes.items()}).collect()
    sizes, room = collections.Counter(), collections.Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        for s in r.sources or [None]:
            sizes[s] += r.size
            room[s] += r.taken
    # Every word serves one quota; together they are met, and no source gives more than lies in it.
    assert abs(sum(r.taken for r in got) - 0.5 * sum(sizes.values())) <= 9 * 5
    assert all(room[s] >= 0.5 * sizes[s] - 9 * 5 for s in sizes)


def test_mixing_targets():
    sizes = {"a": 100, "b": 100, "c": 1000, None: 10}
    got = mixing.source_targets(sizes)
    assert got["a"] == 200 and got[None] == 20
    assert sum(got.values()) == pytest.approx(min(1.5 * 1210, 2 * 1210))
    assert all(got[s] <= 2 * sizes[s] for s in sizes)


def test_mixing_flow_shares_overlap():
    # 100 words in both sources, 50 in each alone; quotas of 100 need no second copy.
    patterns = [(("a", "b"), 100), (("a",), 50), (("b",), 50)]
    assert mixing.route(patterns, {"a": 100, "b": 100}) == [100, 50, 50]
    # More than all words: copies are spread, the overlap is repeated like the rest and quotas are met.
    assert sum(mixing.route(patterns, {"a": 150, "b": 150})) == 300


REPEATS = [
    (1, BASE + " tail one"), (2, "head " + BASE), (3, None), (4, ""), (5, " ".join(WORDS[40:90])), (6, "z" * 400), (7, "z" * 150 + " " + BASE),
    (8, " ".join(WORDS[:30] * 4)), (9, "short"), (10, "é" * 300), (11, " ".join(WORDS * 30)),
]


def test_suffix_cases(table, monkeypatch):
    from statweave.llm import repeats

    def check():
        got = suffix_dedup.remove_repeated_bytes(table(REPEATS)).collect()
        assert {(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got} == brute.suffix_dedup(REPEATS)

    check()
    monkeypatch.setattr(repeats, "HOLD_ROWS", 3)
    check()
    none = suffix_dedup.remove_repeated_bytes(table([(None, BASE), (None, BASE), (1, BASE), (1, BASE)])).collect()
    assert [r.n_removed for r in none] == [0] * 4
    assert suffix_dedup.remove_repeated_bytes(table([])).count() == 0


def test_phrase_cases(table, monkeypatch):
    from statweave.llm import repeats

    def check():
        got = phrase_dedup.remove_repeated_words(table(REPEATS)).collect()
        assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.phrase_dedup(REPEATS)

    check()
    monkeypatch.setattr(repeats, "HOLD_ROWS", 3)
    monkeypatch.setattr(phrase_dedup, "SHARD_WORDS", 50)
    check()
    assert phrase_dedup.remove_repeated_words(table([])).count() == 0
    none = phrase_dedup.remove_repeated_words(table([(None, BASE), (1, BASE), (1, BASE)])).collect()
    assert [r.n_removed for r in none] == [0] * 3


def test_locate_first_occurrence_stays():
    passages = [(2, 0, 1, b"a b c"), (1, 5, 1, b"a b c"), (1, 9, 1, b"a b c"), (3, 0, 1, b"x y z")]
    assert sorted(phrase_dedup.locate(passages)) == [(1, 9, 1), (2, 0, 1)]


def test_license_cases(table):
    texts = CASES + [
        (20, "Licensed under the Apache License, Version 2.0. Apache License"), (21, "CC BY-NC 4.0"), (22, "mit\n\nLICENSE"), (23, "xmit license"),
        (24, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (24, "mit license"),
        (25, "redistribution and use were discussed in binary and source form"),
    ]
    got = license_scan.scan(table(texts)).collect()
    keyed = [(d if d is not None else -1, t) for d, t in texts]
    assert {(r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:6]) for r in got} == brute.licenses(keyed)
    labels = collections.defaultdict(set)
    for r in got:
        labels[r.doc_id] |= set(r.labels.split(","))
    assert labels[20] == {"apache"} and labels[24] == {"mit"} and labels[25] == {""}
    assert license_scan.scan(table([])).count() == 0


def test_license_of_several_notices(table):
    """Every notice that stands word for word is found, whatever other licence words the file or the corpus holds."""
    notices = [(label, n) for label, n, _ in license_scan.TEMPLATES if label in ("lgpl", "mit", "bsd", "mpl") and not n.startswith("released")]
    vocabulary = sorted({p[3] for p in license_scan._postings()})
    texts = [(i, " ".join(vocabulary[: i + 1])) for i in range(len(vocabulary))]  # no two words are equally frequent
    texts += [(500, f" {BASE} ".join([*(n for _, n in notices), *vocabulary[:5]])), (501, " ".join(reversed(notices[0][1].split())))]
    got = {r.doc_id: r for r in license_scan.scan(table(texts)).collect()}
    assert len(notices) == 4 and got[500].labels == "bsd,lgpl,mit,mpl" and got[500].score == pytest.approx(1.0)
    assert got[501].labels == ""


def test_toxicity_cases(table, spark):
    texts = [(i, BASE + (" vile rotten" if i % 3 == 0 else " kind")) for i in range(60)] + CASES[3:] + [(200, "vile rotten " * 500)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5, 0), (7, 2), (8, -1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(table(texts), labels).collect()}
    assert got[200].predicted == 1 and got[4].score < 0.3 and got[5].score < 0.3
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(20, 60))
    assert toxicity.score_documents(table([]), labels).count() == 0
    assert toxicity.score_documents(table(CASES), labels.limit(0)).where("predicted = 1").count() == 0


def test_maximal_segments():
    def plain(scores):
        # All maximal segments, by repeatedly taking the best one and looking left and right of it.
        if not any(s > 0 for s in scores):
            return []
        best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
        a, b = -best[2], -best[2] - best[1]
        left, right = plain(scores[:a]), plain(scores[b:])
        return left + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in right]

    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-5, 6, 12).tolist()
        got = [(a, b, round(s)) for a, b, s in toxicity.maximal_segments(list(range(12)), scores, -1.0)]
        assert sum(s for *_, s in got) == sum(s for *_, s in plain(scores))
        assert max((s for *_, s in got), default=0) == max((s for *_, s in plain(scores)), default=0)


def test_metric_cases(spark):
    rows = [
        (0, [0.5, -0.25]), (50, [0.5, -0.25]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, []), (300, [3.0]),
        (1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [9.0, 9.0]), (3, [9.0, 9.0]), (None, [5.0, 5.0]), (4, [-0.001, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in metric_search.top_inner_products(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, x in {i: v for i, v in usable if i % 50 == 0}.items():
        want = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q and len(x) == len(y)))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert metric_search.top_inner_products(df.limit(0)).count() == 0


def test_metric_pages(spark, monkeypatch):
    monkeypatch.setattr(metric_search, "PAGE_ROWS", 40)
    monkeypatch.setattr(metric_search, "CHUNK_ROWS", 300)
    monkeypatch.setattr(metric_search, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 6))
    x[300:600] = x[300]  # one point for a third of all rows
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    q = np.floor(256 * x).astype(np.int64)
    got = collections.defaultdict(list)
    for r in metric_search.top_inner_products(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for i in range(0, 900, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(900), -s)) if j != i][:5]
        assert sorted(got[i]) == [(k + 1, j, s[j]) for k, j in enumerate(order)]


def test_packing_of_added_tokens(table):
    """A text that spells an added token has its one id, with and without the rank file."""
    from tokenizers import Tokenizer

    from statweave.llm.queries import RANKS

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "plain <|endof text", "é<|endoftext|>"]
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    for ranks in (None, tokenizer_path(RANKS)):
        got = packing.token_pieces(table(list(enumerate(texts))), tokenizer_path(), ranks=ranks).collect()
        assert {r.doc_id: r.length for r in got} == want


def test_packing_fits_place_most_pieces():
    rng = np.random.default_rng(5)
    need = np.bincount(np.clip(rng.normal(870, 300, 40_000).astype(int), 1, 2048), minlength=2049)
    plan = packing.plan_sequences(need)
    assert (sum(np.bincount(list(p), minlength=2049) * n for p, n in plan) == need).all() and all(sum(p) <= 2048 for p, _ in plan)
    tokens = int((need * np.arange(2049)).sum())
    assert sum(n for _, n in plan) <= 1.07 * (tokens // 2048 + 1)
    exact = sum(n * len(p) for p, n in plan if sum(p) == 2048 and len(p) <= 3)
    assert exact >= 0.85 * need.sum()


def test_packing_cases(spark, table):
    got = packing.pack_documents(table(CASES), tokenizer_path()).collect()
    assert {r.doc_id for r in got} == {d for d, _ in CASES}
    assert {r.length for r in got if r.doc_id in (4, 5)} == {1}
    assert packing.pack_documents(table([]), tokenizer_path()).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(4)
    need = np.bincount(np.minimum(64, rng.geometric(0.05, 5000)), minlength=65)
    plan = packing.plan_sequences(need, 64)
    used = np.zeros(65, np.int64)
    for pattern, times in plan:
        assert times > 0 and sum(pattern) <= 64
        np.add.at(used, list(pattern), times)
    assert (used == need).all()
    assert sum(t for _, t in plan) <= -(-(need * np.arange(65)).sum() // 64) + 2


def test_personal_cases(spark, table):
    texts = CASES + [
        (30, "a@b.c_x@y.z, é 999.1.1.1 10.0.0.1.5 +1 (555) 123-4567"), (31, "4111 1111 1111 1111 and 4111111111111112"), (32, "1" * 3000),
        (33, "@@ x@y a.b@c-d.e.f 1.2.3 000000255.1.1.1"), (34, "a" * 4000 + "@b.c"), (34, "+" * 50 + "12345678"),
    ]
    keyed = [(d if d is not None else -1, t) for d, t in texts]
    want = {(d, t): brute.personal([(d, t)])[d] for d, t in keyed}
    got = collections.Counter()
    for r in pii.find(table(texts)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", pii.listed("base").alias("b")).collect():
        got[(r.doc_id if r.doc_id is not None else -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.b)] += 1
    assert got == collections.Counter((d, *w[:4], ",".join(w[4])) for (d, _), w in want.items())
    assert pii.find(table([])).count() == 0


def test_personal_terms_are_removed(table):
    texts = [(i, f"Please ask {n} Zorblax at help{n}@corp.example about item {i}.") for i, n in enumerate(["anna", "bert"] * 4)]
    texts = [(i, t.replace("anna Zorblax", "Zorblax").replace("bert Zorblax", "Quimby")) for i, t in texts]
    texts += [(10 + i, BASE) for i in range(400)] + [(500, "Today Zorblax sleeps. zorblaxes too")]
    clean = pii.sanitised(table(texts))
    assert clean.columns == table([]).columns
    by = {r.doc_id: r.text for r in clean.collect()}
    assert by[500] == "Today [TERM] sleeps. zorblaxes too"
    assert by[0] == "Please ask [TERM] at [EMAIL] about item 0."
    assert by[10] == BASE


def test_personal_terms_of_few_places(table):
    names = {"anna": "Zorblax", "bert": "Quimby", "carl": "Wexford", "dora": "Ullmann"}
    texts = [(10 * k + i, f"Please ask {t} at help{n}@corp.example about item {i}.") for i, (n, t) in enumerate(names.items()) for k in range(2)]
    texts += [(100, "Please ask Yttrian at once@corp.example about item 9."), (101, "Today Yttrian sleeps, Zorblax too")]
    by = {r.doc_id: r.text for r in pii.sanitised(table(texts + [(200 + i, BASE) for i in range(400)])).collect()}
    assert by[0] == by[10] == "Please ask [TERM] at [EMAIL] about item 0."  # two copies
    assert by[100] == "Please ask [TERM] at [EMAIL] about item 9."  # one place
    assert by[101] == "Today [TERM] sleeps, [TERM] too"
    assert by[200] == BASE


def test_kernel_hashes_are_content_hashes():
    buf = np.frombuffer("one two one two".encode(), np.uint8)
    words, first = kernel.word_hashes(buf, np.array([0, 7, 15]))
    assert words[0] == words[2] and words[1] == words[3] and words[0] != words[1] and first.tolist() == [0, 2, 4]
    assert kernel.sliding_min(np.array([5, 3, 4, 1, 9]), 3).tolist() == [3, 1, 1]


def test_metric_search_handles_only_what_can_enter():
    """Scores below the k-th best never reach Python numbers; ties with it do, as the smaller id wins."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (600, 6))
    ids, longest = rng.permutation(600).astype(np.int64), float((vectors**2).sum(1).max())
    near = rng.integers(0, 4, 600)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            got = super().__getitem__(at)
            seen.append(np.size(got))
            return got

    pages = []
    for n in range(4):
        own = near == n
        page = metric_search.build_page(ids[own], vectors[own], metric_search.lifted(vectors[own][:1], longest)[0], longest)
        pages.append({**page, "plain": page["vectors"].astype(float), "ids": page["ids"].view(Watched)})
    for q in range(10):
        scores = vectors @ vectors[q]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q])[:5]
        assert metric_search.search(vectors[q], int(ids[q]), pages, 5, longest) == [(-s, i) for s, i in best]
    assert sum(seen) < 10 * 600 / 4
    assert metric_search.search(vectors[0], 1, [], 5, longest) == []


def test_words_are_numbered_as_they_are_met():
    number = phrase_dedup._Ids().__getitem__
    assert list(map(number, b"a b a c b".split())) == [0, 1, 0, 2, 1]
    words = b" ".join(b"w%d" % i for i in range(21))
    assert phrase_dedup.locate([(3, 0, 2, words), (1, 4, 2, words), (2, 0, 1, words[:-4]), (4, 9, 2, words)]) == [(3, 0, 2), (4, 9, 2)]


def test_passages_whose_name_stands_alone_reach_no_automaton(monkeypatch):
    import pyarrow as pa

    seen = []
    real = phrase_dedup.locate
    monkeypatch.setattr(phrase_dedup, "locate", lambda held: seen.extend(held) or real(held))
    words = {k: b" ".join(b"%d-%d" % (k, i) for i in range(20)) for k in range(12)}
    names = [0, 1, 1, 2, 3, 3, 3, 4, 5, 5, 6, 7, 8, 8, 9, 10, 11, 11]
    rows = [(k, 100 - n, n, 1, words[k]) for n, k in enumerate(names)]
    rows.insert(6, (3, 7, 70, 2, None))  # settled before, among rows of one name
    later = {(100 - n, n, 1) for n, k in enumerate(names) if k in names[n + 1 :]} | {(7, 70, 2)}
    for size in (1, 2, 3, 5, 100):
        seen.clear()
        batches = [pa.RecordBatch.from_pylist([dict(zip(phrase_dedup._PASSAGE.names, r)) for r in rows[i : i + size]], phrase_dedup._PASSAGE) for i in range(0, len(rows), size)]
        out = [tuple(r.values()) for b in phrase_dedup._located(iter(batches)) for r in b.to_pylist()]
        assert len(out) == len(set(out)) and set(out) == later
        assert len(seen) == sum(names.count(k) > 1 for k in names)


def test_a_context_of_one_window_is_no_repetition_of_itself():
    text = b"  ".join(b"w%d" % i for i in range(30)) + b"\n"
    plain, (name, start, count, begin, end) = phrase_dedup._candidates(text, np.array([4, 4, 2, 9, 25]), np.array([1, -2, 3, -1, 1]), 20)
    assert list(zip(start.tolist(), count.tolist())) == [(2, 3), (4, 1), (5, 1), (9, 1)]
    assert len(set(name.tolist())) == 4
    assert [plain[a:b].split() for a, b in zip(begin, end)] == [text.split()[s : s + c + 19] for s, c in zip(start, count)]
