"""The registered queries against brute force on the smallest tables."""

import collections
import hashlib
import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from statweave.llm.frames import read_table  # noqa: E402
from statweave.llm.queries import ORACLES, QUERIES, tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]


def result(spark, sf, number):
    name = next(q for q in QUERIES if q.startswith(f"op{number}_"))
    return QUERIES[name](spark, sf).collect()


def test_ngram_join(spark, sf, rows):
    assert {tuple(r) for r in result(spark, sf, 1)} == brute.ngram_join(rows)


def test_quality(spark, sf, rows):
    got = result(spark, sf, 2)
    assert {tuple(r)[:7] for r in got} == brute.quality(rows)
    assert not any(r.base_failed and r.kept for r in got)


def test_mixing(spark, sf, rows):
    got = result(spark, sf, 3)
    assert len(got) == len(rows)
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    source = dict(read_table(spark, sf, "documents").select("doc_id", "source").collect())
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sorted(got) == sorted(result(spark, sf, 3))


def test_suffix_dedup(spark, sf, rows):
    assert {tuple(r) for r in result(spark, sf, 4)} == brute.suffix_dedup(rows)


def test_phrase_dedup(spark, sf, rows):
    assert {tuple(r) for r in result(spark, sf, 5)} == brute.phrase_dedup(rows)


def test_licenses(spark, sf, rows):
    got = result(spark, sf, 6)
    assert {tuple(r)[:6] for r in got} == brute.licenses(rows)
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_toxicity(spark, sf, rows):
    got = result(spark, sf, 7)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_metric_search(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in result(spark, sf, 8)) == sorted(con.execute(ORACLES["op8_metric_top_k"]).fetchall())


def test_packing(spark, sf, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in result(spark, sf, 9):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > 2048 or len(pieces[d]) == 1)
    total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
    assert len(sequences) <= 1.02 * (total // 2048 + 1) + 1


def test_personal(spark, sf, rows):
    expected = brute.personal(rows)
    for r in result(spark, sf, 10):
        *counts, spans = expected[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == spans


def test_pipeline(spark, sf, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = read_table(spark, sf, "documents")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    failed = {d for d, *_, bad in brute.quality(rows) if bad}
    first = kept["quality rules"]
    assert not failed & set(first)
    alone = {c for _, _, c in brute.ngram_join(first.items())}
    assert set(kept["n-gram Jaccard join"]) == alone
    assert set(kept["personal data"]) == alone
    for counts in brute.personal(kept["personal data"].items()).values():
        assert not counts[0] and not counts[1]
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == len(kept["source mixing"])
