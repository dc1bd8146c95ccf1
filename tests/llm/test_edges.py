"""Empty tables through every stage of the pipeline, and texts of more than a megabyte."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from statweave.llm import packing, pii, quality, toxicity  # noqa: E402
from statweave.llm.frames import read_table  # noqa: E402
from statweave.llm.queries import tokenizer_path  # noqa: E402


def test_stages_of_an_empty_table(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    nothing = read_table(spark, sf, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, nothing, sf)
        assert out.count() == 0
        assert name == pipeline.STAGES[-1][0] or out.columns == nothing.columns


LONG = ("plain words stand here " * 60_000) + "write to someone@example.org or +49 30 1234567 now"
ROWS = [(1, LONG), (2, "short text"), (3, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in ROWS], "doc_id long, text string, lang string")


def test_long_texts_are_measured(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = quality.quality_rules(docs, labels, "lang").collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {tuple(r[n] for n in names) for r in got} == brute.quality(ROWS)


def test_long_texts_are_scored(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 3 and got[1].n == len(LONG.replace("@", " ").replace(".", " ").replace("+", " ").split()) and 0 <= got[1].score <= 1


def test_long_texts_are_packed(docs):
    got = sorted((r.piece, r.start, r.length) for r in packing.pack_documents(docs, tokenizer_path()).where("doc_id = 1").collect())
    assert len(got) > 100 and all(n == 2048 for _, _, n in got[1:])
    assert [a for _, a, _ in got] == [sum(n for _, _, n in got[:k]) for k in range(len(got))]


def test_personal_data_of_long_texts(docs):
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    counts = {i: [r.n_email, r.n_ip, r.n_card, r.n_phone] for i, r in found.items()}
    assert counts == {i: list(c[:4]) for i, c in brute.personal(ROWS).items()} and counts[1] == [1, 0, 0, 1]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "example.org" not in clean[1] and len(clean[1]) > 1_000_000 and clean[3] is None
