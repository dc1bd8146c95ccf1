"""Toxic passages as maximum-scoring segments.

Words get log-odds between toxic and clean training documents, shrunk towards the corpus by a Dirichlet prior. A linear scan finds all
maximal segments of a text whose words add up to a positive score. How high segments rise by chance is fitted on clean training
documents (the count of segments above a score falls exponentially), which turns scores of any text length into one scale; a
logistic curve on that scale gives the probability of the label.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statweave.llm import kernel
from statweave.llm.frames import map_batches, stored, with_bytes

LABELLED = 2_000_000
"""About so many labelled documents are learned from, a sample by a hash of their ids if there are more. It bounds the model's size."""
SURE = 16.0
"""Least log-likelihood ratio of a word's document counts for it to have log-odds of its own."""
TELLING = 1.0
"""Least log-odds of a word that speaks for toxicity: weaker ones are topics rather than insults."""
COUNT_CHUNK = 2_000_000
SLOTS = 1 << 16
NOTHING = -10.0

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclasses.dataclass
class Model:
    terms: np.ndarray  # sorted word hashes
    scores: np.ndarray  # their log-odds
    rest: float  # log-odds of any other word
    decay: float = 1.0
    rate: float = 0.1
    slope: float = 1.0
    shift: float = 0.0


def text_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (letters, digits and all non-ASCII) and where each text begins among them."""
    buf = kernel.lower_ascii(buf)
    start, end, first = kernel.find_words(buf, offs, _INSIDE)
    return kernel.range_hash(kernel.rolling(buf), start, end), first


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {0: [], 1: []}
    size = 0

    def out():
        words = [np.concatenate(held[k]) if held[k] else np.zeros(0, np.uint64) for k in (0, 1)]
        names, where = np.unique(np.concatenate(words), return_inverse=True)
        cut = len(words[0])
        clean, toxic = (np.bincount(w, minlength=len(names)) for w in (where[:cut], where[cut:]))
        return pa.record_batch({"word": names.view(np.int64), "toxic": toxic.astype(np.int64), "clean": clean.astype(np.int64)})

    for batch in batches:
        for rows, buf, offs in kernel.slices(batch):
            words, first = text_words(buf, offs)
            # Documents are counted, not words: one text that repeats itself is one witness.
            for toxic, a, b in zip(rows.column("toxic").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                held[toxic].append(np.unique(words[a:b]))
                size += len(held[toxic][-1])
            if size >= COUNT_CHUNK:
                yield out()
                held, size = {0: [], 1: []}, 0
    if size:
        yield out()


def learn_terms(labelled: DataFrame, prior: float = 1000.0) -> Model:
    """Log-odds of words; labelled: text, toxic (0 or 1). prior: words' worth of corpus that both classes are shrunk towards."""
    counts = stored(
        map_batches(labelled.select("toxic", F.col("text").cast("binary").alias("text")), _class_counts, "word long, toxic long, clean long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "toxic-counts",
    )
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    toxic, clean = total["toxic"] or 0, total["clean"] or 0
    if not toxic or not clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0)
    both = F.col("toxic") + F.col("clean")
    share = prior * both / float(toxic + clean)
    a, b = F.col("toxic") + share, F.col("clean") + share
    odds = F.log(a / (toxic + prior - a)) - F.log(b / (clean + prior - b))
    part = lambda seen, whole: F.when(seen > 0, seen * F.log(seen * float(toxic + clean) / (both * float(whole)))).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), toxic) + part(F.col("clean"), clean))
    ranked = counts.withColumn("score", odds).withColumn("ratio", ratio).where((F.col("ratio") >= SURE) & ((F.col("score") >= TELLING) | (F.col("score") < 0)))
    top = ranked.toPandas()
    order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    terms, scores = top["word"].to_numpy(np.int64).view(np.uint64)[order], top["score"].to_numpy(float)[order]
    other = [(n + prior - float(top[c].sum())) / (n + prior) for c, n in (("toxic", toxic), ("clean", clean))]
    rest = math.log(max(other[0], 1e-9) / max(other[1], 1e-9))
    return Model(terms, scores, min(rest, -1e-3))


def maximal_segments(at: list[int], scores: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All maximal segments of positive score: first word, word after the last, score. Linear in the scored words.

    at: places of the words with a score of their own, ascending; all words between them score rest (negative).
    """
    kept: list[list] = []  # begin, end, total before, total after
    total, place = 0.0, 0
    for x, s in zip(at, scores):
        total += rest * (x - place)
        place = x + 1
        before = total
        total += s
        if s <= 0:
            continue
        new = [x, x + 1, before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            # The stretch from an earlier, lower start is better still: take all of it.
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after in kept]


def _scan(model):
    segment = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("segments", pa.list_(segment))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        slots = np.zeros(SLOTS, bool)
        slots[(m.terms & np.uint64(SLOTS - 1)).astype(np.int64)] = True
        for batch in batches:
            for rows, buf, offs in kernel.slices(batch):
                words, first = text_words(buf, offs)
                maybe = np.flatnonzero(slots[(words & np.uint64(SLOTS - 1)).astype(np.int64)])
                if len(maybe):
                    found = np.minimum(np.searchsorted(m.terms, words[maybe]), len(m.terms) - 1)
                    same = m.terms[found] == words[maybe]
                    maybe, found = maybe[same], found[same]
                else:
                    found = maybe
                own = np.searchsorted(maybe, first)
                out = []
                for a, b, begin in zip(own[:-1].tolist(), own[1:].tolist(), first.tolist()):
                    segments = maximal_segments((maybe[a:b] - begin).tolist(), m.scores[found[a:b]].tolist(), m.rest) if b > a else []
                    out.append([{"start": x, "end": y, "score": s} for x, y, s in segments])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(out, schema.types[2])], schema=schema
                )

    return run


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Words and maximal toxic segments of every text: doc_id, n, segments (start, end in words, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(with_bytes(docs, "doc_id"), _scan(shared), "doc_id long, n long, segments array<struct<start:int,end:int,score:double>>")


def fit_tail(levels: np.ndarray, above: np.ndarray, words: int) -> tuple[float, float]:
    """Decay and rate of chance segments: words * rate * exp(-decay * level) of them lie above a level (weighted least squares)."""
    some = above >= 5
    if some.sum() < 3 or not words:
        return 1.0, max(float(above[0]) if len(above) else 0.0, 1.0) / max(words, 10)
    x, y, w = levels[some], np.log(above[some] / words), above[some].astype(float)
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    slope = float((w * (x - mx) * (y - my)).sum() / max((w * (x - mx) ** 2).sum(), 1e-12))
    decay = min(max(-slope, 0.05), 5.0)
    return decay, math.exp(my + decay * mx)


def fit_logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through binned counts (Newton steps with a small ridge)."""
    n = positive + negative
    a, b = 0.1, math.log((positive.sum() + 1) / (negative.sum() + 1)) if n.sum() else 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, v = positive - n * p, n * p * (1 - p)
        g = np.array([(r * x).sum() - 1e-2 * a, r.sum() - 1e-2 * b])
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def significance(model: Model) -> Column:
    """Surprise of a text's segments beyond chance for its length; below 0 without a surprising one, least without any."""
    bar = F.log(F.lit(model.rate) * F.greatest(F.col("n"), F.lit(1)))
    height = lambda s: s["score"] * model.decay - bar
    total = F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), height(s)))
    best = F.coalesce(F.array_max(F.transform("segments", height)), F.lit(NOTHING))
    return F.greatest(F.lit(NOTHING), F.least(F.lit(60.0), F.when(total > 0, total).otherwise(best)))


def held_out() -> Column:
    """Every fourth document, by a checksum of its id: never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Probability of the toxic label for every document.

    docs: doc_id, text. labels: doc_id, toxic (0 or 1); learned from only where the id is not held out; ids labelled both ways are
    left out, as are labels of another value. Returns doc_id, held_out, score, predicted, n (words) and segments; one row per input row. Null and empty texts have
    no segment and get the lowest evidence; rows without doc_id are scored, not held out and not learned from. Without labels of
    both kinds all scores are low and equal evidence. An empty table gives an empty result.
    """
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .where("toxic = other").select("doc_id", "toxic").where(~held_out())
    )
    share = LABELLED / max(LABELLED, known.count())
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Labels grow with the documents, so this join shuffles at every size.
    training = docs.select("doc_id", "text").where(~held_out()).join(known.hint("merge"), "doc_id")
    model = learn_terms(training)
    scanned = stored(passages(docs, model), "toxic-segments")

    learned = scanned.join(known, "doc_id")
    words = learned.where("toxic = 0").agg(F.sum("n")).first()[0] or 0
    steps = (
        learned.where("toxic = 0").select(F.explode("segments").alias("s"))
        .groupBy(F.floor(F.least(F.col("s.score"), F.lit(30.0)) * 4).cast("int").alias("step")).count().collect()
    )
    found = np.zeros(122, np.int64)
    for row in steps:
        found[row["step"]] += row["count"]
    above = found[::-1].cumsum()[::-1]
    model.decay, model.rate = fit_tail(np.arange(122) / 4, above, words)

    x = F.round(significance(model) * 8).cast("int").alias("x")
    bins = learned.groupBy(x).agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).collect()
    if bins:
        model.slope, model.shift = fit_logistic(*(np.array([b[k] for b in bins], float) / d for k, d in (("x", 8), ("p", 1), ("q", 1))))
    else:
        model.slope, model.shift = 0.0, -4.0
    score = 1 / (1 + F.exp(-(model.slope * significance(model) + model.shift)))
    return scanned.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"), "n", "segments",
    )
