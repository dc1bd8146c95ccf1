"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose measure lies above a cutoff. The cutoffs of all rules are tightened along one path of nested rule
sets, for each stratum apart. Documents that are not labelled good order the path: steps that reach much labelled junk for few
documents come first. Documents labelled good, which had no say in the order, certify it: from the loosest rule set on, one is certified
while the exact binomial upper bound of the share of good documents that its rules reject together stays within the limit, and the walk
ends at the first that is not. The order is fixed beforehand, so the walk needs no correction; the number of strata is corrected for
(Bonferroni). Of the certified rule sets the one that rejects most labelled junk is used.

Strata with too few good labels for any certificate are certified together, and if they still have too few, on the labels of all
strata. Such a certificate bounds the share that the labelled mix loses, not that of each stratum in it. Where even this does not
suffice, and in strata without good labels, nothing is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.llm import kernel
from statweave.llm.frames import local_table, map_batches, stored

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]
STEPS = 200
"""Cutoffs lie on a grid of this many steps between 0 and 1."""

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:,.")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_CHAR = np.ones(256, bool)
_CHAR[0x80:0xC0] = False
_CHAR[[32, 9, 10, 11, 12, 13]] = False


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.when(F.col(whole) > 0, F.col(whole)), F.lit(0.0))


def rules() -> dict[str, Column]:
    """The measure that each rule compares with its cutoff, between 0 and 1."""
    return {
        "symbols": _ratio("n_symbols", "word_chars"),
        "repeats": _ratio("n_repeat_words", "n_words"),
        "lines": _ratio("n_dup_lines", "n_lines"),
        "capitals": _ratio("n_capitals", "word_chars"),
        "marks": _ratio("n_marks", "word_chars"),
    }


def measure_batch(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of each text of a batch."""

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offs[1:]] - sums[offs[:-1]]

    words, first = kernel.word_hashes(buf, offs)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    covered = np.zeros(len(words), bool)
    grams = kernel.gram_hash(words, 3)
    at = np.flatnonzero(doc[: len(grams)] == doc[2 : len(grams) + 2]) if len(grams) else np.zeros(0, np.int64)
    if len(at):
        key = kernel.mix(grams[at] ^ kernel.mix(doc[at].astype(np.uint64)))
        _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
        again = at[counts[where] > 1]
        for k in range(3):
            covered[again + k] = True
    repeats = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])

    data, dup, lines = buf.tobytes(), [], []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        held = [x for x in data[a:b].split(b"\n") if x.split()]
        lines.append(len(held))
        dup.append(len(held) - len(set(held)))
    return {
        "n_words": n_words,
        "word_chars": per_text(_CHAR[buf]),
        "n_symbols": per_text(_SYMBOL[buf]),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": repeats[first[1:]] - repeats[first[:-1]],
        "n_lines": np.array(lines, np.int64),
        "n_capitals": per_text(_CAPITAL[buf]),
        "n_marks": per_text(_MARK[buf]),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in kernel.slices(batch):
            found = measure_batch(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=["row", *MEASURES]
            )


def measured(rows: DataFrame) -> DataFrame:
    """rows: a struct column row and the text; returns row and the measures."""
    schema = T.StructType([rows.schema["row"], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return map_batches(rows.select("row", F.col("text").cast("binary").alias("text")), _measured, schema)


def base_failed() -> Column:
    """The fixed rules: fewer than 50 words, or more than half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def within_limit(bad: int, total: int, limit: float, risk: float) -> bool:
    """Whether the exact binomial upper bound, at confidence 1 - risk, of a rate seen bad times in total is within the limit."""
    if total == 0 or bad >= total * limit:
        return False
    log = [
        math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(limit) + (total - k) * math.log1p(-limit)
        for k in range(bad + 1)
    ]
    top = max(log)
    return top + math.log(sum(math.exp(x - top) for x in log)) <= math.log(risk)


def choose_cutoff(good: np.ndarray, junk: np.ndarray, limit: float, risk: float, good_cost: float) -> int | None:
    """Index of the grid cutoff to use, or None.

    good, junk: labelled documents by grid step of their measure; a cutoff c rejects the steps above c.
    """
    total, best, pick = int(good.sum()), 0.0, None
    for cutoff in range(len(good) - 2, -1, -1):
        lost, caught = int(good[cutoff + 1 :].sum()), int(junk[cutoff + 1 :].sum())
        if not within_limit(lost, total, limit, risk):
            break
        if caught - good_cost * lost > best:
            best, pick = caught - good_cost * lost, cutoff
    return pick


def nested_path(junk: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The order in which cutoffs are tightened: for each rule and grid step the level at which it is reached, 0 for never.

    junk, others: documents by rule and grid step; others are all that are not labelled good. A rule set rejects what lies above a
    level; higher levels are rejected first. Each rule moves along the steepest gains of junk by documents, and the rules are merged by
    this gain. Cutoffs that reach no more junk are not on the path.
    """
    moves = []
    for rule in range(len(junk)):
        # Documents above each cutoff, from the loosest one, which has none.
        caught, hit = (np.append(np.cumsum(x[rule][:0:-1])[::-1], 0).astype(float) for x in (junk, others))
        at, steepest = STEPS + 1, math.inf
        while at and caught[0] > caught[at]:
            gain = (caught[:at] - caught[at]) / (hit[:at] - hit[at] + 1)
            to = int(np.flatnonzero(gain == gain.max())[-1])
            steepest = min(steepest, float(gain[to]))
            moves.append((-steepest, rule, -at, to))
            at = to
    steps = [(rule, cutoff) for _, rule, at, to in sorted(moves) for cutoff in range(-at - 1, to - 1, -1)]
    level = np.zeros(junk.shape, np.int64)
    for nth, (rule, cutoff) in enumerate(steps):
        level[rule, cutoff + 1] = len(steps) - nth
    return level


def _tests(totals: list, limit: float, allowed: float) -> tuple[list[tuple], list[tuple]]:
    """Which strata are certified together: rows of stratum and test, of those whose labels are used and of those that get the cutoffs.

    totals: rows of stratum and good (labelled documents).
    """
    enough = lambda n: within_limit(0, n, limit, allowed)
    small = [r.stratum for r in totals if not enough(r.good)]
    served = [(r.stratum, nth + 1) for nth, r in enumerate(totals) if enough(r.good)]
    few = not enough(sum(r.good for r in totals if not enough(r.good)))
    pooled = [r.stratum for r in totals] if few else small
    pool = [(x, 0) for x in pooled] if small else []
    return served + pool, served + [(x, 0) for x in small]


def learn_cutoffs(
    measures: DataFrame, labels: DataFrame, limit: float = 0.03, risk: float = 0.05, good_cost: float = 10.0
) -> DataFrame:
    """Certified cutoffs: one row for each stratum with good labels, a column for each rule (null: the rule rejects nothing there).

    measures: doc_id, stratum and the measures. labels: doc_id, quality (1 good, 0 junk); ids labelled both ways are left out.
    limit: allowed share of good documents that all rules together reject in a stratum, or in the pool of strata with few labels.
    risk: allowed probability that any bound fails. good_cost: junk documents that must be caught for each good one that is lost.
    """
    names = list(rules())
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    # Documents that the fixed rules reject anyway say nothing about the cutoffs.
    step = lambda c: F.least(F.ceil(c * STEPS), F.lit(STEPS + 1)).cast("int")
    passed = measures.where(~base_failed()).select("doc_id", "stratum", F.array(*[step(c) for c in rules().values()]).alias("steps"))
    rows = stored(passed.join(known, "doc_id").select("stratum", "quality", "steps"), "quality-labelled")
    tally = [F.sum((F.col("quality") == k).cast("long")).alias(n) for n, k in (("good", 1), ("junk", 0))]
    counts = (
        rows.unionByName(passed.select("stratum", F.lit(None).cast(rows.schema["quality"].dataType).alias("quality"), "steps"))
        .select("stratum", "quality", F.posexplode("steps").alias("rule", "step"))
        .groupBy("stratum", "rule", "step").agg(*[F.coalesce(t, F.lit(0)).alias(n) for t, n in zip(tally, ("good", "junk"))], F.count_if(F.col("quality").isNull()).alias("every"))
    )
    counts = stored(counts, "quality-counts")
    totals = rows.groupBy("stratum").agg(tally[0]).where("good > 0").orderBy("stratum").collect()
    allowed = risk / max(1, len(totals))
    spark, kind = measures.sparkSession, T.StructType([T.StructField("_stratum", counts.schema["stratum"].dataType), T.StructField("test", T.IntegerType())])
    used, served = (F.broadcast(local_table(spark, x, kind)) for x in _tests(totals, limit, allowed))
    same = F.col("stratum").eqNullSafe(F.col("_stratum"))

    def order(pdf):
        import pandas as pd

        junk, others = np.zeros((2, len(names), STEPS + 2), np.int64)
        np.add.at(junk, (pdf["rule"], pdf["step"]), pdf["junk"])
        np.add.at(others, (pdf["rule"], pdf["step"]), pdf["every"] - pdf["good"])
        return pd.DataFrame({"test": [pdf["test"].iloc[0]], "level": [nested_path(junk, others).tolist()]})

    paths = stored(counts.join(used, same).groupBy("test").applyInPandas(order, "test int, level array<array<int>>"), "quality-paths")
    paths = F.broadcast(paths)
    reached = F.array_max(F.transform("steps", lambda s, i: F.get(F.get("level", i), s)))
    found = rows.join(used, same).join(paths, "test").withColumn("reached", reached).groupBy("test", "reached").agg(*tally).join(paths, "test")

    def certify(pdf):
        import pandas as pd

        level = np.array(pdf["level"].iloc[0].tolist())
        good, junk = np.zeros((2, level.max() + 1), np.int64)
        good[pdf["reached"]] = pdf["good"]
        junk[pdf["reached"]] = pdf["junk"]
        pick = choose_cutoff(good, junk, limit, allowed, good_cost)
        loose = np.full(len(names), STEPS + 1) if pick is None else (level <= pick).cumprod(axis=1).sum(axis=1) - 1
        return pd.DataFrame([{"test": pdf["test"].iloc[0]} | {n: None if c > STEPS else c / STEPS for n, c in zip(names, loose)}])

    schema = T.StructType([kind["test"], *(T.StructField(n, T.DoubleType()) for n in names)])
    cutoffs = found.groupBy("test").applyInPandas(certify, schema)
    return stored(served.join(cutoffs, "test").select(F.col("_stratum").alias("stratum"), *names), "quality-cutoffs")


def judged(measures: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed and kept. A document goes if a fixed rule fails or a measure lies above its stratum's cutoff."""
    limits = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(n).alias(f"_{n}") for n in rules()])
    above = F.lit(False)
    for name, value in rules().items():
        above = above | F.coalesce(F.ceil(value * STEPS) > F.round(F.col(f"_{name}") * STEPS), F.lit(False))
    joined = measures.join(limits, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    joined = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~above)
    return joined.drop("_stratum", *[f"_{n}" for n in rules()])


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """Measures and verdict of every document: doc_id, stratum, the measures, base_failed, kept; one row per input row.

    docs: doc_id, text and the stratum column. Null and empty texts have no words and fail the fixed rules; a null stratum is one of
    its own; rows without doc_id are judged but never labelled. Repeated rows are judged alike. Empty tables: an empty result, or no
    cutoffs.
    """
    rows = docs.select(F.struct("doc_id", F.col(stratum).alias("stratum")).alias("row"), "text")
    measures = stored(measured(rows).select("row.*", *MEASURES), "quality-measures")
    return judged(measures, learn_cutoffs(measures, labels, **how))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """The documents that pass, with all their columns. Texts are read twice and never shuffled."""
    rows = docs.select(F.struct("doc_id", F.col(stratum).alias("stratum")).alias("row"), "text")
    measures = stored(measured(rows).select("row.*", *MEASURES), "quality-measures")
    cutoffs = learn_cutoffs(measures, labels, **how)
    whole = measured(docs.select(F.struct("*").alias("row"), "text")).withColumn("stratum", F.col(f"row.{stratum}"))
    return judged(whole, cutoffs).where("kept").select("row.*")
