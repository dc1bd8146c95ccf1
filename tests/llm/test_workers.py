"""How many Python workers an executor keeps: one for each core and Python step of a stage, and more for every further kind."""

import re

from statweave.llm import frames, mixing, ngram_join, quality

PYTHON = re.compile(r"MapInArrow|MapInPandas|FlatMapGroups|ArrowEvalPython|BatchEvalPython")


def python_steps(df):
    """Most Python steps that a stage of the plan runs one upon the other."""
    above, most = [], 0  # depth in the plan and Python steps so far of the nodes that lead here
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.search(r"[A-Za-z]", line).start() if re.search(r"[A-Za-z]", line) else 0
        above = [x for x in above if x[0] < depth]
        steps = 0 if "Exchange" in line else (above[-1][1] if above else 0) + bool(PYTHON.search(line))
        above.append((depth, steps))
        most = max(most, steps)
    return most


def test_a_stage_of_the_join_runs_one_python_step(spark, sf, monkeypatch):
    seen = []
    real = frames.map_batches

    def noted(df, fn, schema, rows=frames.BATCH_ROWS):
        seen.append(python_steps(out := real(df, fn, schema, rows)))
        return out

    monkeypatch.setattr(frames, "map_batches", noted)
    monkeypatch.setattr(ngram_join, "map_batches", noted)
    ngram_join.first_of_groups(frames.read_table(spark, sf, "documents")).count()
    assert len(seen) > 4 and max(seen) == 1


def test_rows_of_the_driver_need_no_python(spark):
    kind = "sources array<string>, n int, target double"
    for rows in ([(["a"], 1, 2.0), (None, None, None), ([None], 3, 4.0)], [([None], 1, 2.0)], [(None, 1, 2.0)], []):
        got = frames.local_table(spark, rows, kind)
        assert got.dtypes == [("sources", "array<string>"), ("n", "int"), ("target", "double")]
        assert [tuple(r) for r in got.collect()] == rows
        assert "ExistingRDD" not in got._jdf.queryExecution().toString()


def test_rules_and_mix_need_no_python_for_rows_of_the_driver(spark, sf, monkeypatch):
    docs, labels = (frames.read_table(spark, sf, t) for t in ("documents", "labels"))
    rows = quality.F.struct("doc_id", quality.F.col("lang").alias("stratum")).alias("row")
    measures = frames.stored(quality.measured(docs.select(rows, "text")).select("row.*", *quality.MEASURES), "measures")
    seen = [mixing.mix(docs.select("doc_id", quality.F.array("source").alias("sources"), "text"))]
    real = quality.F.broadcast
    monkeypatch.setattr(quality.F, "broadcast", lambda df: seen.append(df) or real(df))
    quality.learn_cutoffs(measures, labels)
    assert len(seen) == 4 and all("ExistingRDD" not in df._jdf.queryExecution().toString() for df in seen)
