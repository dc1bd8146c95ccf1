"""Saved model reports with their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SERIES

_NUMBERS = "mae double, rmse double, mape_percent double, mape_eligible_rows bigint"
# Given, not inferred: a field that no record carries is a null column.
REPORT = f"""dataset string, indicator string, geography string, unit string, frequency string, observations bigint, status string, reason string,
  selected_model string, training_rows int, holdout_rows int, holdout_start date,
  metrics array<struct<model:string,metrics:struct<{_NUMBERS}>, cv_one_step_mae double, parameter double>>,
  forecast array<struct<period date, value double>>, limitations array<string>,
  provenance struct<period_start date, period_end date, observations bigint, source_urls array<string>>, generated_at string"""


def blocked(reason: str) -> dict:
    """The report of a model that its data do not allow; ``reason`` is a code."""
    return {"status": "blocked", "reason": reason}


def provenance(fact: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Span, size and sources of each modelled series."""
    return fact.groupBy(*keys).agg(
        F.min("period").alias("period_start"),
        F.max("period").alias("period_end"),
        F.count("*").alias("observations"),
        F.array_sort(F.collect_set("source_url")).alias("source_urls"),
    )


def save(reports: DataFrame, fact: DataFrame, path: str, task: str, keys: list[str] = SERIES) -> None:
    """One JSON record per series, report and provenance together."""
    source = provenance(fact, keys).select(
        *keys, F.struct("period_start", "period_end", "observations", "source_urls").alias("provenance")
    )
    reports.join(source, keys, "left").withColumns(
        {"task": F.lit(task), "generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")}
    ).write.partitionBy("task").mode("append").json(path)


def listing(spark: SparkSession, path: str, task: str) -> DataFrame:
    """Saved reports of one task."""
    return spark.read.schema(REPORT).json(f"{path}/task={task}")
