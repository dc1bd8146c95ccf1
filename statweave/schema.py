"""The observation model shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The canonical text columns of a source file, the observation key
# and the accepted publication frequencies.
COLUMNS = ["dataset", "indicator", "geography", "period", "value", "unit", "frequency", "source_url"]
KEY = ["dataset", "indicator", "geography", "period", "unit", "frequency"]
FREQUENCIES = ["daily", "weekly", "monthly", "quarterly", "annual", "census", "irregular"]

# A series is the key without its period.  Because a fact holds one row per key and
# periods are dates, one series can never exceed the number of calendar days in the
# accepted date range (about 213,000), which bounds every per-series window.
SERIES = ["dataset", "indicator", "geography", "unit", "frequency"]
FACT_COLUMNS = COLUMNS + ["dataset_version", "ingestion_id"]

FIRST_PERIOD, LAST_PERIOD = "1677-09-22", "2262-04-11"
EXTREME_VALUE = 1e15

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])

FACT_SCHEMA = T.StructType(
    [
        T.StructField(
            c,
            T.DateType() if c == "period" else T.DoubleType() if c == "value" else T.StringType(),
            True,
        )
        for c in FACT_COLUMNS
    ]
)

REVISION_SCHEMA = T.StructType(
    [T.StructField(c, T.DateType() if c == "period" else T.StringType()) for c in KEY]
    + [
        T.StructField("old_value", T.DoubleType()),
        T.StructField("new_value", T.DoubleType()),
        T.StructField("previous_ingestion_id", T.StringType()),
        T.StructField("ingestion_id", T.StringType()),
        T.StructField("changed_at", T.TimestampType()),
    ]
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("ingestion_id", T.StringType()),
        T.StructField("source_hash", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("dataset_version", T.StringType()),
        T.StructField("completed_at", T.TimestampType()),
    ]
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in (
            "source", "source_url", "retrieval_date", "original_file", "dataset_version",
            "geographic_level", "time_period", "ingestion_status", "license", "ingestion_id",
            "source_hash", "completed_at", "manifest_path",
        )
    ]
    + [
        T.StructField(c, T.LongType())
        for c in (
            "raw_rows", "processed_rows", "rejected_rows", "duplicates", "missing_values",
            "revisions", "inserted_rows", "file_size",
        )
    ]
    + [
        T.StructField("missing_data_percentage", T.DoubleType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("ingestion_duration", T.DoubleType()),
        T.StructField(
            "quality",
            T.StructType(
                [
                    T.StructField("min_value", T.DoubleType()),
                    T.StructField("max_value", T.DoubleType()),
                    T.StructField("extreme_values", T.LongType()),
                ]
            ),
        ),
        T.StructField("silver_path", T.StringType()),
        T.StructField("gold_path", T.StringType()),
    ]
)
