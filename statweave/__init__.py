"""Statistical observations on Spark: ingestion, series analytics, comparison and panel models."""
