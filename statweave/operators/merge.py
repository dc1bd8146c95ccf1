"""Comparing a batch with the fact and folding it in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FACT_COLUMNS, KEY


def unseen(batch: DataFrame, seen: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows whose key is not in ``seen``."""
    return batch.join(seen.select(*keys), keys, "left_anti")


def revisions(batch: DataFrame, fact: DataFrame) -> DataFrame:
    """Batch rows that change the value of an existing key, with old and new value.

    Both sides hold one row per key, so the join cannot fan out or skew.
    """
    old = fact.select(
        *KEY, F.col("value").alias("old_value"), F.col("ingestion_id").alias("previous_ingestion_id")
    )
    return (
        batch.join(old, KEY, "inner")
        .filter(F.col("value") != F.col("old_value"))
        .select(*KEY, "old_value", F.col("value").alias("new_value"), "previous_ingestion_id", "ingestion_id")
    )


def upsert(fact: DataFrame, batch: DataFrame, keys: list[str] = KEY, columns: list[str] | None = None) -> DataFrame:
    """Replace on key, insert otherwise; one shuffle of each side."""
    columns = columns or fact.columns
    return unseen(fact, batch, keys).select(*columns).unionByName(batch.select(*columns))


def audited_upsert(fact: DataFrame, batch: DataFrame) -> DataFrame:
    """The merged fact with what each row replaced.

    A single full outer join yields the new fact, the revision records and the
    insert/replace counters together: ``change`` is ``kept``, ``inserted``,
    ``revised`` or ``refreshed`` (same value, new version).
    """
    payload = [c for c in FACT_COLUMNS if c not in KEY]
    old = fact.select(*KEY, F.struct(*payload).alias("old"))
    new = batch.select(*KEY, F.struct(*payload).alias("new"))
    change = (
        F.when(F.col("new").isNull(), "kept")
        .when(F.col("old").isNull(), "inserted")
        .when(F.col("new.value") != F.col("old.value"), "revised")
        .otherwise("refreshed")
    )
    return old.join(new, KEY, "full_outer").select(
        *KEY,
        *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in payload],
        change.alias("change"),
        F.when(F.col("new").isNotNull(), F.col("old.value")).alias("prior_value"),
        F.when(F.col("new").isNotNull(), F.col("old.ingestion_id")).alias("prior_ingestion_id"),
    )


def merge_dictionary(old: DataFrame, new: DataFrame, key: str = "indicator") -> DataFrame:
    """New entries replace old entries as a whole."""
    return upsert(old, new, [key], old.columns)


def insert_absent(dimension: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Add members a dimension lacks; existing members keep their attributes."""
    fresh = unseen(values.select(key).distinct(), dimension, [key])
    return dimension.unionByName(fresh, allowMissingColumns=True)
