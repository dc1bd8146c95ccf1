"""Publications, provenance and the indicator dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import indicator_title, publication_title


def latest_publications(manifests: DataFrame) -> DataFrame:
    """Newest run of each publication; among equal times the first manifest file wins."""
    columns = [c for c in manifests.columns if c != "source_url"]
    newest = manifests.groupBy("source_url").agg(F.max(F.coalesce("completed_at", F.lit(""))).alias("_newest"))
    return (
        manifests.join(newest, "source_url")
        .filter(F.coalesce("completed_at", F.lit("")) == F.col("_newest"))
        .groupBy("source_url")
        .agg(F.min_by(F.struct(*columns), "manifest_path").alias("run"))
        .select("source_url", "run.*")
        .withColumn("title", publication_title(F.col("source"), F.col("original_file")))
    )


def catalog_totals(publications: DataFrame) -> DataFrame:
    return publications.agg(
        F.count("*").alias("publications"),
        F.coalesce(F.sum("processed_rows"), F.lit(0)).alias("accepted_rows"),
        F.count_distinct("source").alias("publishers"),
    )


def quality_totals(manifests: DataFrame) -> DataFrame:
    """Acceptance over all runs; duplicates do not count as loss here."""
    raw, rejected = F.coalesce(F.sum("raw_rows"), F.lit(0)), F.coalesce(F.sum("rejected_rows"), F.lit(0))
    return manifests.agg(
        raw.alias("raw_rows"),
        rejected.alias("rejected_rows"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("missing_values"), F.lit(0)).alias("missing_values"),
    ).withColumn(
        "acceptance_rate",
        F.when(
            F.col("raw_rows") > 0,
            (F.col("raw_rows") - F.col("rejected_rows")) / F.col("raw_rows") * F.lit(100.0),
        ),
    )


def provenance(fact: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifests behind each (dataset, source_url), as counts and the newest license."""
    sources = fact.select("dataset", "source_url").distinct()
    runs = manifests.groupBy("source_url").agg(
        F.count("*").alias("runs"),
        F.max_by("license", F.struct("completed_at", "manifest_path")).alias("license"),
        F.max("completed_at").alias("last_completed_at"),
    )
    return sources.join(runs, "source_url", "left")


def without_provenance(fact: DataFrame, manifests: DataFrame) -> DataFrame:
    return fact.select("dataset", "source_url").distinct().join(
        manifests.select("source_url"), "source_url", "left_anti"
    )


def build_dictionary(
    config: DataFrame, definitions: DataFrame, domain_override: dict[str, str] | None = None
) -> DataFrame:
    """Configured indicators with the publisher's definition; see ``undefined_codes`` for the check."""
    domain = F.col("domain")
    for indicator, name in (domain_override or {}).items():
        domain = F.when(F.col("indicator") == F.lit(indicator), F.lit(name)).otherwise(domain)
    return config.join(definitions, "code").withColumn("domain", domain)


def undefined_codes(config: DataFrame, definitions: DataFrame) -> DataFrame:
    return config.join(definitions.select("code"), "code", "left_anti")


def with_dictionary(fact: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Observations with title and domain, by the dictionary's measured size (no forced broadcast)."""
    return fact.join(dictionary.select("indicator", "title", "domain"), "indicator", "left")


def indicator_metadata(fact: DataFrame, dictionary: DataFrame, publisher: str) -> DataFrame:
    """Title and domain of every published indicator, with defaults where the dictionary is silent.

    An indicator without an entry takes unit and URL of its first observation.
    """
    seen = fact.groupBy("indicator").agg(
        F.min_by(F.struct("unit", "source_url", "dataset"), F.struct("period", "geography", "dataset", "unit")).alias("o")
    )
    price_index = F.col("indicator").startswith("cpi_") | (F.col("indicator") == "wpi")
    known = dictionary.select(
        "indicator", F.col("title").alias("_title"), F.col("domain").alias("_domain"), F.lit(True).alias("_known")
    )
    return seen.join(known, "indicator", "left").select(
        "indicator",
        F.coalesce("_title", indicator_title(F.col("indicator"))).alias("title"),
        F.coalesce("_domain", F.when(price_index, "inflation").otherwise("population")).alias("domain"),
        F.when(F.col("_known").isNull(), F.lit(publisher)).alias("default_source"),
        F.col("o.unit").alias("unit"),
        F.col("o.source_url").alias("source_url"),
        F.coalesce("_known", F.lit(False)).alias("in_dictionary"),
    )
