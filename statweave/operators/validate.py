"""Typing and validating raw text observations."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import finite_number, iso_date, strip
from ..schema import COLUMNS, EXTREME_VALUE, FREQUENCIES, KEY

_REQUIRED_TEXT = ["dataset", "indicator", "geography", "unit", "frequency"]


class ContractError(ValueError):
    """A source broke an explicit contract; nothing of it may be loaded."""


def require_columns(df: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ContractError(f"Missing canonical columns: {absent}")
    return df


def require_empty(violations: DataFrame, message: str) -> None:
    """Fail when a violations frame has any row; reads at most a few of them."""
    sample = violations.limit(5).collect()
    if sample:
        raise ContractError(f"{message}: {[row.asDict() for row in sample]}")


def strip_fields(raw: DataFrame) -> DataFrame:
    """Canonical columns without edge whitespace; null cells read as blank."""
    require_columns(raw)
    extra = [c for c in raw.columns if c not in COLUMNS]
    return raw.select(*[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS], *extra)


def blank_cells() -> Column:
    """Blank canonical cells of a stripped row, before any typing."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c) == "", 1).otherwise(0) for c in COLUMNS])


def _tests(source_url: str) -> dict[str, Column]:
    """Reasons to reject a typed row; none of them can be null."""
    return {
        **{f"blank_{c}": F.col(c) == "" for c in _REQUIRED_TEXT},
        "bad_period": F.col("period").isNull(),
        "bad_value": F.col("value").isNull(),
        "other_source": F.col("source_url") != F.lit(source_url),
        "unknown_frequency": (F.col("frequency") != "") & ~F.col("frequency").isin(FREQUENCIES),
    }


def typed(raw: DataFrame, source_url: str) -> DataFrame:
    """Stripped text -> typed columns plus ``blanks``, ``valid`` and ``reasons``.

    Narrow projections: no shuffle, no Python.  ``reasons``, and ``text``, the cells as
    they came, are only computed where a query reads them.
    """
    text = F.struct(*COLUMNS).alias("text")
    stripped = strip_fields(raw.withColumn("text", text)).withColumn("blanks", blank_cells())
    parsed = stripped.withColumns(
        {"period": iso_date(F.col("period")), "value": finite_number(F.col("value"))}
    )
    tests = _tests(source_url)
    failed = reduce(lambda a, b: a | b, tests.values())
    # Names without spaces, so joining and splitting keeps them; only rows that fail pay for it.
    reasons = F.split(F.concat_ws(" ", *[F.when(test, F.lit(name)) for name, test in tests.items()]), " ")
    return parsed.withColumns(
        {"valid": ~failed, "reasons": F.when(failed, reasons).otherwise(F.array().cast("array<string>"))}
    )


def valid_rows(typed_rows: DataFrame) -> DataFrame:
    """The rows that pass validation.

    A plain filter would be pushed below the parsing and repeat it inside the
    condition; emitting zero or one row after the parsing evaluates it once.
    """
    row = F.struct(*[F.col(c) for c in typed_rows.columns if c not in ("valid", "reasons", "text")])
    return typed_rows.select(F.explode(F.when(F.col("valid"), F.array(row))).alias("r")).select("r.*")


def reject_reasons(typed_rows: DataFrame) -> DataFrame:
    """How often each reason kept a row out; a row can carry several.

    A plain explode would make the optimizer test for reasons below the parsing, so that every cell is parsed again.
    """
    return (
        typed_rows.select(F.explode_outer("reasons").alias("reason"))
        .filter("reason IS NOT NULL")
        .groupBy("reason")
        .agg(F.count("*").alias("rejected_rows"))
    )


REJECTED = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS] + [T.StructField("reasons", T.ArrayType(T.StringType()))])


def rejected_rows(typed_rows: DataFrame) -> DataFrame:
    """Every row that fails, as the text it was, with all its reasons."""
    failed = F.when(~F.col("valid"), F.array(F.struct("text", "reasons")))
    return typed_rows.select(F.explode(failed).alias("r")).select("r.text.*", "r.reasons")


def outcomes(typed_rows: DataFrame, sequence: list[str]) -> DataFrame:
    """Every row once: typed where it is accepted, as the text it was with its reasons where not.

    Written once, this is all that later steps need, so a source is parsed a single time.
    """
    valid, order = F.col("valid"), F.struct(*sequence)
    return typed_rows.select(
        F.when(valid, "accepted").otherwise("rejected").alias("outcome"),
        *[F.when(valid, F.col(c)).alias(c) for c in [*KEY, "value", "source_url"]],
        order.alias("seq"), "blanks",
        F.when(~valid, F.col("text")).alias("text"), F.when(~valid, F.col("reasons")).alias("reasons"),
    )


def staged_outcomes(rows: DataFrame) -> DataFrame:
    """``staged`` from written outcomes."""
    return staged(rows.withColumn("valid", F.col("outcome") == "accepted"), ["seq"])


def rejected_outcomes(rows: DataFrame) -> DataFrame:
    """``rejected_rows`` from written outcomes; reads only the rejected ones."""
    return rows.filter("outcome = 'rejected'").select("text.*", "reasons")


def keep_first(rows: DataFrame, sequence: list[str], keys: list[str] = KEY) -> DataFrame:
    """One row per key: the earliest by ``sequence``.

    ``min_by`` combines on the map side, so a key that holds a large part of all
    rows shrinks to one row per task before the shuffle (a window would send the
    whole key to one task).  ``copies`` counts the rows the key had.
    """
    order = F.struct(*sequence)
    payload = [c for c in rows.columns if c not in keys and c not in sequence]
    picked = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), order).alias("first"), F.count("*").alias("copies")
    )
    return picked.select(*keys, *[F.col(f"first.{c}").alias(c) for c in payload], "copies")


def staged(typed_rows: DataFrame, sequence: list[str]) -> DataFrame:
    """Accepted keys and the rejected rest of a batch in a single aggregation.

    ``outcome`` is ``accepted`` (one row per key, first occurrence wins) or
    ``rejected`` (one row for all).  ``copies`` and ``blanks`` carry the counters, so
    every ingestion count is a sum over this small result and the raw text is read
    once.  Rejected rows share the null key; the outcome is an aggregate, not a
    grouping column, so a later filter on it cannot repeat the parsing below.

    Texts are aggregated by sorting. The hash of the key is sorted first: a number tells
    almost all keys apart, where key columns alike in most rows were compared one by one.
    """
    keyed = [F.when(F.col("valid"), F.col(k)).alias(k) for k in KEY]
    order = F.struct(*sequence)
    return (
        typed_rows.select(*keyed, "valid", "value", "source_url", order.alias("seq"), "blanks")
        .withColumn("_hash", F.xxhash64(*KEY))
        .groupBy("_hash", *KEY)
        .agg(
            F.min(F.struct("seq", "value", "source_url")).alias("first"),
            F.bool_or("valid").alias("_valid"),
            F.count("*").alias("copies"),
            F.sum("blanks").alias("blanks"),
        )
        .select(
            F.when(F.col("_valid"), "accepted").otherwise("rejected").alias("outcome"),
            *KEY,
            F.when(F.col("_valid"), F.col("first.value")).alias("value"),
            F.when(F.col("_valid"), F.col("first.source_url")).alias("source_url"),
            "copies", "blanks", F.col("first.seq").alias("seq"),
        )
    )


def counters() -> list[Column]:
    """Counters and value quality of a staged batch as aggregates; raw = processed + rejected + duplicates."""
    accepted = F.col("outcome") == "accepted"
    value = F.when(accepted, F.col("value"))
    return [
        F.coalesce(F.sum("copies"), F.lit(0)).alias("raw_rows"),
        F.count_if(accepted).alias("processed_rows"),
        F.coalesce(F.sum(F.when(~accepted, F.col("copies"))), F.lit(0)).alias("rejected_rows"),
        F.coalesce(F.sum(F.when(accepted, F.col("copies") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("blanks"), F.lit(0)).alias("missing_values"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.count_if(F.abs(value) > EXTREME_VALUE).alias("extreme_values"),
    ]


def ingestion_counts(staged_rows: DataFrame) -> DataFrame:
    """``counters`` and the percentages that follow from them."""
    return (
        staged_rows.agg(*counters())
        .withColumn("quality_score", _percent(F.col("processed_rows"), F.col("raw_rows"), 2))
        .withColumn(
            "missing_data_percentage", _percent(F.col("missing_values"), F.col("raw_rows") * len(COLUMNS), 4)
        )
    )


def with_percentages(counts: dict) -> dict:
    """The same from counters that were observed while a batch was written."""

    def percent(part: int, whole: int, digits: int) -> float:
        exact = Decimal(str(100.0 * part / whole)) if whole else Decimal(0)
        return float(exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))

    return {
        **counts,
        "quality_score": percent(counts["processed_rows"], counts["raw_rows"], 2),
        "missing_data_percentage": percent(counts["missing_values"], counts["raw_rows"] * len(COLUMNS), 4),
    }


def _percent(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))
