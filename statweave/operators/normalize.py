"""Reviewed renaming of geographies and conversion of units."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import finite_number, strip


def rename_geographies(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Whole-value aliases (``alias``, ``name``); unmatched names stay as they are.

    The alias table joins by its measured size: broadcast when small, shuffled beyond.
    """
    return (
        df.withColumn("geography", strip(F.col("geography")))
        .join(aliases.select(F.col("alias").alias("geography"), F.col("name").alias("_name")), "geography", "left")
        .withColumn("geography", F.coalesce("_name", "geography"))
        .drop("_name")
        .select(*df.columns)
    )


def fold_units(units: dict[str, tuple[str, float]]) -> dict[str, tuple[str, float]]:
    """The net effect of applying each conversion once, in the given order.

    Chained entries compound: a unit renamed by an earlier entry is converted again
    by a later entry for its new name.
    """
    for old, (_, factor) in units.items():
        if not math.isfinite(factor) or factor <= 0:
            raise ValueError(f"Unit factor of {old!r} must be finite and positive")
    net = {}
    for start in units:
        unit, factor = start, 1.0
        for old, (new, step) in units.items():
            if unit == old:
                unit, factor = new, factor * step
        net[start] = (unit, factor)
    return net


def convert_units(df: DataFrame, units: dict[str, tuple[str, float]]) -> DataFrame:
    """Multiply values into canonical units; the conversion list is a short reviewed literal."""
    if not units:
        return df
    net = fold_units(units)
    value, unit = F.col("value"), F.col("unit")
    new_value, new_unit = None, None
    for old, (name, factor) in net.items():
        matched = unit == old
        new_value = F.when(matched, value * F.lit(factor)) if new_value is None else new_value.when(matched, value * F.lit(factor))
        new_unit = F.when(matched, F.lit(name)) if new_unit is None else new_unit.when(matched, F.lit(name))
    return df.withColumns({"value": new_value.otherwise(value), "unit": new_unit.otherwise(unit)})


def normalized(df: DataFrame, aliases: DataFrame | None = None, units: dict | None = None) -> DataFrame:
    """Text observations -> trimmed geography, numeric value, canonical unit."""
    out = df.withColumns(
        {"geography": strip(F.col("geography")), "value": finite_number(strip(F.col("value").cast("string")))}
    )
    if aliases is not None:
        out = rename_geographies(out, aliases)
    return convert_units(out, units or {})
