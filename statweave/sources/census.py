"""Wide census workbooks (already read as rows of cells) to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import census_dataset, collapse_upper, title_case
from ..operators.reconcile import census_long, duplicate_keys, parts_violations
from ..operators.validate import ContractError, require_empty

# Cell -> (indicator, unit) of the population table; the previous census sits in cell 10.
FIELDS = {
    "c2": ("population", "persons"),
    "c3": ("population_male", "persons"),
    "c4": ("population_female", "persons"),
    "c5": ("population_transgender", "persons"),
    "c7": ("population_density", "persons_per_sq_km"),
    "c8": ("urban_population_share", "percent"),
    "c9": ("household_size", "persons_per_household"),
    "c11": ("population_growth_annual", "percent"),
}
PRIOR_CELL, PRIOR_FIELD = "c10", ("population", "persons")

# Published names of the nation and its provinces.
PROVINCES = {
    "PAKISTAN": "Pakistan",
    "KHYBER PAKHTUNKHWA": "Khyber Pakhtunkhwa",
    "PUNJAB": "Punjab",
    "SINDH": "Sindh",
    "BALOCHISTAN": "Balochistan",
    "ISLAMABAD": "Islamabad",
    "ISLAMABAD CAPITAL TERRITORY": "Islamabad",
}


def geography_of(label: Column, national: bool, provinces: dict[str, str] = PROVINCES) -> Column:
    """Geography of a row label; null for rows of another level.

    National tables list the nation and its provinces; other tables mark districts
    with a `` DISTRICT`` suffix.
    """
    name = collapse_upper(label)
    if national:
        entries = [F.lit(x) for pair in provinces.items() for x in pair]
        return F.try_element_at(F.create_map(*entries), name)
    return F.when(name.endswith(" DISTRICT"), title_case(F.regexp_replace(name, " DISTRICT$", "")))


def census_rows(cells: DataFrame, national: bool, year: int = 2023, prior_year: int = 2017, **options) -> DataFrame:
    """Checked observations of one workbook; ``cells`` holds ``c0`` .. ``c11``."""
    rows = cells.withColumn("geography", geography_of(F.col("c0"), national, **options)).filter("geography IS NOT NULL")
    require_empty(parts_violations(rows, ["c3", "c4", "c5"], "c2", ["c8"]), "Sex components or urban share")
    out = census_long(
        rows, ["geography"], FIELDS, F.make_date(F.lit(year), F.lit(1), F.lit(1)),
        PRIOR_CELL, PRIOR_FIELD, F.make_date(F.lit(prior_year), F.lit(1), F.lit(1)),
    )
    require_empty(duplicate_keys(out, ["indicator", "geography", "period"]), "Duplicate geography/indicator/year")
    return out


# What the first two rows of the population table say, by row and cell.
HEADER = {(0, "c0"): "CENSUS-2023", (1, "c2"): "POPULATION"}


def require_header(cells: DataFrame, header: dict[tuple[int, str], str] = HEADER) -> None:
    """Fail when a workbook's columns may have moved; ``cells`` has the row number in ``r``."""
    found = {row.r: row for row in cells.filter(F.col("r").isin(sorted({r for r, _ in header}))).collect()}
    wrong = [f"row {r} {c}" for (r, c), text in header.items() if r not in found or text not in str(found[r][c] or "")]
    if wrong:
        raise ContractError(f"The table's header differs at {wrong}; its columns need a review.")


def census_observations(cells: DataFrame, file_name: str, source_url: str, **options) -> DataFrame:
    """Canonical observations of one workbook; ``cells`` holds the row number ``r`` and ``c0`` .. ``c11``."""
    require_header(cells)
    numbers = cells.withColumns({f"c{i}": F.col(f"c{i}").try_cast("double") for i in range(2, 12)})
    rows = census_rows(numbers, file_name.rsplit("/", 1)[-1] == "table_1_national.xlsx", **options)
    if rows.isEmpty():
        raise ContractError(f"{file_name} names no known geography.")
    return rows.select(
        census_dataset(F.lit(file_name)).alias("dataset"), "indicator", "geography", "period", "value", "unit",
        F.lit("annual").alias("frequency"), F.lit(source_url).alias("source_url"),
    )
