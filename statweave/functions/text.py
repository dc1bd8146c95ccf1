"""Names, titles and unit labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display text of known units.
UNIT_LABELS = {
    "current_usd": "Current US dollars",
    "current_usd_per_person": "US dollars per person",
    "persons": "People",
    "percent": "Percent",
    "percent_gdp": "% of GDP",
    "tonnes": "Tonnes",
    "kg_per_hectare": "kg per hectare",
    "years": "Years",
    "index_2015_16_100": "Index · 2015–16 = 100",
    "percent_population": "% of population",
    "percent_land_area": "% of land area",
    "pkr_per_usd": "PKR per US dollar",
}

# Unit -> (divisor, display unit).
DISPLAY_SCALE = {
    "current_usd": (1e9, "US$ bn"),
    "persons": (1e6, "Million people"),
    "tonnes": (1e6, "Million tonnes"),
}


def collapse_upper(c: Column) -> Column:
    """Inner whitespace runs to one blank, edges trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def title_case(c: Column) -> Column:
    """A capital after every non-letter, lower case elsewhere (``D.I. KHAN`` -> ``D.I. Khan``)."""
    words = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(words, F.initcap), "")


def indicator_title(c: Column) -> Column:
    """Fallback title of an indicator code."""
    return title_case(F.translate(c, "_", " "))


def lookup(c: Column, mapping: dict[str, object], default: Column) -> Column:
    """A small fixed mapping as a literal map, with a fallback."""
    entries = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(kv[1])], mapping.items(), [])
    return F.coalesce(F.try_element_at(F.create_map(*entries), c), default)


def unit_label(unit: Column) -> Column:
    return lookup(unit, UNIT_LABELS, F.translate(unit, "_", " "))


def display_divisor(unit: Column) -> Column:
    return lookup(unit, {u: d for u, (d, _) in DISPLAY_SCALE.items()}, F.lit(1.0))


def display_unit(unit: Column) -> Column:
    return lookup(unit, {u: name for u, (_, name) in DISPLAY_SCALE.items()}, unit_label(unit))


def file_stem(path: Column) -> Column:
    """Last path part without its extension; a leading dot is not an extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def census_dataset(file_name: Column) -> Column:
    """Dataset id of a census workbook from its file name."""
    name = F.element_at(F.split(file_name, "/"), -1)
    region = F.regexp_replace(F.regexp_replace(name, r"^table_1_", ""), r"_districts\.xlsx$", "")
    return (
        F.when(name == "table_1_national.xlsx", F.lit("pbs_census_2023_national"))
        .when(name.contains("islamabad"), F.lit("pbs_census_2023_islamabad_districts"))
        .when(region == "kp", F.lit("pbs_census_2023_kp"))
        .otherwise(F.concat(F.lit("pbs_census_2023_"), region, F.lit("_districts")))
    )


def publication_title(source: Column, original_file: Column) -> Column:
    """Catalogue title of a publication from its publisher and file."""
    stem = file_stem(original_file)
    table = F.translate(F.regexp_replace(stem, "^table_1_", ""), "_", " ")
    return (
        F.when(source.startswith("World Bank"), F.concat(F.lit("World Development Indicators · "), title_case(stem)))
        .when(stem.startswith("table_1_"), F.concat(F.lit("Census 2023 · "), title_case(table)))
        .otherwise(F.lit("Monthly consumer and wholesale price indices"))
    )


def csv_field(c: Column) -> Column:
    """One quoted CSV field: quotes doubled, null as empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in columns])
