"""Choosing, searching, ordering and paging observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import range_predicate
from ..schema import KEY
from .ranking import positions_by
from .series import transform

# Keyword topics; each term is matched inside dataset or indicator names.
TOPICS = {
    "trade": ("trade", "export", "import"),
    "population": ("population", "census"),
    "agriculture": ("agriculture", "crop", "yield"),
    "labour": ("labour", "employment", "unemployment"),
    "energy": ("energy", "electricity", "generation"),
    "health": ("worldbank_health",),
    "education": ("worldbank_education",),
    "environment": ("worldbank_environment",),
    "digital": ("worldbank_digital",),
}

# Publisher -> dataset prefix.
PUBLISHERS = {"pbs": "pbs_", "worldbank": "worldbank_"}


def series_of(
    fact: DataFrame,
    indicator: str,
    geography: str,
    dataset: str | None = None,
    frequency: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Equality and range filters only, all pushed to the scan; arguments are literals, never SQL."""
    chosen = fact.filter((F.col("indicator") == F.lit(indicator)) & (F.col("geography") == F.lit(geography)))
    for column, wanted in (("dataset", dataset), ("frequency", frequency)):
        if wanted is not None:
            chosen = chosen.filter(F.col(column) == F.lit(wanted))
    return chosen.filter(range_predicate(F.col("period"), start, end))


def series_of_dataset(fact: DataFrame, dataset: str, indicator: str, period: str) -> DataFrame:
    """All geographies of one dataset and indicator in a (partial) period."""
    return fact.filter(
        (F.col("dataset") == F.lit(dataset))
        & (F.col("indicator") == F.lit(indicator))
        & range_predicate(F.col("period"), period, period)
    )


def timeseries(
    fact: DataFrame,
    indicator: str,
    geography: str,
    *,
    how: str = "raw",
    window: int = 3,
    limit: int | None = 500,
    offset: int = 0,
    **filters,
) -> DataFrame:
    """Selection, transform, then page: page borders never reset a window."""
    rows = transform(series_of(fact, indicator, geography, **filters), how, window)
    return page(rows, ["dataset", "frequency", "period", "unit"], limit, offset)


def page(df: DataFrame, order: list[str | Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Ordered slice.

    With a limit Spark keeps only offset+limit rows per task.  Without one, rows are
    numbered across range partitions, so that no task holds all that is left.
    """
    if limit is not None:
        ordered = df.orderBy(*order)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    if not offset:
        return df.orderBy(*order)
    numbered = positions_by(df, [], [F.col(c) if isinstance(c, str) else c for c in order])
    return numbered.filter(F.col("position") > offset).drop("position").orderBy(*order)


def page_after(df: DataFrame, keys: list[str], after: dict | None, limit: int) -> DataFrame:
    """The next rows behind a given key, in ascending order: a deep page costs no more than the first."""
    if after:
        beyond = F.lit(False)
        for i, k in enumerate(keys):
            same = reduce(lambda a, b: a & b, [F.col(c) == F.lit(after[c]) for c in keys[:i]], F.lit(True))
            beyond = beyond | (same & (F.col(k) > F.lit(after[k])))
        df = df.filter(beyond)
    return df.orderBy(*keys).limit(limit)


def timeseries_page(fact: DataFrame, indicator: str, geography: str, *, how: str = "raw", limit: int = 500, offset: int = 0, **options) -> dict:
    """A page of ``timeseries`` with what describes it: the number of all rows, the page borders and the transform."""
    rows = timeseries(fact, indicator, geography, how=how, limit=None, **options)
    total = rows.count()
    return {
        "status": "available" if total else "unavailable", "total": total, "limit": limit, "offset": offset, "transform": how,
        "rows": timeseries(fact, indicator, geography, how=how, limit=limit, offset=offset, **options),
    }


def sorted_by(df: DataFrame, column: str, descending: bool = False, tie_break: list[str] = KEY) -> DataFrame:
    """User-chosen order with the key as tie break."""
    lead = F.desc(column) if descending else F.asc(column)
    return df.orderBy(lead, *[c for c in tie_break if c != column and c in df.columns])


def availability(df: DataFrame) -> str:
    """Whether any observation supports a request; an empty result is never filled in."""
    return "unavailable" if df.isEmpty() else "available"


def snapshot(df: DataFrame) -> DataFrame:
    """Everything a workspace shows, in the order of its key; of any size."""
    return df.orderBy(*KEY)


def topic_predicate(topic: str, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """LIKE semantics: ``_`` in a term matches any character."""
    terms = [f"%{term}%" for term in topics[topic]]
    tests = [F.lower(F.col(c)).like(term) for term in terms for c in ("dataset", "indicator")]
    return reduce(lambda a, b: a | b, tests)


def recent_first(fact: DataFrame, topic: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    rows = fact.filter(topic_predicate(topic)) if topic else fact
    return page(rows, [F.desc("period"), *[k for k in KEY if k != "period"]], limit, offset)


def report_rows(fact: DataFrame, first_year: int, last_year: int, publisher: str = "all",
                prefixes: dict[str, str] = PUBLISHERS) -> DataFrame:
    """Year range and publisher (by dataset prefix)."""
    rows = fact.filter(
        range_predicate(F.col("period"), f"{first_year:04d}", f"{last_year:04d}")
    )
    return rows if publisher == "all" else rows.filter(F.col("dataset").startswith(prefixes[publisher]))


def subject_rows(
    rows: DataFrame,
    dictionary: DataFrame,
    subject: str,
    geography: str,
    extra: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Rows of a page of the report: the overview (national), one geography, or a subject.

    ``geography`` is the national name for ``overview`` and the chosen one for
    ``geographies``; ``extra`` adds single indicators to a subject.
    """
    if subject in ("overview", "geographies"):
        return rows.filter(F.col("geography") == F.lit(geography))
    wanted = dictionary.filter(F.col("domain") == F.lit(subject)).select("indicator", F.lit(True).alias("_wanted")).distinct()
    # An extra indicator counts by its own name, whether or not the dictionary knows it.
    added = F.col("indicator").isin((extra or {}).get(subject, []))
    return rows.join(wanted, "indicator", "left").filter(F.col("_wanted").isNotNull() | added).drop("_wanted")


def search(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring anywhere in the record's JSON form."""
    if not text:
        return df
    return df.filter(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.lower())))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)
