"""A star-schema copy of the fact for other consumers, refreshed by idempotent upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog
from ..operators.coverage import COVERED, changed_coverage
from ..operators.merge import insert_absent, unseen, upsert
from ..operators.validate import require_empty
from ..schema import FACT_COLUMNS, FACT_SCHEMA, KEY
from ..session import materialized
from ..sources.commits import Commits, KeyedTable, PartTable, write_beside

MIRROR_COLUMNS = [c for c in FACT_COLUMNS if c != "ingestion_id"]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_COVERAGE = T.StructType(
    _strings("dataset", "indicator", "geography", "frequency").fields
    + [T.StructField("first_period", T.DateType()), T.StructField("last_period", T.DateType()),
       T.StructField("observations", T.LongType())]
)


_DIMENSIONS = {
    "dim_dataset": _strings("dataset", "source_url", "license", "last_completed_at"),
    "dim_indicator": _strings("indicator", "description"),
    "dim_geography": _strings("geography", "parent", "geographic_level"),
}
BUCKETS = 8


class Mirror:
    """Facts in parts by year and series bucket, dimensions and coverage; one commit record names the current state of all."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, f"{self.root}/commits")
        buckets = self._state().get("buckets", buckets)
        self.facts = PartTable(spark, f"{self.root}/fact_observation", T.StructType([FACT_SCHEMA[c] for c in MIRROR_COLUMNS]), buckets, COVERED)
        self.covered = KeyedTable(spark, f"{self.root}/indicator_coverage", _COVERAGE, COVERED, buckets)

    def _state(self) -> dict:
        return {"version": 0, "parts": {}, "tables": {}, "coverage": {}, "streams": {}, **(self.commits.latest() or {})}

    def fact(self) -> DataFrame:
        return self.facts.read(self._state()["parts"])

    def table(self, name: str) -> DataFrame:
        """``dim_dataset``, ``dim_indicator``, ``dim_geography`` or ``indicator_coverage``."""
        state = self._state()
        return self.covered.read(state["coverage"]) if name == "indicator_coverage" else self._table(state, name)

    def _table(self, state: dict, name: str) -> DataFrame:
        data = state["tables"].get(name)
        schema = _DIMENSIONS[name]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{data}") if data else self.spark.createDataFrame([], schema)

    def _publish(self, state: dict, **changes) -> None:
        """The state with some of its maps extended, as the next commit record."""
        kept = {k: {**state[k], **changes.get(k, {})} for k in ("parts", "tables", "coverage", "streams")}
        self.commits.publish(state["version"] + 1, {**kept, "buckets": self.facts.buckets})

    def _changed(self, state: dict, batch: DataFrame, remove: bool = False) -> dict[str, dict]:
        """Write the parts a batch touches with the batch merged in, or taken out, and the coverage of its series.

        Only touched parts are read, and of their old rows only the keys, to tell new rows from replaced ones.
        """
        touched = self.facts.parts_of(batch)
        if not touched:
            return {}
        version = f"{state['version'] + 1}-{uuid.uuid4().hex[:8]}"
        old = self.facts.read(state["parts"], touched)
        keys = batch.select(*KEY).distinct()
        self.facts.write(unseen(old, keys) if remove else upsert(old, batch.select(*MIRROR_COLUMNS), KEY, MIRROR_COLUMNS), version)
        parts = self.facts.written(version, touched) if remove else dict.fromkeys(touched, version)
        if remove:
            moved = materialized(old.select(*KEY).join(keys, KEY, "left_semi"), "removed-keys")
            nothing, after = moved.limit(0), {**state["parts"], **parts}
            # What one coverage row counts lies in the same bucket of every year.
            near = {p.split("/")[1] for p in touched}
            remaining = self.facts.read(after, [p for p in after if p.split("/")[1] in near])
            fold = lambda held, _: changed_coverage(held, nothing, moved, remaining)
        else:
            moved = materialized(unseen(keys, old), "inserted-keys")
            fold = lambda held, _: changed_coverage(held, moved)
        coverage = self.covered.merge(state["coverage"], moved, version, fold)
        return {"parts": parts, "coverage": coverage}

    def load(self, fact: DataFrame, manifests: DataFrame) -> None:
        """Every source needs a manifest; dimensions, facts and coverage then change together, by one commit."""
        require_empty(catalog.without_provenance(fact, manifests), "No provenance manifest")
        state = self._state()
        sources = catalog.provenance(fact, manifests).select("dataset", "source_url", "license", "last_completed_at")
        places = insert_absent(self._table(state, "dim_geography"), fact, "geography")
        changed = self._changed(state, fact)
        content = {
            "dim_dataset": upsert(self._table(state, "dim_dataset"), sources, ["dataset", "source_url"]),
            "dim_indicator": insert_absent(self._table(state, "dim_indicator"), fact, "indicator"),
            "dim_geography": places.withColumn("geographic_level", F.coalesce("geographic_level", F.lit("national"))),
        }
        tables = {name: write_beside(df, f"{self.root}/{name}", _DIMENSIONS[name]) for name, df in content.items()}
        self._publish(state, tables=tables, **changed)

    def upsert_facts(self, batch: DataFrame, streams: dict | None = None) -> None:
        """Value, URL and version follow the batch, coverage with them; replaying a batch changes nothing.

        streams: how far streams are merged, stored by the same commit.
        """
        state = self._state()
        changed = self._changed(state, batch)
        if changed or streams:
            self._publish(state, **changed, streams=streams or {})

    def remove_facts(self, keys: DataFrame) -> None:
        """Facts of these keys leave the mirror, and what they covered with them."""
        state = self._state()
        changed = self._changed(state, keys, remove=True)
        if changed:
            self._publish(state, **changed)

    def stream_state(self, stream: str) -> int:
        """The last micro-batch of a stream that a commit merged; -1 before the first."""
        return self._state()["streams"].get(stream, -1)
