"""Spark-side helpers shared by the operators: batches of texts, grouped streams, scratch tables, graph components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.session import materialized

BATCH_ROWS = 1000


def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Batches between the JVM and Python hold few rows, as one text may be very long; narrow rows come in larger ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_bytes(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and the text as UTF-8 bytes, so that workers need no decoding."""
    return docs.select(*keep, F.col(text).cast("binary").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema, rows: int = BATCH_ROWS) -> DataFrame:
    batch_rows(df.sparkSession, rows)
    return df.mapInArrow(fn, schema)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The result as a table in the shared folder: later reads neither recompute it nor depend on one executor.

    Spark drops the shuffle files of the step when it is done; nothing reads them again.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return materialized(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of consecutive rows with the same key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_pylist()
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            if held and keys[at] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = keys[at]
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield pa.Table.from_batches(held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components with fewer edges: each node of a batch with the smallest node it reaches in the batch."""
    for batch in batches:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            u, v = find(u), find(v)
            up[max(u, v)] = min(u, v)
        pairs = [(x, find(x)) for x in list(up)]
        pairs = [(x, y) for x, y in pairs if x != y]
        yield pa.record_batch([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node that each node of an undirected graph reaches: columns node, root.

    edges: columns a and b. Nodes hang themselves on ever smaller neighbours, in alternating rounds, until every edge is a
    star around its root. Each round is stored, so that its lineage stays short. A node with very many neighbours is only
    aggregated and joined, never gathered.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # Each task first turns its own edges into stars.
    current = stored(map_batches(down, _stars, "u long, v long", 50_000).distinct(), name)
    fingerprint = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = fingerprint(current)
    while before[0]:
        both = current.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Larger neighbours of u move to the least of u's neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Smaller neighbours of u, and u, move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        current = stored(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        now = fingerprint(current)
        if now == before:  # edges only ever move down, so this is the end
            break
        before = now
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A few rows of the driver as a table.

    They travel as Arrow: for plain rows Spark starts Python workers of a further kind on every executor, and those stay.
    """
    kind = empty_like(spark, schema).schema
    columns = zip(*rows) if rows else [()] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=kind.names), kind)


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
