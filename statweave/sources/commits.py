"""Numbered commit records: a table changes only when a new record appears.

Data files are written first, to places no record names.  The record is written aside
and renamed into place without overwriting, so a reader sees the old or the new state
and a second writer with the same number fails.  Paths go through the Hadoop file
system API and may live on any store the cluster mounts.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SERIES


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def latest(self) -> dict | None:
        fs, folder = self._fs(), self._path()
        if not fs.exists(folder):
            return None
        numbers = [
            int(s.getPath().getName()[:-5])
            for s in fs.listStatus(folder)
            if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith(("_", "."))
        ]
        if not numbers:
            return None
        stream = fs.open(self._path(f"{max(numbers):010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, path, record: dict) -> None:
        out = self._fs().create(path, True)
        try:
            out.write(bytearray(json.dumps(record), "utf-8"))
        finally:
            out.close()

    def note_failure(self, run: str, record: dict) -> None:
        """Keep a trace of a run that published nothing; readers of the table ignore it."""
        self._write(self._path("failed", f"{run}.json"), {**record, "status": "failed", "ingestion_id": run})

    def publish(self, number: int, record: dict) -> None:
        """Make a record current; the rename refuses a number that exists, so one of two writers fails."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        aside, target = self._path(f"_{uuid.uuid4().hex}.tmp"), self._path(f"{number:010d}.json")
        self._write(aside, {**record, "version": number})
        try:
            context.rename(aside, target, options)
        except Py4JJavaError as error:
            self._fs().delete(aside, False)
            raise RuntimeError(f"Version {number} was committed by another writer") from error


class PartTable:
    """Rows in parts, a part being a year and a bucket of the series key; a write adds a version of the parts it touches.

    Which version of a part counts is the caller's ``parts`` map ("year/bucket" -> version), kept in a commit record,
    and so is the number of buckets.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, buckets: int, keys: list[str] = SERIES):
        self.spark, self.root, self.schema, self.buckets, self.keys = spark, root.rstrip("/"), schema, buckets, keys

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def parts_of(self, batch: DataFrame) -> list[str]:
        """Parts that a batch touches: at most one for each calendar year and bucket."""
        found = batch.select(F.year("period").alias("y"), self.bucket().alias("b")).distinct().collect()
        return sorted(f"{r.y}/{r.b}" for r in found)

    def read(self, parts: dict[str, str], wanted: list[str] | None = None) -> DataFrame:
        chosen = [p for p in (parts if wanted is None else wanted) if parts.get(p)]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/version={parts[p]}/partition_year={p.split('/')[0]}/bucket={p.split('/')[1]}" for p in chosen]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def written(self, version: str, touched: list[str]) -> dict[str, str | None]:
        """The map of the touched parts after a write that may have left some of them empty."""
        schema = T.StructType(self.schema.fields + [T.StructField(c, T.IntegerType()) for c in ("partition_year", "bucket")])
        found = self.spark.read.schema(schema).parquet(f"{self.root}/version={version}").select("partition_year", "bucket").distinct()
        full = {f"{r.partition_year}/{r.bucket}" for r in found.collect()}
        return {p: version if p in full else None for p in touched}

    def write(self, rows: DataFrame, version: str) -> None:
        """A rebalance keeps a crowded part in several files of even size."""
        (
            rows.withColumns({"partition_year": F.year("period"), "bucket": self.bucket()})
            .hint("rebalance", "partition_year", "bucket")
            .sortWithinPartitions("partition_year", "bucket", "indicator", "geography", "period")
            .write.partitionBy("partition_year", "bucket")
            .option("compression", "zstd")
            .parquet(f"{self.root}/version={version}")
        )


class KeyedTable:
    """Rows in buckets of a key, for small lookups: a write adds a version of the buckets it touches.

    Which version of a bucket counts is the caller's map (bucket -> version), kept in a commit record like that of parts.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, keys, buckets

    def bucket(self, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*(values or self.keys)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[str]:
        return sorted(str(r.b) for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def bucket_of(self, *values) -> str:
        """The bucket of one key."""
        return str(self.spark.range(1).select(self.bucket(*map(F.lit, values)).alias("b")).first().b)

    def read(self, versions: dict[str, str], wanted: list[str] | None = None) -> DataFrame:
        chosen = [b for b in (versions if wanted is None else wanted) if versions.get(b)]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/version={versions[b]}/bucket={b}" for b in chosen])

    def write(self, rows: DataFrame, version: str) -> None:
        names = self.schema.names
        (
            rows.select(*names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", *self.keys)
            .write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/version={version}")
        )

    def look_up(self, versions: dict[str, str], **key) -> DataFrame:
        """The rows of one key; opens one bucket."""
        rows = self.read(versions, [self.bucket_of(*(key[k] for k in self.keys))])
        for name, value in key.items():
            rows = rows.filter(F.col(name) == F.lit(value))
        return rows

    def merge(self, versions: dict[str, str], rows: DataFrame, version: str, fold) -> dict[str, str]:
        """Fold rows into the buckets they belong to (``fold(old, rows)`` gives their new content); the new map."""
        touched = self.buckets_of(rows)
        if not touched:
            return versions
        self.write(fold(self.read(versions, touched), rows), version)
        schema = T.StructType(self.schema.fields + [T.StructField("bucket", T.IntegerType())])
        found = self.spark.read.schema(schema).parquet(f"{self.root}/version={version}").select("bucket").distinct()
        full = {str(r.bucket) for r in found.collect()}
        return {**versions, **{b: version if b in full else None for b in touched}}


def write_by_year(rows: DataFrame, path: str) -> None:
    """Partition by year; a rebalance keeps a crowded year in several files of even size."""
    (
        rows.withColumn("partition_year", F.year("period"))
        .hint("rebalance", "partition_year")
        .sortWithinPartitions("partition_year", "indicator", "geography", "period")
        .write.partitionBy("partition_year")
        .option("compression", "zstd")
        .parquet(path)
    )


def write_beside(df: DataFrame, root: str, schema: T.StructType) -> str:
    """The whole content of a small table as a new folder below root; a commit record makes it current."""
    data = f"data/{uuid.uuid4().hex}"
    df.select(*[f.name for f in schema.fields]).write.option("compression", "zstd").parquet(f"{root}/{data}")
    return data
