"""Chunked ingestion as a file stream whose result does not depend on the chunks."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate as V
from ..plans.mirror import MIRROR_COLUMNS, Mirror
from ..plans.warehouse import Metadata, Warehouse
from ..schema import FACT_SCHEMA, KEY
from ..sources.files import read_csv


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The files of a folder as a stream of paths; no content is read here."""
    listing = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return listing.option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path")


def stage_stream(paths: DataFrame, source_url: str, folder: str):
    """Stage the canonical CSV files of every micro-batch under its batch id, so a replay overwrites itself.

    Files are read like a batch source, quoted line breaks and further columns included.
    A micro-batch is reduced to first occurrences on its own; what repeats between them
    is settled once, by ``settle``, instead of looking up all earlier ones in each.
    """
    spark = paths.sparkSession

    def stage(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r.path for r in batch.collect())  # at most maxFilesPerTrigger
        if files:
            parsed, path = V.outcomes(V.typed(read_csv(spark, files), source_url), ["seq"]), f"{folder}/parsed/batch={batch_id}"
            parsed.write.mode("overwrite").partitionBy("outcome").parquet(path)
            stored = spark.read.schema(parsed.schema).parquet(path)
            V.staged_outcomes(stored).write.mode("overwrite").parquet(f"{folder}/staged/batch={batch_id}")

    return (
        paths.writeStream.foreachBatch(stage)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def settle(staged: DataFrame) -> DataFrame:
    """One staged batch from many: the earliest row of the source wins, counters add up.

    The order is that of files and rows, not of batches, so neither the chunk size nor
    the arrival of files changes the result.
    """
    return (
        staged.groupBy("outcome", *KEY)
        .agg(
            F.min_by(F.struct("value", "source_url"), "seq").alias("p"),
            F.sum("copies").alias("copies"),
            F.sum("blanks").alias("blanks"),
        )
        .select("outcome", *KEY, "p.value", "p.source_url", "copies", "blanks", F.lit(0).alias("seq"))
    )


def stream_folder(root: str, *source: str) -> str:
    """Where a stream keeps its checkpoint and staged batches: one place per source, so a later call goes on from there."""
    return f"{root}/streams/{hashlib.sha256(chr(0).join(source).encode()).hexdigest()[:32]}"


def ingest_stream(
    warehouse: Warehouse, folder: str, metadata: Metadata, source_hash: str, files_per_trigger: int = 1
) -> dict:
    """Run the stream over the files that have come since the last call and merge its result as a single commit.

    The commit records the last micro-batch it merged: what a failed run had staged is merged by the next one.
    """
    spark = warehouse.spark
    done = warehouse.already_ingested(source_hash, metadata)
    if done:
        return done
    run, place = uuid.uuid4().hex, stream_folder(warehouse.root, folder, metadata.source_url, metadata.dataset_version)
    stage_stream(file_stream(spark, folder, files_per_trigger), metadata.source_url, place).awaitTermination()
    merged = warehouse.stream_state(place)
    fresh = lambda kind: spark.read.parquet(f"{place}/{kind}").filter(F.col("batch") > F.lit(merged))
    staged = fresh("staged")
    last = staged.agg(F.max("batch")).first()[0]
    return warehouse.commit(
        settle(staged), metadata, source_hash, 0, run, V.rejected_outcomes(fresh("parsed")),
        {place: merged if last is None else int(last)},
    )


def first_seen(rows: DataFrame, delay: str | None = None, time: str = "period") -> DataFrame:
    """Keyed deduplication inside the stream's state store.

    Keeps one row per key; which one is settled only by ``settle``.  Without ``delay`` a
    key is remembered for ever; with one, for as long as duplicates may come late.
    """
    if delay is None:
        return rows.dropDuplicates(KEY)
    timed = rows.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    return timed.dropDuplicatesWithinWatermark(KEY).drop("_time")


def mirror_stream(spark: SparkSession, gold: str, mirror: Mirror, folder: str, files_per_trigger: int = 10) -> None:
    """Stage accepted rows of a run micro-batch by micro-batch, then feed them into the mirror by one merge.

    Replays are harmless: a micro-batch overwrites itself, and merging the same rows changes nothing.  The mirror's commit
    records the last micro-batch merged, so a later call reads only what has been staged since.
    """
    rows = (
        spark.readStream.schema(FACT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{gold}/*")
    )
    (
        rows.writeStream.foreachBatch(
            lambda batch, n: batch.select(*MIRROR_COLUMNS).write.mode("overwrite").parquet(f"{folder}/staged/batch={n}")
        )
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    merged = mirror.stream_state(folder)
    try:
        staged = spark.read.parquet(f"{folder}/staged").filter(F.col("batch") > F.lit(merged))
    except AnalysisException:  # nothing has ever been staged
        return
    last = staged.agg(F.max("batch")).first()[0]
    if last is not None:
        mirror.upsert_facts(settled_facts(staged), {folder: int(last)})


def settled_facts(staged: DataFrame) -> DataFrame:
    """One row per key from several micro-batches: that of the latest batch."""
    payload = [c for c in MIRROR_COLUMNS if c not in KEY]
    latest = staged.groupBy(*KEY).agg(F.max_by(F.struct(*payload), "batch").alias("p"))
    return latest.select(*KEY, "p.*").select(*MIRROR_COLUMNS)
