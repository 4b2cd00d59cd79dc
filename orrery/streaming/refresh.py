"""Chunks kept current from a stream of file versions.

The source has no streams of its own; this feeds its chunk table from files as they arrive (path, content, version).

Paths are dealt to buckets by hash. A batch writes anew the buckets that it touches, and a small manifest says for every
bucket which batch wrote it last; others aren't read or written.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import chunk_lines

SCHEMA = "path string, content string, version long"
CHUNKS = "path string, start_line int, end_line int, content string"
BUCKETS = 64


def latest_versions(batch: DataFrame) -> DataFrame:
    """The last version of each path; null content means that the file is gone."""
    return batch.groupBy("path").agg(F.max(F.struct("version", "content")).alias("_last")).select("path", "_last.version", "_last.content")


def _store(spark: SparkSession, folder: str):
    """The folder as a path of the cluster's file system, and that file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, table: str, before: int | None = None) -> dict:
    """The last manifest, or the last of a batch before ``before``: number, and the batch of each bucket."""
    path, store = _store(spark, table)
    if not store.exists(path):
        return {"number": -1, "batches": {}}
    names = [x.getPath().getName() for x in store.listStatus(path)]
    numbers = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
    last = max((n for n in numbers if before is None or n < before), default=None)
    if last is None:
        return {"number": -1, "batches": {}}
    return json.loads(spark.read.text(f"{table}/manifest-{last}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, table: str, manifest: dict) -> None:
    """A manifest appears as a whole, by a rename; one of an earlier try gives way."""
    path, store = _store(spark, f"{table}/manifest-{manifest['number']}.json")
    fresh, _ = _store(spark, f"{table}/.manifest-{manifest['number']}.new")
    out = store.create(fresh, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    store.delete(path, False)
    store.rename(fresh, path)


def _read(spark: SparkSession, table: str, batches: dict[str, int | None], buckets: list[str] | None = None) -> DataFrame:
    places = [f"{table}/batch={n}/bucket={b}" for b, n in sorted(batches.items()) if n is not None and (buckets is None or b in buckets)]
    return spark.read.schema(CHUNKS).parquet(*places) if places else spark.createDataFrame([], CHUNKS)


def refresh_chunks(files: DataFrame, table: str, checkpoint: str, size: int = 80, overlap: int = 15, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Keeps ``table`` to the files as they stand, batch by batch; ``current_chunks`` reads it.

    A batch's paths replace their chunks and others keep theirs. A batch that runs again starts from the state before
    it and writes the same folders, so the table is right after a failure.
    """

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
        new = latest_versions(batch).cache()
        touched = [str(r[0]) for r in new.select(bucket).distinct().collect()]  # at most ``buckets``
        before = _manifest(spark, table, number)
        kept = _read(spark, table, before["batches"], touched).join(new.select("path"), "path", "left_anti")
        fresh = chunk_lines(new.where("content IS NOT NULL").select("path", "content"), "content", size, overlap)
        fresh.unionByName(kept).select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")
        path, store = _store(spark, f"{table}/batch={number}")
        written = {x.getPath().getName().removeprefix("bucket=") for x in store.listStatus(path) if x.isDirectory()}
        _publish(spark, table, {"number": number, "batches": before["batches"] | {b: number if b in written else None for b in touched}})
        new.unpersist()

    return files.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_chunks(spark: SparkSession, table: str) -> DataFrame:
    return _read(spark, table, _manifest(spark, table)["batches"])
