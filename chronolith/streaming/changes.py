"""Applying a stream of inserts, updates and deletes.

The streaming state of a key is one value: the greatest (order, tombstone,
payload) seen, so only newer changes replace it, and repeats and late arrivals
fall away.  It is a built-in streaming aggregate in update mode: combined
before the shuffle, so a hot key sends a row per task, and kept in the state
store.  Each micro-batch's upserts are written to a folder named after the
batch, replaced when the batch is run again, which makes the output idempotent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.session import listed, prepare, remove, scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: State beyond the heap, with bounded native memory, and small incremental checkpoints.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "384",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_stream(spark: SparkSession, path: str, max_bytes: str | None = None) -> DataFrame:
    """A Parquet file, or directory of files, as a stream; a batch takes at most ``max_bytes`` (None: all there is)."""
    prepare(spark)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(path.rpartition("/")[0])


def apply_changes(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], removed: Column, payload: Sequence[str],
    path: str | None = None, rocksdb: bool = True
) -> DataFrame:
    """Run the stream to its present end; the newest state of each key: (keys, order, removed, payload).

    A change is newer if ``order`` is greater; equal orders are settled by
    (removed, payload), so the result is the same in any arrival order.  Nulls
    in ``order`` come first, as if oldest; a row with a null in ``keys`` is no
    change.  ``path`` keeps output and state for the next call, which then
    takes up only what is new; without it, a fresh scratch folder is used.
    """
    spark = stream.sparkSession
    base = path or scratch(spark, "changes")
    fields = [*order, "_removed", *payload]
    rows = stream.withColumn("_removed", removed).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    state = rows.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_s")).select(*keys, "_s.*")

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    with _settings(spark, STATE if rocksdb else {}):
        start = state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(upsert)
        start.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return _newest(out, keys, fields)


def _newest(out: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    top = out.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_s"))
    return top.select(*keys, *(F.col(f"_s.{c}").alias("removed" if c == "_removed" else c) for c in fields))


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> int:
    """Put the batches of apply_changes(path=...) together to one folder with the newest state of each key; how many they were.

    Between runs only.  Tombstones stay: a late change of a removed key must find
    them.  The new folder is whole before the old ones go, and a state that stands in
    both counts once, so a run that dies half-way has lost nothing."""
    old = [n for n in listed(spark, f"{path}/out") if n.startswith(("batch=", "kept-"))]
    if len(old) > 1:
        fields = [*order, "_removed", *payload]
        newest = _newest(spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/out"), keys, fields)
        newest.withColumnRenamed("removed", "_removed").write.parquet(f"{path}/out/kept-{uuid.uuid4().hex}")
        for n in old:
            remove(spark, f"{path}/out/{n}")
    return len(old)
