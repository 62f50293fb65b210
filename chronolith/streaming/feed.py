"""Change feed, at-least-once dispatch with receipts, incremental views, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators.algebra import edge_filter
from chronolith.operators.prefix import running_sums
from chronolith.session import scratch


PAGE = 1000


def pull(log: DataFrame, cursor: int | None, limit: int = PAGE) -> tuple[DataFrame, int | None]:
    """Events after the cursor (None: from the first) in order of seq, at most ``limit`` revisions, and the next cursor."""
    left = log.where(F.col("seq").isNotNull() if cursor is None else F.col("seq") > cursor)
    seqs = [r[0] for r in left.select("seq").distinct().orderBy("seq").limit(limit).collect()]
    upto = seqs[-1] if seqs else cursor
    return left.where(F.col("seq") <= upto) if seqs else left.limit(0), upto


def pages(log: DataFrame, limit: int = PAGE) -> DataFrame:
    """All events with the ``page`` that gives them when the feed is pulled from the first to its end, in one pass."""
    ranks = running_sums(
        log.where("seq IS NOT NULL").select(F.col("seq").cast("long").alias("seq"), F.lit(1).alias("_one")).distinct(),
        [], "seq", {"_rank": "_one"}, block=10_000
    )
    return log.join(ranks.select("seq", (F.floor((F.col("_rank") - 1) / limit) + 1).alias("page")), "seq")


def dispatch(stream: DataFrame, adapter: str, deliver: Callable[[DataFrame], DataFrame], path: str, attempts: int = 3) -> None:
    """Deliver each event of a stream (event_id, …) once per adapter.

    ``deliver`` maps events to (event_id, ok).  Receipts are written in a folder
    per batch and attempt; events with a receipt are not delivered again when
    a batch is repeated; what fails ``attempts`` times goes to ``dead``.
    """
    spark = stream.sparkSession
    schema = "event_id long, adapter string, status string"

    def receipts() -> DataFrame:
        try:
            return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/receipts")
        except Exception:  # no receipt yet
            return spark.createDataFrame([], schema)

    def each(batch: DataFrame, number: int) -> None:
        todo = batch.dropDuplicates(["event_id"]).join(
            receipts().where(F.col("adapter") == adapter).select("event_id"), "event_id", "left_anti"
        ).persist()
        try:
            left = todo
            for attempt in range(attempts):
                got = deliver(left).select(
                    "event_id", F.lit(adapter).alias("adapter"),
                    F.when(F.col("ok"), "done").otherwise("dead" if attempt == attempts - 1 else "retry").alias("status")
                )
                out = f"{path}/{'try' if attempt < attempts - 1 else 'last'}/{number}-{attempt}"
                got.write.mode("overwrite").parquet(out)
                res = spark.read.schema(schema).parquet(out)
                res.where("status <> 'retry'").write.mode("overwrite").parquet(f"{path}/receipts/{number}-{attempt}")
                left = left.join(res.where("status = 'retry'").select("event_id"), "event_id", "left_semi")
                if left.isEmpty():
                    break
        finally:
            todo.unpersist()

    q = stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()


def refresh_membership(members: DataFrame, changed: DataFrame, predicate: str | None = None, valid_at: int | None = None) -> DataFrame:
    """Incremental selection: members (id) of a query+filter chain after changed edges (change, id, edge columns).

    Only changed edges are looked at again; everything else keeps its place."""
    stay = members.join(changed.select("id"), "id", "left_anti")
    now = changed.where("change <> 'retracted'").where(edge_filter(predicate, valid_at=valid_at)).select("id")
    return stay.unionAll(now)


def change_set(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): added and removed members between two generations of a view."""
    b = before.select(
        "id", F.lit(1).alias("b"), F.lit(0).alias("a")
    ).unionAll(after.select("id", F.lit(0), F.lit(1))).groupBy("id").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return b.where("a <> b").select("id", F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"))


def tumbling_stream(stream: DataFrame, ts: str, width: str, lateness: str, by: list[str], path: str | None = None) -> DataFrame:
    """Event-time windows over a stream with a watermark, run to its present end; (window_start, by, n)."""
    spark: SparkSession = stream.sparkSession
    base = path or scratch(spark, "windows")
    agg = stream.withWatermark(ts, lateness).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), *by, "n"
    )
    q = agg.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(agg.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return out.groupBy("window_start", *by).agg(F.max("n").alias("n"))
