"""Late and out-of-order events: periods that are corrected until a cut-off.

Method: per-source low watermarks and punctuations, as state of a stream.  The
clock of a source is what it has reported last.  It punctuates a period when it
first reports beyond the period's bound (end of period + allowed lateness); its
own records for that period that are reported from then on are diverted.  A
period closes when every source has punctuated it or is idle: a source silent
for ``idle_ms`` is no longer waited for.

State is kept by key (source and week of the last bound passed; period) in
versions, one a micro-batch.  A batch writes its verdicts and the new state
beside what is there and then claims its number with one file that names
both.  A batch that dies before has changed nothing and is run again; one that
was claimed is not run twice.  Reports are judged on the axis of their own
time, so the answer does not depend on the order of arrival.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions.times import DAY_MS, WEEK_MS, week_start_ms
from chronolith.session import claim, listed, read_text

NO_SOURCE = ""
LATENESS_MS, IDLE_MS = 21 * DAY_MS, 28 * DAY_MS
#: State of a source: first and last report by the greatest period end whose bound lies before them.
MARKS = "source string, upto long, first long, last long"
COUNTS = ["n_first", "n_corrected", "n_diverted"]
SUMS = ["sum_first", "sum_corrected"]
PERIODS = "period_start long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in SUMS)


def records(df: DataFrame) -> DataFrame:
    """What takes part, with period_start and period_end: rows without ``at`` or ``reported`` are no records.

    No source is a source of its own."""
    ok = df.where("at IS NOT NULL AND reported IS NOT NULL").withColumn("source", F.coalesce("source", F.lit(NO_SOURCE)))
    return ok.withColumn("period_start", week_start_ms(F.col("at"))).withColumn("period_end", F.col("period_start") + WEEK_MS)


def marks_of(ok: DataFrame, lateness_ms: int) -> DataFrame:
    """MARKS of records: a source sends a row a task and week, however many records it has."""
    passed = week_start_ms(F.col("reported") - lateness_ms - 1)
    return ok.groupBy("source", passed.alias("upto")).agg(F.min("reported").alias("first"), F.max("reported").alias("last"))


def merged_marks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("source", "upto").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def punctuations(marks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, period_end, passed_at): the first report of a source beyond the bound of each wanted (source, period_end).

    The running minimum from behind over the marks, sources x weeks in size."""
    asked = wanted.select("source", F.col("period_end").alias("upto"), F.lit(None).cast("long").alias("first"), F.lit(1).alias("ask"))
    both = marks.select("source", "upto", "first", F.lit(0).alias("ask")).unionAll(asked.distinct())
    behind = Window.partitionBy("source").orderBy(F.col("upto").desc(), "ask").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("passed_at", F.min("first").over(behind)).where("ask = 1")
    return found.select("source", F.col("upto").alias("period_end"), "passed_at")


def judged(ok: DataFrame, marks: DataFrame) -> DataFrame:
    """Records with their verdict from the state: ``on_time`` before the period's end, ``corrects`` up to and with
    the bound, ``too_late`` from when the source has punctuated the period."""
    p = punctuations(marks, ok.select("source", "period_end"))
    p = p.select(F.col("source").alias("_source"), F.col("period_end").alias("_end"), "passed_at")
    out = ok.join(p, (F.col("source") == F.col("_source")) & (F.col("period_end") == F.col("_end")), "left")
    late = F.col("passed_at").isNotNull() & (F.col("reported") >= F.col("passed_at"))
    verdict = F.when(late, "too_late").when(F.col("reported") >= F.col("period_end"), "corrects").otherwise("on_time")
    return out.select(*ok.columns, verdict.alias("verdict"))


def period_sums(verdicts: DataFrame, amount: str | None) -> DataFrame:
    """PERIODS of judged records: as first known, as corrected up to the bound, and what was diverted."""
    on, kept = F.col("verdict") == "on_time", F.col("verdict") != "too_late"
    value = F.col(amount).cast("double") if amount else F.lit(None).cast("double")
    n = lambda c: F.count(F.when(c, 1))
    return verdicts.groupBy("period_start").agg(
        n(on).alias("n_first"), n(kept).alias("n_corrected"), n(~kept).alias("n_diverted"),
        F.sum(F.when(on, value)).alias("sum_first"), F.sum(F.when(kept, value)).alias("sum_corrected"),
    )


def closings(marks: DataFrame, periods: DataFrame, lateness_ms: int = LATENESS_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """(period_end, closed_at, n_sources) of the periods (period_start): when every source has passed the bound or was
    idle; closed_at null while open.

    A source that had sent nothing by the bound is not waited for.  All that is
    handled has the size sources x weeks, not that of the records."""
    ends = periods.select((F.col("period_start") + WEEK_MS).alias("period_end")).distinct()
    lo, hi = ends.agg(F.min("period_end"), F.max("period_end")).first()
    now = marks.agg(F.max("last")).first()[0]
    if lo is None or now is None:
        return ends.select("period_end", F.lit(None).cast("long").alias("closed_at"), F.lit(0).cast("long").alias("n_sources")).limit(0)
    none = F.lit(None).cast("long")
    weeks = F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(WEEK_MS)))
    asks = marks.select("source").distinct().select(
        "source", weeks.alias("upto"), none.alias("first"), none.alias("last"), F.lit(1).alias("ask")
    )
    both = marks.select("source", "upto", "first", "last", F.lit(0).alias("ask")).unionAll(asks)
    behind = Window.partitionBy("source").orderBy(F.col("upto").desc(), "ask").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("source").orderBy("upto", F.col("ask").desc()).rowsBetween(Window.unboundedPreceding, 0)
    each = both.withColumn("passed_at", F.min("first").over(behind)).withColumn("prev", F.max("last").over(ahead))
    each = each.where("ask = 1").withColumn("bound", F.col("upto") + lateness_ms)
    idle = F.greatest("bound", F.col("prev") + idle_ms)
    at = F.when(F.col("prev").isNull(), F.col("bound")).otherwise(F.least("passed_at", F.when(idle <= now, idle)))
    per = each.select(F.col("upto").alias("period_end"), at.alias("at")).groupBy("period_end")
    per = per.agg(F.max("at").alias("top"), F.count("at").alias("n"), F.count(F.lit(1)).alias("n_sources"))
    closed = F.when((F.col("n") == F.col("n_sources")) & (F.col("top") <= now), F.col("top"))
    return per.join(ends, "period_end", "left_semi").select("period_end", closed.alias("closed_at"), "n_sources")


class LateEvents:
    """The stream operator over a folder of its own, which outlives the call: run() takes up what is new.

    records: (source, at, reported, ...), times long ms; other columns come
    through to the verdicts.  ``amount`` names a column to be summed by period."""

    def __init__(self, spark: SparkSession, path: str, amount: str | None = None, lateness_ms: int = LATENESS_MS, idle_ms: int = IDLE_MS):
        self.spark, self.path, self.amount = spark, path.rstrip("/"), amount
        self.lateness_ms, self.idle_ms = lateness_ms, idle_ms

    def _versions(self) -> list[dict]:
        done = sorted(int(n) for n in listed(self.spark, f"{self.path}/versions") if n.isdigit())
        return [json.loads(read_text(self.spark, f"{self.path}/versions/{n}")) for n in done]

    def _state(self, name: str, schema: str) -> DataFrame:
        done = self._versions()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{done[-1][name]}")

    def marks(self) -> DataFrame:
        return self._state("marks", MARKS)

    def periods(self) -> DataFrame:
        """(period_start, n_first, n_corrected, n_diverted, sum_first, sum_corrected), corrected up to the last batch."""
        return self._state("periods", PERIODS)

    def closings(self) -> DataFrame:
        return closings(self.marks(), self.periods(), self.lateness_ms, self.idle_ms)

    def verdicts(self, schema) -> DataFrame:
        """All records judged so far: the columns of the stream, period_start, period_end and verdict."""
        parts = [f"{self.path}/verdicts/{v['verdicts']}" for v in self._versions()]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts)

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; a number that has been claimed is done."""
        if str(number) in listed(self.spark, f"{self.path}/versions"):
            return
        names = {k: uuid.uuid4().hex for k in ("marks", "verdicts", "periods")}
        to = {k: f"{self.path}/{k}/{v}" for k, v in names.items()}
        ok = records(batch)
        merged_marks(self.marks(), marks_of(ok, self.lateness_ms)).write.parquet(to["marks"])
        judged(ok, self.spark.read.schema(MARKS).parquet(to["marks"])).write.parquet(to["verdicts"])
        fresh = period_sums(self.spark.read.parquet(to["verdicts"]), self.amount)
        sums = (F.sum(c).alias(c) for c in [*COUNTS, *SUMS])
        self.periods().unionByName(fresh).groupBy("period_start").agg(*sums).write.parquet(to["periods"])
        claim(self.spark, f"{self.path}/versions/{number}", json.dumps(names))

    def run(self, stream: DataFrame) -> DataFrame:
        """Take the stream to its present end; all verdicts."""
        schema = records(stream).withColumn("verdict", F.lit("")).schema
        start = stream.writeStream.option("checkpointLocation", f"{self.path}/stream").foreachBatch(self.apply)
        start.trigger(availableNow=True).start().awaitTermination()
        return self.verdicts(schema)
