"""Processing only new or changed records.

State is the set of (key, content hash) that succeeded runs have processed, kept
in versions that outlive the run.  Current rows are hashed and joined with the
state; what it does not hold is new or changed.  A run writes what it has
judged to a folder of its own name and then swaps the version by claiming the
next number with one file that names all folders of the state (session.claim).
A run that dies before the swap has changed nothing; one that dies after it is
simply done; of two runs at a time one is told so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.errors import EngineError
from chronolith.operators.dyadic import interval_nodes, point_nodes
from chronolith.operators.prefix import successor
from chronolith.session import claim, listed, read_text, remove

#: Positions per block in the join of records with covered stretches.
BLOCK = 4096
#: Folders of a state from which it is written together anew.
FOLDERS = 16
RECORD = ["feed", "scope", "pos"]
CONTENT = [*RECORD, "h1", "h2"]
JUDGED = "feed string, scope string, pos long, h1 long, h2 long, first_received long, done boolean"
RUN = "feed string, scope string, after_pos long, upto_pos long, started long"


def content_hash(cols: Sequence[str], df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes over the columns, nulls told apart from empty values."""
    flat = [F.to_json(
        F.col(c), {"ignoreNullFields": "false"}
    ) if df.schema[c].dataType.typeName() in ("struct", "array", "map", "variant") else F.col(c) for c in sorted(cols)]
    marks = [F.col(c).isNull() for c in sorted(cols)]
    return [F.xxhash64(*flat, *marks).alias("h1"), F.xxhash64(F.lit("second"), *flat[::-1], *marks).alias("h2")]


class ContentState:
    """Versioned contents that have been processed, with the runs they were judged by."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The current version; 0 before the first swap."""
        names = listed(self.spark, f"{self.path}/versions")
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _told(self, version: int) -> dict:
        if not version:
            return {"contents": [], "runs": None}
        return json.loads(read_text(self.spark, f"{self.path}/versions/{version}"))

    def read(self, version: int | None = None) -> DataFrame:
        """CONTENT of what has been processed."""
        names = self._told(self.version() if version is None else version)["contents"]
        if not names:
            return self.spark.createDataFrame([], JUDGED).select(*CONTENT)
        return self.spark.read.schema(JUDGED).parquet(*(f"{self.path}/contents/{n}" for n in names)).where("done").select(*CONTENT)

    def runs(self, version: int) -> DataFrame:
        """RUN rows that a version rests on."""
        name = self._told(version)["runs"]
        return self.spark.read.schema(RUN).parquet(f"{self.path}/runs/{name}") if name else self.spark.createDataFrame([], RUN)

    def publish(self, judged: str, runs: DataFrame, version: int, anew: bool = False) -> int:
        """Swap from ``version`` to the next: its contents and the folder ``judged``, or (``anew``) that alone.

        E_STALE_STATE if another run has swapped since ``version`` was read."""
        old = [] if anew else self._told(version)["contents"]
        names, run = [*old, judged], uuid.uuid4().hex
        if len(names) > FOLDERS:
            names = [uuid.uuid4().hex]
            done = self.spark.read.schema(JUDGED).parquet(*(f"{self.path}/contents/{n}" for n in [*old, judged])).where("done")
            done.write.parquet(f"{self.path}/contents/{names[0]}")
        runs.write.parquet(f"{self.path}/runs/{run}")
        if not claim(self.spark, f"{self.path}/versions/{version + 1}", json.dumps({"contents": names, "runs": run})):
            raise EngineError("E_STALE_STATE", f"version {version + 1} was made by another run")
        return version + 1

    def forget(self, keep: int = 2) -> None:
        """Remove folders that none of the last ``keep`` versions names, and the versions before."""
        last = self.version()
        named = [self._told(v) for v in range(max(1, last - keep + 1), last + 1)]
        for kind, used in (("contents", {c for t in named for c in t["contents"]}), ("runs", {t["runs"] for t in named})):
            for name in listed(self.spark, f"{self.path}/{kind}"):
                if name not in used:
                    remove(self.spark, f"{self.path}/{kind}/{name}")
        for v in listed(self.spark, f"{self.path}/versions"):
            if v.isdigit() and int(v) <= last - keep:
                remove(self.spark, f"{self.path}/versions/{v}")


def take_up(state: ContentState, current: DataFrame, runs: DataFrame, tops: DataFrame) -> DataFrame:
    """The records (feed, scope, pos) still to process, and the state brought up to the succeeded ``runs``.

    current: from content_versions; runs: RUN; tops: (feed, scope, top).  A version
    rests on its runs: if one of them is no longer there, all contents are judged
    anew.  Contents that the state holds are not judged again."""
    version = state.version()
    runs = runs.select(*(c.split()[0] for c in RUN.split(", "))).distinct()
    keep = version > 0 and state.runs(version).exceptAll(runs).isEmpty()
    todo = current.join(state.read(version), CONTENT, "left_anti") if keep else current
    name = uuid.uuid4().hex
    path = f"{state.path}/contents/{name}"
    processed(todo, covered_until(runs, tops)).write.parquet(path)
    judged = state.spark.read.schema(JUDGED).parquet(path)
    if not keep or not judged.where("done").isEmpty():
        state.publish(name, runs, version, anew=not keep)
    return judged.where("NOT done").select(*RECORD)


def covered_until(runs: DataFrame, last: DataFrame) -> DataFrame:
    """Disjoint stretches (feed, scope, lo, hi, done_at) of positions ``lo <= p < hi`` and the latest start of a run that covers them.

    runs: (feed, scope, after_pos, upto_pos, started) of succeeded runs, started
    long; last: (feed, scope, top) the highest position of each scope, at which
    stretches end.  A run covers ``after_pos < p <= upto_pos``; runs with a null,
    or that cover nothing, are dropped.
    """
    lv = 40
    key = ["feed", "scope"]
    r = runs.where("feed IS NOT NULL AND scope IS NOT NULL AND after_pos IS NOT NULL AND upto_pos IS NOT NULL AND started IS NOT NULL").join(last, key)
    r = r.select(
        *key, F.greatest(F.col("after_pos") + 1, F.lit(0)).alias("lo"), (F.least("upto_pos", "top") + 1).alias("hi"),
        "started"
    ).where("lo < hi")
    nodes = r.withColumn(
        "node", F.explode(interval_nodes(F.col("lo"), F.col("hi"), 0, lv))
    ).groupBy(*key, "node").agg(F.max("started").alias("started"))
    points = r.select(*key, F.explode(F.array("lo", "hi")).alias("lo")).distinct()
    known = points.withColumn(
        "node", F.explode(point_nodes(F.col("lo"), 0, lv))
    ).join(nodes, [*key, "node"]).groupBy(*key, "lo").agg(F.max("started").alias("done_at"))
    return successor(points, key, "lo", "hi", block=10**6).join(known, [*key, "lo"]).where("hi IS NOT NULL")


def content_versions(records: DataFrame) -> DataFrame:
    """From (feed, scope, pos, received, h1, h2) to one row per content: (…, first_received, current).

    ``current`` marks the content received last (ties: the greater hash).  Rows
    delivered again are combined before the shuffle.
    """
    c = records.groupBy("feed", "scope", "pos", "h1", "h2").agg(
        F.min("received").alias("first_received"), F.max("received").alias("last_received")
    )
    return c.groupBy("feed", "scope", "pos").agg(F.max(F.struct("last_received", "h1", "h2", "first_received")).alias("now")).select(
        "feed", "scope", "pos", "now.h1", "now.h2", "now.first_received"
    )


def processed(current: DataFrame, stretches: DataFrame) -> DataFrame:
    """JUDGED: ``done`` where a succeeded run has processed the content: its stretch covers the position and it began
    no earlier than the content came.  Stretches of a scope are disjoint, so a content meets one at most."""
    blocks = F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))
    s = stretches.withColumn("block", F.explode(blocks))
    s = s.select(F.col("feed").alias("s_feed"), F.col("scope").alias("s_scope"), "block", "lo", "hi", "done_at")
    same = (F.col("feed") == F.col("s_feed")) & (F.col("scope") == F.col("s_scope")) & (F.floor(F.col("pos") / BLOCK) == F.col("block"))
    inside = (F.col("lo") <= F.col("pos")) & (F.col("pos") < F.col("hi")) & (F.col("first_received") <= F.col("done_at"))
    hit = current.join(s, same & inside, "left")
    return hit.select(*CONTENT, "first_received", F.col("lo").isNotNull().alias("done"))
