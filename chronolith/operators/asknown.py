"""Attributes as they were known at the time of an event.

Each version of an interval row was the last word on its key from its own
``recorded_at`` to that of the next version, so the events that may use it lie
in the intersection of its validity with that span.  These effective intervals
are laid over dyadic nodes of about their length; an event meets the nodes that
enclose it by equi-join, and the exact half-open test decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.dyadic import LEVELS, OPEN, cover_nodes, step_nodes
from chronolith.operators.prefix import successor

#: Levels of dyadic nodes in use: leaves of 19 hours, then four times as long each, up to all of time.
STEPS = (4, 6, 8, 10, 12, LEVELS)


def effective_versions(df: DataFrame, entity: str, key: str, lo: str, hi: str, recorded: str, attrs: Sequence[str]) -> DataFrame:
    """Versions (entity, key, since, until, valid_lo, attrs): the span in which each version answers.

    lo, hi, recorded: long microseconds.  Versions of one (entity, key) with the
    same ``recorded`` are settled by the greatest (lo, hi, attrs).  A version
    without start or with a reversed or empty interval answers nothing, but
    still ends the span of the one before.  Rows without entity, key or
    ``recorded`` are left out.
    """
    rows = df.select(
        F.col(entity).alias("entity"), F.col(key).alias("key"), F.col(recorded).cast("long").alias("rec"),
        F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"),
        *(F.col(a).alias(f"a_{a}") for a in attrs)
    )
    rows = rows.where("entity IS NOT NULL AND key IS NOT NULL AND rec IS NOT NULL")
    last = rows.groupBy("entity", "key", "rec").agg(F.max(F.struct("lo", "hi", *(f"a_{a}" for a in attrs))).alias("v"))
    told = successor(last, ["entity", "key"], "rec", "superseded")
    out = told.select(
        "entity", "key", F.greatest("v.lo", "rec").alias("since"), F.least(
            F.coalesce("v.hi", F.lit(OPEN)), F.coalesce("superseded", F.lit(OPEN))
        ).alias("until"), F.col("v.lo").alias("valid_lo"),
        *(F.col(f"v.a_{a}").alias(a) for a in attrs), (F.col("v.lo").isNotNull() & (F.col("v.hi").isNull() | (F.col("v.hi") > F.col("v.lo")))).alias("ok"),
    )
    return out.where("ok AND since < until").drop("ok")


def as_known(events: DataFrame, versions: DataFrame, entity: str, at: str) -> DataFrame:
    """Every (event, version) where the version answered for the event's entity at its time.

    events: columns ``entity`` and ``at`` (long microseconds) and others, which
    come through: select what is wanted first, and give it written if it is dear,
    as its reach in time is taken in a job of its own.  versions: from
    effective_versions, of one table or several with a column that tells them
    apart.  Events without entity or time match nothing.

    An event is handed on once for each level of STEPS, a version once or twice.
    """
    e = events.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    first, last = e.agg(F.min(at), F.max(at)).first()
    if first is None:  # no event: an empty join of the same columns
        first, last = 0, 0
    # a version is looked for among the events only, so an open one ends with them
    lo, hi = F.greatest("since", F.lit(first)), F.least("until", F.lit(last + 1))
    v = versions.where((F.col("since") <= last) & (F.col("until") > first))
    v = v.withColumn("_vnode", F.explode(cover_nodes(lo, hi, STEPS))).withColumnRenamed("entity", "_entity")
    v = v.select("_entity", "_vnode", *(F.col(c).alias(f"v_{c}") for c in versions.columns if c != "entity"))
    e = e.withColumn("_node", F.explode(step_nodes(F.col(at), STEPS)))
    same = (F.col(entity) == F.col("_entity")) & (F.col("_node") == F.col("_vnode"))
    hit = e.join(v, same & (F.col("v_since") <= F.col(at)) & (F.col(at) < F.col("v_until")))
    return hit.drop("_node", "_vnode", "_entity")
