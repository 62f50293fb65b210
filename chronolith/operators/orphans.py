"""References to records that do not exist, or not at the time of the reference.

Method: parent and child keys are tagged and united in long form, grouped by
parent table and key; groups without a parent flag are orphans.  Time enters as
a sweep: a parent row is +1 at ``recorded_at`` and -1 at ``deleted_at``, so the
running sum at a child's time counts the parents standing then.  The sweep runs
in day blocks (operators.prefix), after equal (table, key, time) rows have been
combined, so one key may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions.refs import micros, reference
from chronolith.operators.prefix import running_sums
from chronolith.session import written


@dataclass(frozen=True)
class Parent:
    """A target table: its key and when its rows were recorded and deleted (None: never)."""

    name: str
    df: DataFrame
    key: str
    recorded: str = "recorded_at"
    deleted: str | None = "deleted_at"
    lower: bool = False


@dataclass(frozen=True)
class Child:
    """A referring table: its own key, the referring column, the parent's name and the time of judgement."""

    name: str
    df: DataFrame
    key: str
    ref: str
    parent: str
    recorded: str = "recorded_at"


def orphans(parents: Sequence[Parent], children: Sequence[Child]) -> DataFrame:
    """Every child row whose reference is unanswered at the row's own time.

    Result (src_table, record_key, ref_month, reason, ref_key, parent_table),
    one row per child row.  reason: ``missing`` - no parent row has the key at
    any time; ``deleted`` - parents were recorded by then but none stands;
    ``late`` - the key is recorded only afterwards.  References that mean "no
    reference" are no case.  A child without a time has no month and, unless
    its key is missing, counts as late.  A parent row without ``recorded_at``
    never stands, yet its key is not missing.  Empty tables are fine.
    """
    tables = {p.name: p for p in parents}
    of = lambda p, c: reference(c, lower=p.lower)

    def points(p: Parent) -> DataFrame:
        at, off = micros(p.recorded), micros(p.deleted) if p.deleted else F.lit(None).cast("long")
        ends = F.when(
            at.isNotNull() & off.isNotNull() & (off > at),
            F.struct(off.alias("at"), F.lit(-1).alias("step"), F.lit(0).alias("seen"))
        )
        never = at.isNotNull() & off.isNotNull() & (off <= at)
        start = F.struct(
            at.alias("at"), F.when(at.isNull() | never, 0).otherwise(1).alias("step"),
            F.when(at.isNull(), 0).otherwise(1).alias("seen")
        )
        x = p.df.select(of(p, p.key).alias("ref_key"), F.explode(F.filter(F.array(start, ends), lambda e: e.isNotNull())).alias("e"))
        return x.where("ref_key IS NOT NULL").select(
            F.lit(p.name).alias("parent_table"), "ref_key", "e.at", "e.step", "e.seen", F.lit(1).alias("is_parent"),
            F.lit(0).alias("is_child")
        )

    def rows(c: Child) -> DataFrame:
        p = tables[c.parent]
        return c.df.select(
            F.lit(c.parent).alias("parent_table"), of(p, c.ref).alias("ref_key"), micros(c.recorded).alias("at"), F.lit(c.name).alias("src_table"),
            F.col(c.key).cast("string").alias("record_key"), F.date_format(
                F.col(c.recorded).cast("timestamp"), "yyyy-MM"
            ).alias("ref_month"),
        ).where("ref_key IS NOT NULL")

    child = reduce(DataFrame.unionAll, map(rows, children))
    long = reduce(DataFrame.unionAll, map(points, parents)).unionAll(
        child.select(
            "parent_table", "ref_key", "at", F.lit(0).alias("step"), F.lit(0).alias("seen"),
            F.lit(0).alias("is_parent"), F.lit(1).alias("is_child")
        )
    )
    key = ["parent_table", "ref_key"]
    summed = (F.sum(c).alias(c) for c in ("step", "seen", "is_parent"))
    # the one long frame, combined and written: the sweep reads it twice
    at = written(long.groupBy(*key, "at").agg(*summed, F.max("is_child").alias("is_child")), "references")
    swept = running_sums(at, key, "at", {"standing": "step", "known": "seen"}, wholes={"parents": "is_parent"})
    missing, timed = F.col("parents") <= 0, F.col("at").isNotNull()
    reason = F.when(missing, "missing").when(timed & (F.col("known") > 0), "deleted").otherwise("late")
    verdict = swept.where("is_child > 0").where(missing | ~timed | (F.col("standing") <= 0))
    verdict = verdict.select(*(F.col(c).alias(f"v_{c}") for c in [*key, "at"]), reason.alias("reason"))
    on = [F.col(c) == F.col(f"v_{c}") for c in key] + [F.col("at").eqNullSafe(F.col("v_at"))]
    return child.join(verdict, on).select("src_table", "record_key", "ref_month", "reason", "ref_key", "parent_table")


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphan rows per referring table, month and reason."""
    return found.groupBy("src_table", "parent_table", "ref_month", "reason").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ref_key").alias("n_keys")
    )
