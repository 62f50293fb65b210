"""Half-open time intervals per entity: continuous periods and gaps.

Method: starts and ends are ranked independently per entity.  A gap lies
between the k-th end and the (k+1)-th start exactly if that start is the
greater; the boundaries left over are paired to periods.  Both rankings are
running counts over one long frame of boundaries, equal instants combined: at
the k-th end the next start is later exactly if no more than k intervals have
started by then.  The counts come from block-wise sums and the pairing from the
next boundary in a block, never from one task per entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.dyadic import OPEN
from chronolith.operators.prefix import running_sums, successor
from chronolith.session import written


def periods_and_gaps(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Rows (keys, what, start, end), what in (``period``, ``gap``); end null for an open period.

    ``lo`` and ``hi`` are long (microseconds); hi null = open.  Intervals
    without start or with ``hi <= lo``, and rows with a null in ``keys``, are
    left out.  Touching intervals belong to one period.  Repeats and nesting
    change nothing.  No rows give no rows.
    """
    keys = list(keys)
    named = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    s, e = F.col(lo).cast("long"), F.coalesce(F.col(hi).cast("long"), F.lit(OPEN))
    ok = named.select(*keys, s.alias("_s"), e.alias("_e")).where("_s IS NOT NULL AND _e > _s")
    ends = F.array(*(F.struct(F.col(c).alias("at"), F.lit(i).alias("s"), F.lit(1 - i).alias("e")) for c, i in (("_s", 1), ("_e", 0))))
    each = ok.select(*keys, F.explode(ends).alias("_x")).select(*keys, "_x.*")
    frame = written(each.groupBy(*keys, "at").agg(F.sum("s").alias("s"), F.sum("e").alias("e")), "boundaries")
    ranked = running_sums(frame, keys, "at", {"started": "s", "ended": "e"})
    now, before = F.col("started") - F.col("ended"), F.col("started") - F.col("s") - F.col("ended") + F.col("e")
    opens, closes = (F.col("s") > 0) & (before == 0), (F.col("e") > 0) & (now == 0)
    left = written(ranked.where(opens | closes).select(*keys, "at", opens.alias("opens")), "left-over")
    paired = successor(left, keys, "at", "next").where("next IS NOT NULL")
    what = F.when(F.col("opens"), "period").otherwise("gap")
    return paired.select(*keys, what.alias("what"), F.col("at").alias("start"), F.when(F.col("next") != OPEN, F.col("next")).alias("end"))


def contains(lo: Column, hi: Column, at: Column) -> Column:
    """Half-open containment; null hi = open."""
    return (at >= lo) & (hi.isNull() | (at < hi))


def overlap(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """Do two half-open intervals share an instant?"""
    return (hi.isNull() | (lo2 < hi)) & (hi2.isNull() | (lo < hi2))


def meet(lo: Column, hi: Column, lo2: Column, hi2: Column) -> tuple[Column, Column]:
    """Start and end of the intersection (end null = open)."""
    return F.greatest(lo, lo2), F.least(hi, hi2)
