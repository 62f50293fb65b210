"""Running sums, ranks and successors per key that survive hot keys.

A window over ``partitionBy(key)`` puts a whole key into one task.  Here a key
is cut into blocks of its order column: blocks are summed first (an aggregate
with map-side combine), the few block totals of a key are accumulated, and the
window proper runs within (key, block).  The number of blocks of a key is
bounded by the range of the order column, not by its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: One day in microseconds.
DAY = 86_400_000_000


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], block: int = DAY, wholes: dict[str, str] | None = None
) -> DataFrame:
    """Add inclusive running sums per ``keys`` in the order of the long column ``order``.

    ``sums`` maps new names to value columns; ``wholes`` likewise, for the sum over
    all of the key.  (keys, order) must be distinct in ``df``: aggregate equal
    ones first, which also shrinks what is shuffled.  ``df`` is read twice; give it
    written if it is dear.  Keys are compared null-safe through the
    aggregate; rows whose ``order`` is null come first.
    """
    keys, wholes = list(keys), wholes or {}
    values = [*sums.values(), *wholes.values()]
    first = F.lit(-(2**62))
    rows = df.withColumn("_b", F.coalesce(F.floor(F.col(order) / F.lit(block)).cast("long"), first))
    totals = rows.groupBy(*keys, "_b").agg(*(F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = totals.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col("_b").alias("_kb"),
        *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_p{i}") for i in range(len(sums))),
        *(F.sum(f"_t{i}").over(whole).alias(f"_p{i}") for i in range(len(sums), len(values))),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    inside = Window.partitionBy(*keys, "_b").orderBy(F.col(order).asc_nulls_first())
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(base, on, "inner")
    added = [(F.sum(v).over(inside) + F.col(f"_p{i}")).alias(n) for i, (n, v) in enumerate(sums.items())]
    return out.select(*df.columns, *added, *(F.col(f"_p{len(sums) + i}").alias(n) for i, n in enumerate(wholes)))


def successor(df: DataFrame, keys: Sequence[str], order: str, name: str, block: int = 30 * DAY) -> DataFrame:
    """Add ``name``: the next value of ``order`` within ``keys`` (null for the last).

    (keys, order) must be distinct and ``order`` not null.
    """
    keys = list(keys)
    rows = df.withColumn("_b", F.floor(F.col(order) / F.lit(block)).cast("long"))
    firsts = rows.groupBy(*keys, "_b").agg(F.min(order).alias("_first"))
    base = firsts.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"),
        F.lead("_first").over(Window.partitionBy(*keys).orderBy("_b")).alias("_beyond")
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    return rows.join(base, on, "inner").select(*df.columns, F.coalesce(F.lead(order).over(inside), F.col("_beyond")).alias(name))
