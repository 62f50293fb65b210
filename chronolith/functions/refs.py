"""Reference keys and rows that hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for "no reference" (compared trimmed, in lower case).
NO_REFERENCE = ("", "-", "n/a", "none")


def reference(col: Column | str, lower: bool = False) -> Column:
    """A reference key, trimmed and in one letter case; null where the text means "no reference"."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(c.isNull() | F.lower(t).isin(*NO_REFERENCE), F.lit(None).cast("string")).otherwise(F.lower(t) if lower else F.upper(t))


def micros(col: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp (without zone: UTC, see session.prepare)."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def millis(col: Column | str) -> Column:
    return F.unix_millis((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def holding(df: DataFrame, key: Sequence[str] | str, by: str, cols: Sequence[str]) -> DataFrame:
    """The row that holds for each key: the one with the latest ``by``.

    Rows without a key are left out.  Ties on ``by`` are settled by the
    greatest remaining values in the order of ``cols``, so the result does not
    depend on file order.  It is an aggregate: copies are combined before the
    shuffle and a key with a third of all rows costs no more than another.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [by, *(c for c in cols if c not in keys and c != by)]
    out = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_held"))
    return out.select(*keys, *(F.col(f"_held.{c}").alias(c) for c in rest))
