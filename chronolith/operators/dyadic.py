"""Interval stabbing by equi-join over dyadic nodes.

The axis is cut into leaves of ``2**leaf_bits`` units; node (k, i) spans
``2**k`` leaves.  An interval is the disjoint union of at most two nodes a
level, a point lies in exactly one node a level, so "which intervals contain
this point" is an equi-join on node keys: linear, without a range condition in
the join, and one hot key is spread over its nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leaves of about 72 minutes on a microsecond axis, from 1970 to 2255.
LEAF_BITS, LEVELS = 32, 21
OPEN = 2**63 - 1


def leaf(point: Column, leaf_bits: int = LEAF_BITS, levels: int = LEVELS) -> Column:
    """Leaf of a point; what lies outside the axis goes to its first or last leaf."""
    at = F.shiftright(point, leaf_bits) if leaf_bits else point
    return F.least(F.greatest(at, F.lit(0).cast("long")), F.lit(2**levels - 1).cast("long"))


def _code(level: Column, index: Column, levels: int) -> Column:
    """Heap number of node ``index`` on ``level``: unique over all levels."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(levels) - level) + index


def interval_nodes(lo: Column, hi: Column, leaf_bits: int = LEAF_BITS, levels: int = LEVELS) -> Column:
    """Node keys whose disjoint union covers the leaves of ``[lo, hi)``; hi = OPEN for no end.

    Nodes at the rim may reach beyond the interval by part of a leaf: keep the
    exact test ``lo <= p AND p < hi`` after the join.
    """
    a, b = leaf(lo, leaf_bits, levels), leaf(hi - F.lit(1), leaf_bits, levels) + F.lit(1)

    def at(k: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        left = F.call_function("shiftright", a + one - F.lit(1), k)
        right = F.call_function("shiftright", b, k)
        some = left < right
        return F.array(
            F.when(some & (left.bitwiseAND(F.lit(1).cast("long")) == 1), _code(k, left, levels)),
            F.when(some & (right.bitwiseAND(F.lit(1).cast("long")) == 1), _code(k, right - F.lit(1), levels)),
        )

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda x: x.isNotNull())


def point_nodes(point: Column, leaf_bits: int = LEAF_BITS, levels: int = LEVELS) -> Column:
    """Keys of all nodes that enclose a point, one a level."""
    at = leaf(point, leaf_bits, levels)
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: _code(k, F.call_function("shiftright", at, k), levels))


def cover_nodes(lo: Column, hi: Column, steps: Sequence[int], leaf_bits: int = LEAF_BITS, levels: int = LEVELS) -> Column:
    """Keys of the one or two nodes that enclose ``[lo, hi)`` on the lowest level of ``steps`` whose nodes are as long.

    They reach beyond the interval, by no more than a few times its length: keep
    the exact test after the join.  A point lies in at most one of them, so an
    interval is met once.  ``steps`` ascends and ends with ``levels``.
    """
    a, b = leaf(lo, leaf_bits, levels), leaf(hi - F.lit(1), leaf_bits, levels)
    k = F.lit(steps[-1])
    for step in reversed(steps[:-1]):
        k = F.when(b - a < F.lit(2**step), F.lit(step)).otherwise(k)
    at = lambda x: _code(k, F.call_function("shiftright", x, k), levels)
    return F.array_distinct(F.array(at(a), at(b)))


def step_nodes(point: Column, steps: Sequence[int], leaf_bits: int = LEAF_BITS, levels: int = LEVELS) -> Column:
    """Keys of the nodes that enclose a point, on the levels of ``steps``."""
    at = leaf(point, leaf_bits, levels)
    return F.array(*(_code(F.lit(k), F.shiftright(at, k), levels) for k in steps))
