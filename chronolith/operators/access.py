"""Reader visibility, applied at the scan before any operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.model import Graph
from chronolith.session import checkpointed


def may_read(clauses: Sequence[Sequence[str]], readers: str = "readers", groups: str | None = None) -> Column:
    """True if the record lists no readers (and no groups), or every clause names one that is listed.

    A clause holds the principal and the groups it belongs to; agents have one
    clause per owner, all of which must match.  Null lists count as empty.
    """
    listed = F.coalesce(F.col(readers), F.array().cast("array<string>"))
    if groups:
        listed = F.concat(listed, F.coalesce(F.col(groups), F.array().cast("array<string>")))
    ok = F.size(listed) == 0
    each = F.lit(True)
    for c in clauses:
        each = each & F.arrays_overlap(listed, F.array(*(F.lit(x) for x in c)).cast("array<string>"))
    return ok | F.coalesce(each, F.lit(False)) if clauses else ok


def visible(g: Graph, clauses: Sequence[Sequence[str]]) -> Graph:
    """What the caller may see: unreadable records go, then edges and attachments left dangling."""
    keep = lambda df: None if df is None else df.where(may_read(clauses))
    return g.with_(nodes=keep(g.nodes), edges=keep(g.edges), attachments=keep(g.attachments)).pruned()


def reader_list(col: Column | str) -> Column:
    """``;``-separated text as a sorted list without repeats and blanks; null and empty give an empty list."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def memberships(direct: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Transitive closure of (member, group): a member of a group is in the groups that one belongs to.

    Rounds double the distance covered, so depth d takes log2(d) of them; cycles end by themselves.
    """
    known = checkpointed(direct.select("member", "group").where("member IS NOT NULL AND group IS NOT NULL").distinct())
    n = known.count()
    for _ in range(max_rounds):
        hop = known.join(
            known.select(F.col("member").alias("group"), F.col("group").alias("above")), "group"
        ).select("member", F.col("above").alias("group"))
        known = checkpointed(known.unionAll(hop).distinct())
        if (m := known.count()) == n:
            return known
        n = m
    raise RuntimeError("E_BUDGET: group delegation is too deep")
