"""Interval-aware path join, temporal relations, clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.model import ALL, POSITIVE, Graph
from chronolith.operators.algebra import same_context
from chronolith.operators.intervals import meet, overlap

RELATIONS = ("before", "meets", "overlaps", "within")


def relation(name: str, ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """before: left ends strictly before right starts; meets: at that instant; overlaps: an instant in
    common; within: left lies inside right, ends included.  An open left is never before and never meets."""
    if name == "before":
        return le.isNotNull() & (le < rs)
    if name == "meets":
        return le.isNotNull() & (le == rs)
    if name == "overlaps":
        return overlap(ls, le, rs, re)
    if name == "within":
        return (ls >= rs) & (re.isNull() | (le.isNotNull() & (le <= re)))
    raise ValueError(f"E_RELATION: {name}")


def _ends(g: Graph, edges: DataFrame, end: str, as_: str) -> DataFrame:
    n = g.nodes.select(F.col("id").alias(f"_{as_}"), F.col("entity_id").alias(f"{as_}_entity"), F.col("space_id").alias(f"{as_}_space"))
    return edges.join(n, F.col(end) == F.col(f"_{as_}")).drop(f"_{as_}")


def path_join(left: Graph, right: Graph, output_predicate: str) -> DataFrame:
    """Positive edges of left and right that meet in one manifestation (entity and space), while both hold.

    One row per pair: (left_id, right_id, predicate, src, dst, valid_start,
    valid_end), the interval being the intersection.  An equi-join with the
    overlap as residual, so no product of the sides; AQE splits a hot middle."""
    pos = F.col("polarity") == POSITIVE
    l = _ends(
        left,
        left.edges.where(pos).select(
            F.col("id").alias("left_id"), "src", F.col("dst").alias("_to"), F.col("valid_start").alias("ls"),
            F.col("valid_end").alias("le")
        ),
        "_to", "m"
    )
    r = _ends(
        right,
        right.edges.where(pos).select(
            F.col("id").alias("right_id"), F.col("src").alias("_from"), "dst", F.col("valid_start").alias("rs"),
            F.col("valid_end").alias("re")
        ),
        "_from", "m"
    )
    both = l.join(r, ["m_entity", "m_space"]).where(overlap(F.col("ls"), F.col("le"), F.col("rs"), F.col("re")))
    s, e = meet(F.col("ls"), F.col("le"), F.col("rs"), F.col("re"))
    return both.select(
        "left_id", "right_id", F.lit(output_predicate).alias("predicate"), "src", "dst", s.alias("valid_start"),
        e.alias("valid_end")
    )


def _pair_id(kind: str, *cols: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.concat_ws("\u0000", *cols), 256), 1, 32))


def _wrapped(g: Graph, edges: DataFrame, end: str) -> DataFrame:
    """Nodes of a graph as the ends of occurrences: each occurrence has its own, of the same entity and space."""
    real, own = F.col(f"_{end}"), F.col(end)
    of = edges.select(own.alias("_own"), real.alias("_real"))
    n = g.nodes.select(F.col("id").alias("_real"), *(c for c in g.nodes.columns if c != "id"))
    return of.join(n, "_real").select(F.col("_own").alias("id"), *(c for c in g.nodes.columns if c != "id"))


def _occurrences(pairs: DataFrame, left: Graph, right: Graph) -> Graph:
    """A graph of made edges (id, predicate, _src, _dst, times): positive, of default context, public, with wrapped ends."""
    same_context(left, right)
    ends = {"src": left, "dst": right}
    edges = pairs.select(
        "id", "predicate", *(F.concat(F.col("id"), F.lit(f"/{e}")).alias(e) for e in ends), "valid_start", "valid_end", F.lit(POSITIVE).alias("polarity"),
        F.lit(None if left.selection == ALL else left.selection).cast("string").alias("context"), F.array().cast("array<string>").alias("readers"),
        *(F.col(f"_{e}") for e in ends), *(["_in"] if "_in" in pairs.columns else []),
    )
    if "_in" in pairs.columns:  # both ends of an occurrence are of the side it comes from
        parts = [_wrapped(g, edges.where(F.col("_in") == side), e) for side, g in (("left", left), ("right", right)) for e in ends]
    else:
        parts = [_wrapped(g, edges, e) for e, g in ends.items()]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p, allowMissingColumns=True)
    coverage = "complete" if left.coverage == right.coverage == "complete" else "partial"
    return Graph(nodes.distinct(), edges.drop("_src", "_dst", "_in"), None, coverage, left.diagnostics + right.diagnostics, left.selection)


def joined(left: Graph, right: Graph, output_predicate: str) -> Graph:
    """path_join() as a graph that can be joined again: an edge for each pair, its ends wrapped, the middle left out."""
    p = path_join(left, right, output_predicate)
    return _occurrences(
        p.select(
            _pair_id("join", "left_id", "right_id").alias("id"), "predicate", F.col("src").alias("_src"),
            F.col("dst").alias("_dst"), "valid_start", "valid_end"
        ),
        left, right
    )


def sequenced(left: Graph, right: Graph, name: str, window: tuple[int, int]) -> Graph:
    """sequence() as a graph: two clipped edges for each pair, of their own predicates, with their own ends."""
    s = sequence(left, right, name, window)
    own = lambda g: g.edges.select(
        F.col("id").alias("edge_id"), "predicate", F.col("src").alias("_src"), F.col("dst").alias("_dst")
    )
    parts = [
        s.where(F.col("role") == role).join(own(g), "edge_id").withColumn("_in", F.lit(role)) for role,
        g in (("left", left), ("right", right))
    ]
    both = parts[0].unionByName(parts[1]).withColumn("id", _pair_id("sequence", "left_id", "right_id", "role"))
    return _occurrences(both, left, right)


def sequence(left: Graph, right: Graph, name: str, window: tuple[int, int]) -> DataFrame:
    """Pairs in a temporal relation, tested on the whole intervals; both must reach into the window.

    Two rows per pair, roles ``left`` and ``right``, each clipped to the window:
    (left_id, right_id, role, edge_id, valid_start, valid_end)."""
    lo, hi = F.lit(window[0]), F.lit(window[1])
    inside = overlap(F.col("valid_start"), F.col("valid_end"), lo, hi)
    pos = (F.col("polarity") == POSITIVE) & inside
    l = _ends(
        left,
        left.edges.where(pos).select(
            F.col("id").alias("left_id"), F.col("dst").alias("_to"), F.col("valid_start").alias("ls"),
            F.col("valid_end").alias("le")
        ),
        "_to", "m"
    )
    r = _ends(
        right,
        right.edges.where(pos).select(
            F.col("id").alias("right_id"), F.col("src").alias("_from"), F.col("valid_start").alias("rs"),
            F.col("valid_end").alias("re")
        ),
        "_from", "m"
    )
    both = l.join(r, ["m_entity", "m_space"]).where(relation(name, F.col("ls"), F.col("le"), F.col("rs"), F.col("re")))
    clip = lambda role, i, s, e: F.struct(
        F.lit(role).alias("role"), F.col(i).alias("edge_id"), F.greatest(F.col(s), lo).alias("valid_start"),
        F.least(F.col(e), hi).alias("valid_end")
    )
    return both.select(
        "left_id", "right_id",
        F.explode(F.array(clip("left", "left_id", "ls", "le"), clip("right", "right_id", "rs", "re"))).alias("o")
    ).select("left_id", "right_id", "o.*")


def window(g: Graph, start: int, end: int) -> Graph:
    """Edges (of either polarity) and attachments clipped to ``[start, end)``; empty ones go, all nodes stay."""
    def clip(df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        kept = df.where(overlap(F.col("valid_start"), F.col("valid_end"), F.lit(start), F.lit(end)))
        return kept.withColumn(
            "valid_start", F.greatest("valid_start", F.lit(start))
        ).withColumn("valid_end", F.least("valid_end", F.lit(end)))

    return g.with_(edges=clip(g.edges), attachments=clip(g.attachments))


def series_overlap(mounts: DataFrame, series: DataFrame, start: int, end: int) -> DataFrame:
    """Stretches of external series that a mount covers within a window: the meeting of three intervals.

    mounts (sensor_id, serial, valid_start, valid_end), series (sensor_id, series_id, s, e)."""
    j = mounts.join(series, "sensor_id").where(overlap(F.col("valid_start"), F.col("valid_end"), F.col("s"), F.col("e")))
    x = j.withColumn("lo", F.greatest("valid_start", "s", F.lit(start))).withColumn("hi", F.least("valid_end", "e", F.lit(end)))
    return x.where("lo < hi").select("series_id", "sensor_id", "serial", F.col("lo").alias("valid_start"), F.col("hi").alias("valid_end"))
