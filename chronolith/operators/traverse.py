"""Traversal and graph measures.

Loops run on the driver, one job a round; what a round leaves is written to the
shared folder (reliable checkpoint), so lineage stays short and a lost executor
costs a re-read, not a re-run.  All per-node steps are aggregates or joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.errors import EngineError, within
from chronolith.model import POSITIVE, Graph, having
from chronolith.operators.algebra import edge_filter, node_valid
from chronolith.session import checkpointed, written

MAX_HOPS, MAX_SEEDS, MAX_RESULT = 16, 1000, 200_000


def expand(
    g: Graph, seeds: DataFrame, hops: int, direction: str = "out", predicates: Sequence[str] | None = None,
    valid_at: int | None = None, limit: int | None = None, max_seeds: int = MAX_SEEDS,
) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Exact k-hop reach: (nodes (id, hop), edges, diagnostics).

    Every node within ``hops`` of a visible seed, with its least hop, and every
    matching edge that leaves a node less than ``hops`` away, also to nodes met
    before.  With ``valid_at``, seeds, nodes on the way and both ends of every edge
    must be valid then, as in query().  A seed that is not in the graph gives
    E_SEED_UNAVAILABLE and a partial answer: hidden and missing look alike.
    More than ``max_seeds`` seeds, or more nodes and edges than ``limit`` (None: any
    number), is E_BUDGET.

    A hop reads the edges once and writes those it follows, so that the answer
    is put together without reading them again.
    """
    if not 1 <= hops <= MAX_HOPS:
        raise EngineError("E_HOPS", f"1 to {MAX_HOPS}")
    steps = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}.get(direction)
    if steps is None:
        raise EngineError("E_DIRECTION", direction)
    if limit is not None and not 1 <= limit <= MAX_RESULT:
        raise EngineError("E_LIMIT", f"1 to {MAX_RESULT}")
    edges = g.edges.where(edge_filter(valid_at=valid_at))
    if predicates is not None:
        edges = edges.where(F.col("predicate").isin(*predicates))
    here = F.lit(True) if valid_at is None else F.coalesce(node_valid(valid_at), F.lit(False))
    known = g.nodes.groupBy("id").agg(F.max(here).alias("_alive"))
    alive = known.where("_alive").select("id")
    asked = written(within(seeds.select("id").distinct(), max_seeds).join(known, "id", "left"), "seeds")
    lost = () if asked.where("_alive IS NULL").isEmpty() else ("E_SEED_UNAVAILABLE",)
    frontier = asked.where("_alive").select("id", F.lit(0).alias("hop"))
    seen, found = frontier, []
    for hop in range(1, hops + 1):
        legs = None
        for near in steps:
            far = "dst" if near == "src" else "src"
            leg = having(edges, near, frontier).withColumn("_next", F.col(far))
            legs = leg if legs is None else legs.unionAll(leg)
        legs = written(legs, "legs")
        met = having(legs.select(F.col("_next").alias("id")).distinct(), "id", alive)
        before = seen.select("id", F.lit(False).alias("_new"))
        reached = written(met.join(before, "id", "left").select("id", F.coalesce("_new", F.lit(True)).alias("_new")), "reached")
        found.append(having(legs, "_next", reached).drop("_next"))
        frontier = reached.where("_new").select("id", F.lit(hop).alias("hop"))
        seen = seen.unionAll(frontier)
        if hop < hops and frontier.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    out = out.dropDuplicates(["id"])
    if limit is not None:
        within(seen.select("id").unionAll(out.select("id")), limit)
    return seen, out, lost


def topology(g: Graph, valid_at: int | None = None) -> DataFrame:
    """(src, dst) of positive edges; parallel edges stay."""
    return g.edges.where(edge_filter(valid_at=valid_at) & (F.col("polarity") == POSITIVE)).select("src", "dst")


def degree(g: Graph, valid_at: int | None = None) -> DataFrame:
    """(id, in_degree, out_degree, degree) of all nodes; a loop counts once each way, isolated nodes 0."""
    e = topology(g, valid_at)
    row = lambda df, col, i, o, n: df.select(F.col(col).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"), F.lit(n).alias("n"))
    ends = row(e, "src", 0, 1, 0).unionAll(row(e, "dst", 1, 0, 0)).unionAll(row(g.nodes, "id", 0, 0, 1))
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.max("n").alias("n"))
    return d.where("n > 0").select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


def weak_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): the least id reachable over edges either way.

    Each round takes the least label of a node and its neighbours and then
    jumps to that label's own label, so rounds grow with the logarithm of the
    diameter.  The least label of a hot node is combined before the shuffle.
    """
    both = checkpointed(edges.select(
        F.col("src").alias("a"), F.col("dst").alias("b")
    ).unionAll(edges.select("dst", "src")).where("a <> b").distinct())
    label = checkpointed(nodes.select("id", F.col("id").alias("component")).distinct())
    for _ in range(max_rounds):
        near = both.join(label, both["b"] == label["id"]).select(F.col("a").alias("id"), "component")
        best = near.unionAll(label).groupBy("id").agg(F.min("component").alias("component"))
        # the label's own label, taken over members of the old component as well
        hook = label.join(best.withColumnRenamed("component", "low"), "id").groupBy("component").agg(F.min("low").alias("low"))
        up = hook.select(F.col("component").alias("_c"), "low")
        new = checkpointed(best.join(up, best["component"] == up["_c"], "left").select(
            "id", F.least("component", "low").alias("component")
        ))
        moved = new.join(label.withColumnRenamed("component", "was"), "id").where("component <> was").isEmpty()
        label = new
        if moved:
            return label
    raise EngineError("E_BUDGET", "components did not settle")


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component): the least id of each strongly connected component.

    Nodes without a way in or out are cut off first.  Then the least label runs
    forwards to a fixpoint; from each node that kept its own label the
    component is what reaches it backwards within the label.
    """
    left = checkpointed(nodes.select("id").distinct())
    e = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    done: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        while True:  # trim
            inner = left.join(
                e.select(F.col("src").alias("id")), "id", "left_semi"
            ).join(e.select(F.col("dst").alias("id")), "id", "left_semi")
            cut = checkpointed(left.join(inner, "id", "left_anti"))
            if cut.isEmpty():
                break
            done.append(cut.select("id", F.col("id").alias("component")))
            left = checkpointed(left.join(cut, "id", "left_anti"))
            e = checkpointed(e.join(
                left.select(F.col("id").alias("src")), "src", "left_semi"
            ).join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if left.isEmpty():
            break
        label = checkpointed(left.select("id", F.col("id").alias("c")))
        while True:
            got = e.join(label, e["src"] == label["id"]).select(F.col("dst").alias("id"), "c").unionAll(label).groupBy("id").agg(F.min("c").alias("c"))
            got = checkpointed(got)
            same = got.join(label.withColumnRenamed("c", "was"), "id").where("c <> was").isEmpty()
            label = got
            if same:
                break
        inside = checkpointed(e.join(
            label.select(F.col("id").alias("src"), F.col("c").alias("c1")), "src"
        ).join(
            label.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst"
        ).where("c1 = c2").select("src", "dst", F.col("c1").alias("c")))
        reach = frontier = checkpointed(label.where("id = c"))
        while not frontier.isEmpty():
            back = inside.join(
                frontier.select(F.col("id").alias("dst"), "c"), ["dst", "c"]
            ).select(F.col("src").alias("id"), "c").distinct()
            frontier = checkpointed(back.join(reach.select("id"), "id", "left_anti"))
            reach = checkpointed(reach.unionAll(frontier))
        done.append(reach.select("id", F.col("c").alias("component")))
        left = checkpointed(left.join(reach.select("id"), "id", "left_anti"))
        e = checkpointed(e.join(
            left.select(F.col("id").alias("src")), "src", "left_semi"
        ).join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    else:
        raise EngineError("E_BUDGET", "components did not settle")
    out = done[0] if done else nodes.select("id", F.col("id").alias("component")).limit(0)
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the 0-based rank over the whole frame: range-partitioned sort, rank within, plus the offset of the
    partition.  Only one count a partition comes to the driver."""
    from pyspark.sql import Window

    s = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = {r["_p"]: r["count"] for r in s.groupBy("_p").count().collect()}
    offset, run = {}, 0
    for p in sorted(counts):
        offset[p], run = run, run + counts[p]
    at = F.create_map(*(F.lit(x) for kv in offset.items() for x in kv)) if offset else F.create_map(F.lit(0), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return s.withColumn(name, (inner + at[F.col("_p")]).cast("long")).drop("_p")


def shortest_paths(nodes: DataFrame, edges: DataFrame, source: str, directed: bool = True, max_levels: int = 1000) -> DataFrame:
    """(id, distance, predecessor) of all nodes reached from ``source``.

    The predecessor is the one that a queue filled in order of ids would find
    first: of the parents on the level before, the one discovered earliest.
    Discovery order is carried as a rank per level.
    """
    e = edges.select("src", "dst").distinct()
    if not directed:
        e = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = checkpointed(e)
    frontier = checkpointed(nodes.where(F.col("id") == source).select(
        "id", F.lit(0).cast("long").alias("distance"), F.lit(None).cast("string").alias("predecessor"),
        F.lit(0).cast("long").alias("r")
    ).distinct())
    seen = frontier
    for level in range(1, max_levels + 1):
        step = e.join(
            frontier.select(F.col("id").alias("src"), F.col("r").alias("pr")), "src"
        ).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("pr", "src")).alias("b"))
        new = step.join(seen.select("id"), "id", "left_anti").select(
            "id", F.lit(level).cast("long").alias("distance"), F.col("b.src").alias("predecessor"),
            F.col("b.pr").alias("pr")
        )
        frontier = global_rank(new, ["pr", "id"], "r").drop("pr")
        frontier = checkpointed(frontier)
        if frontier.isEmpty():
            return seen.drop("r")
        seen = checkpointed(seen.unionAll(frontier.select(*seen.columns)))
    raise EngineError("E_BUDGET", "paths are too long")


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, max_iterations: int = 100
) -> tuple[DataFrame, dict]:
    """((id, score), {iterations, converged, residual}).

    Parallel edges weigh; what dangling nodes hold is spread evenly; stops when
    the sum of absolute changes is at most ``tolerance`` (0: run all rounds).
    A round writes the scores once and takes the residual and what dangling nodes
    hold from them in one pass.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("total"))
    ends = nodes.select("id").distinct().join(out.select(F.col("src").alias("id"), F.lit(False).alias("ends")), "id", "left")
    ids = written(ends.select("id", F.coalesce("ends", F.lit(True)).alias("ends")), "ids")
    n, hanging = ids.agg(F.count(F.lit(1)), F.sum(F.col("ends").cast("long"))).first()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("score")), {"iterations": 0, "converged": True, "residual": 0.0}
    w = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    links = written(w.join(out, "src").select("src", "dst", (F.col("k") / F.col("total")).alias("w")).repartition("src"), "links")
    rank, lost, residual = ids.withColumn("score", F.lit(1.0 / n)), hanging / n, float("inf")
    for i in range(1, max_iterations + 1):
        inflow = links.join(rank.select(F.col("id").alias("src"), "score"), "src")
        inflow = inflow.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("s"))
        score = F.lit((1 - damping) / n + damping * lost / n) + F.lit(damping) * F.coalesce("s", F.lit(0.0))
        new = rank.withColumnRenamed("score", "was").join(inflow, "id", "left").select("id", "ends", "was", score.alias("score"))
        new = written(new, "rank")
        moved = F.sum(F.abs(F.col("score") - F.col("was")))
        residual, lost = new.agg(moved, F.coalesce(F.sum(F.when(F.col("ends"), F.col("score"))), F.lit(0.0))).first()
        rank = new.select("id", "ends", "score")
        if tolerance and residual <= tolerance:
            return rank.select("id", "score"), {"iterations": i, "converged": True, "residual": residual}
    return rank.select("id", "score"), {"iterations": max_iterations, "converged": False, "residual": residual}
