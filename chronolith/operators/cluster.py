"""Deterministic clustering by matching, and what is read off the hierarchy.

The greedy matching in sorted pair order equals repeatedly taking every pair
that is the least at both its ends, so a level is a few rounds of two
aggregates instead of one sequential pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.errors import EngineError
from chronolith.model import POSITIVE, Graph
from chronolith.operators.algebra import edge_filter
from chronolith.session import checkpointed


def greedy_matching(links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(a, b), a < b: the matching that a pass over all distinct pairs in sorted order would choose."""
    left = checkpointed(links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct())
    picked = left.limit(0)
    for _ in range(max_rounds):
        if left.isEmpty():
            return picked
        pair = F.struct("a", "b")
        ends = left.select(F.col("a").alias("n"), pair.alias("p")).unionAll(left.select("b", pair)).groupBy("n").agg(F.min("p").alias("p"))
        both = ends.groupBy("p").count().where("count = 2").select("p.a", "p.b")
        both = checkpointed(both)
        picked = checkpointed(picked.unionAll(both))
        used = both.select(F.explode(F.array("a", "b")).alias("n"))
        left = checkpointed(left.join(
            used.withColumnRenamed("n", "a"), "a", "left_anti"
        ).join(used.withColumnRenamed("n", "b"), "b", "left_anti").select("a", "b"))
    raise EngineError("E_BUDGET", "matching did not settle")


def hierarchy(nodes: DataFrame, links: DataFrame, levels: int) -> DataFrame:
    """(level, child, cluster) of a binary hierarchy: each level merges matched pairs of the one before.

    A cluster's name is a hash of its two members; unmatched members go on as they are."""
    owner = checkpointed(nodes.select("id", F.col("id").alias("cluster")).distinct())
    out = None
    for level in range(1, levels + 1):
        up = aggregate_links(owner, links).select(F.col("from_cluster").alias("src"), F.col("to_cluster").alias("dst"))
        pairs = greedy_matching(up)
        if pairs.isEmpty():
            break
        name = F.concat(F.lit("cluster:"), F.substring(F.sha2(F.concat_ws("|", F.lit(str(level)), "a", "b"), 256), 1, 16))
        member = pairs.select(name.alias("cluster"), F.explode(F.array("a", "b")).alias("child"))
        step = member.select(F.lit(level).alias("level"), "child", "cluster")
        out = step if out is None else out.unionAll(step)
        moved = owner.join(
            member.select(F.col("child").alias("_c"), F.col("cluster").alias("_up")), F.col("cluster") == F.col("_c"),
            "left"
        )
        owner = checkpointed(moved.select("id", F.coalesce("_up", "cluster").alias("cluster")))
    return out if out is not None else nodes.select(
        F.lit(0).alias("level"), F.col("id").alias("child"), F.col("id").alias("cluster")
    ).limit(0)


def aggregate_links(owner: DataFrame, links: DataFrame) -> DataFrame:
    """(from_cluster, to_cluster, n_links) between different clusters; owner: (id, cluster)."""
    a = owner.select(F.col("id").alias("src"), F.col("cluster").alias("from_cluster"))
    b = owner.select(F.col("id").alias("dst"), F.col("cluster").alias("to_cluster"))
    return links.join(a, "src").join(b, "dst").where("from_cluster <> to_cluster").groupBy("from_cluster", "to_cluster").agg(F.count(F.lit(1)).alias("n_links"))


def lineage(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, n_shared, change) of two clusterings (leaf, cluster): kept, split, merged, split_merge, retired, created."""
    j = before.select("leaf", F.col("cluster").alias("before")).join(after.select("leaf", F.col("cluster").alias("after")), "leaf", "full")
    n = j.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n_shared"))
    real = n.where("before IS NOT NULL AND after IS NOT NULL")
    outs = real.groupBy("before").agg(F.count(F.lit(1)).alias("n_after"))
    ins = real.groupBy("after").agg(F.count(F.lit(1)).alias("n_before"))
    x = n.join(outs, "before", "left").join(ins, "after", "left")
    change = F.when(F.col("after").isNull(), "retired").when(F.col("before").isNull(), "created").when(
        (F.col("n_after") > 1) & (F.col("n_before") > 1), "split_merge"
    ).when(F.col("n_after") > 1, "split").when(F.col("n_before") > 1, "merged").otherwise("kept")
    return x.select("before", "after", "n_shared", change.alias("change"))


def evidence(links: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of links in order of id (limit at most 256)."""
    if not 1 <= limit <= 256:
        raise EngineError("E_PAGE", str(limit))
    return links.orderBy("id").offset(offset).limit(limit)


def zoom(tree: DataFrame, cluster: str) -> DataFrame:
    """Direct members of a cluster."""
    return tree.where(F.col("cluster") == cluster).select("level", "child")


def clustered(g: Graph, predicate: str, levels: int, valid_at: int) -> Graph:
    """hierarchy() as a graph: a leaf for each node, a node for each cluster, and ``cluster:member`` edges that hold at
    ``valid_at``; ``cluster:frontier`` edges lead from the clustering to what stands on top.  Coverage is partial.

    Links are the positive edges of the predicate that hold then; nodes without links are leaves on top."""
    links = g.edges.where(edge_filter(predicate, valid_at=valid_at) & (F.col("polarity") == POSITIVE)).select("src", "dst")
    tree = checkpointed(hierarchy(g.nodes, links, levels))
    all_ = g.nodes.select("id").unionAll(tree.select("cluster")).distinct()
    top = all_.join(tree.select(F.col("child").alias("id")), "id", "left_anti")
    none, nobody = F.lit(None).cast("long"), F.array().cast("array<string>")
    made = lambda df, kind: df.select(
        "id", F.col("id").alias("entity_id"), F.lit("cluster").alias("space_id"), F.lit(kind).alias("type_id"),
        none.alias("valid_start"), none.alias("valid_end"), nobody.alias("readers")
    )
    manifest = g.nodes.sparkSession.createDataFrame([("cluster:manifest",)], "id string")
    clusters = tree.select(F.col("cluster").alias("id")).distinct()
    nodes = made(g.nodes.select("id").distinct(), "Leaf").unionAll(made(clusters, "Cluster")).unionAll(made(manifest, "Manifest"))
    pairs = tree.select(F.lit("cluster:member").alias("predicate"), F.col("cluster").alias("src"), F.col("child").alias("dst"))
    pairs = pairs.unionAll(top.select(F.lit("cluster:frontier"), F.lit("cluster:manifest"), "id"))
    edges = pairs.select(
        F.concat_ws("/", "predicate", "src", "dst").alias("id"), "predicate", "src", "dst", F.lit(valid_at).cast("long").alias("valid_start"), F.lit(valid_at + 1).cast("long").alias("valid_end"),
        F.lit(POSITIVE).alias("polarity"), F.lit(None).cast("string").alias("context"), nobody.alias("readers"),
    )
    return Graph(nodes, edges, None, "partial", ("I_CLUSTER_SCOPED",))
