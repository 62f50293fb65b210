"""Counts that are released, described or explained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.errors import EngineError, within
from chronolith.model import Graph


def release_counts(nodes: DataFrame, by: list[str], min_k: int) -> DataFrame:
    """(by, n, released): distinct entities; n is null unless at least ``min_k``."""
    g = nodes.groupBy(*by).agg(F.countDistinct("entity_id").alias("_n"))
    return g.select(*by, F.when(F.col("_n") >= min_k, F.col("_n")).alias("n"), (F.col("_n") >= min_k).alias("released"))


MAX_PERSISTED = 10_000


def persisted(g: Graph, results: DataFrame, key: str, valid_at: int) -> Graph:
    """Results (id, value) of a computation over a graph as attachments of its nodes.

    Whoever may read them must have been able to read all that went in: they list
    the readers that every restricted input lists, or nobody at all if these share
    none (``-``, no one's name).  More than MAX_PERSISTED are E_BUDGET; an id that is
    no node is E_PROJECT_MEMBER."""
    within(results, MAX_PERSISTED)
    if not results.join(g.nodes.select("id"), "id", "left_anti").isEmpty():
        raise EngineError("E_PROJECT_MEMBER", "an id is not in the graph")
    listed = g.nodes.select("readers").unionAll(g.edges.select("readers")).where(F.size("readers") > 0)
    lists = listed.select(F.array_sort(F.array_distinct("readers")).alias("r")).withColumn("_one", F.lit(1))
    n = lists.count()
    shared = lists.select(F.explode("r").alias("who")).groupBy("who").count().where(F.col("count") == n).select("who").orderBy("who").limit(MAX_PERSISTED)
    names = [r["who"] for r in shared.collect()] if n else []
    readers = F.array(*(F.lit(x) for x in (names or (["-"] if n else [])))).cast("array<string>")
    made = results.select(
        F.concat_ws(":", F.lit(key), "id").alias("id"), F.lit("node").alias("host_kind"), F.col("id").alias("host_id"), F.lit(key).alias("key"),
        F.col("value").cast("string").alias("value"), F.lit(valid_at).cast("long").alias("valid_start"), F.lit(None).cast("long").alias("valid_end"), readers.alias("readers"),
    )
    return g.with_(attachments=made if g.attachments is None else g.attachments.unionByName(made, allowMissingColumns=True))


def release_audit(released: DataFrame, min_k: int, at: int, who: str) -> DataFrame:
    """What was told to whom: one row for each count asked for, released or not, without the count."""
    keys = [c for c in released.columns if c not in ("n", "released")]
    return released.select(
        F.lit(at).alias("asked_at"), F.lit(who).alias("principal"), F.lit(min_k).alias("min_k"),
        F.to_json(F.struct(*keys)).alias("key"), "released"
    )


def describe(g: Graph) -> DataFrame:
    """(what, name, n): visible nodes by type and space, edges by predicate, attachments by key."""
    parts = [
        (g.nodes, "type_id", "type"), (g.nodes, "space_id", "space"), (g.edges, "predicate", "predicate")
    ] + ([(g.attachments, "key", "attachment")] if g.attachments is not None else [])
    out = None
    for df, col, what in parts:
        x = df.groupBy(F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", "n")
        out = x if out is None else out.unionAll(x)
    return out


def import_report(plan: DataFrame) -> DataFrame:
    """(action, n) of a reconciled import."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def explain(derived: DataFrame, node_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Derivations as a graph: (nodes, edges).

    derived: (id, derivations array<struct<premises array<string>>>), OR over
    derivations, AND over premises.  Conclusion -alternative-> derivation
    -joint_premise-> premise; each premise is a node of its derivation."""
    alt = derived.select(F.col(node_id).alias("c"), F.posexplode("derivations").alias("i", "d"))
    d_id = F.concat_ws("/", "c", F.concat(F.lit("d"), F.col("i")))
    prem = alt.select(
        "c", d_id.alias("did"), F.posexplode("d.premises").alias("j", "premise")
    ).withColumn("pid", F.concat_ws("/", "did", F.concat(F.lit("p"), F.col("j"))))
    nodes = derived.select(
        F.col(node_id).alias("id"), F.lit("conclusion").alias("kind"), F.col(node_id).alias("refers_to")
    ).unionAll(alt.select(d_id, F.lit("derivation"), F.col("c"))).unionAll(prem.select("pid", F.lit("premise"), "premise"))
    edges = alt.select(
        F.col("c").alias("src"), d_id.alias("dst"), F.lit("alternative").alias("predicate")
    ).unionAll(prem.select("did", "pid", F.lit("joint_premise")))
    return nodes, edges


def assertions_of(edges: DataFrame, by: list[str]) -> DataFrame:
    """Distinct sources of the edges, gathered per key as a sorted array (keys are expected to be of bounded size)."""
    return edges.groupBy(*by).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def conjunction(a, b):
    """AND of two OR-of-AND carriers (array<array<string>>): every union of one group of each, canonical."""
    return canonical(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_union(x, y)))))


def disjunction(a, b):
    """OR of two carriers, canonical."""
    return canonical(F.concat(a, b))


def canonical(c):
    """Sorted groups, sorted, without repeats and without groups that contain another."""
    s = F.array_sort(F.array_distinct(F.transform(c, lambda g: F.array_sort(F.array_distinct(g)))))
    return F.filter(s, lambda g: ~F.exists(s, lambda h: (h != g) & (F.size(F.array_except(h, g)) == 0)))
