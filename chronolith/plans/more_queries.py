"""Queries of graph values, recorded states, imports, views and programs over whole test tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.refs import millis
from chronolith.functions.splitmix import splitmix64
from chronolith.model import Graph
from chronolith.operators import accepted, algebra, cluster, facts, rules, temporal, vectors
from chronolith.plans import program
from chronolith.session import scratch
from chronolith.sources.formats import node_rows
from chronolith.sources.graphs import fleet, star, unit_changes as changes_of_units
from chronolith.sources.tables import table
from chronolith.streaming.views import Views

V1, T1, T2 = 803_347_200_000, 1_704_067_200_000, 1_735_689_600_000


def _part(g: Graph, predicate: str) -> Graph:
    return g.with_(edges=g.edges.where(F.col("predicate") == predicate))


# the algebra over graphs ----------------------------------------------------------------------


def join_nested(spark: SparkSession, d: str) -> DataFrame:
    """Orders to nations to regions: a join of a join, with the entities of its ends."""
    g = star(spark, d)
    both = temporal.joined(_part(g, "placed_by"), _part(g, "in_nation"), "ordered_from")
    far = temporal.joined(both, _part(g, "in_region"), "ordered_in")
    n = far.nodes.select("id", "entity_id")
    e = far.edges.join(n.select(F.col("id").alias("src"), F.col("entity_id").alias("order")), "src")
    return e.join(
        n.select(F.col("id").alias("dst"), F.col("entity_id").alias("region")), "dst"
    ).select("order", "region", "predicate", "valid_start", "valid_end")


def sequence_graph(spark: SparkSession, d: str) -> DataFrame:
    """Installs that overlap a firmware, as clipped edges between their own ends: how many of each predicate and entity."""
    g = fleet(spark, d)
    s = temporal.sequenced(_part(g, "installed_in"), _part(g, "runs"), "overlaps", (T1, T2))
    ends = s.nodes.select(F.col("id").alias("src"), "entity_id")
    return s.edges.join(ends, "src").groupBy("predicate", "entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("valid_start").alias("first")
    )


def sequence_touching(spark: SparkSession, d: str) -> DataFrame:
    """Successive stretches of a unit's firmware that meet: each install ends, here, where the next one begins."""
    e = fleet(spark, d).edges.where("predicate = 'runs'").select("id", "src", "dst", "valid_start", "polarity")
    nxt = e.groupBy("src", "valid_start").agg(F.min("id").alias("id"))
    later = nxt.select(F.col("src").alias("u"), F.col("valid_start").alias("v"))
    cut = nxt.join(
        later, (F.col("src") == F.col("u")) & (F.col("v") > F.col("valid_start"))
    ).groupBy("id").agg(F.min("v").alias("valid_end"))
    kept = e.drop("dst").join(nxt.select("id"), "id").join(cut, "id", "left")
    line = kept.select(
        "id", F.lit("era").alias("predicate"), F.col("src"), F.col("src").alias("dst"), "valid_start", "valid_end",
        "polarity"
    )
    ends = line.select(F.col("src").alias("id")).distinct()
    nodes = ends.select("id", F.col("id").alias("entity_id"), F.lit("fleet").alias("space_id"))
    g = Graph(nodes, line)
    return temporal.sequence(g, g, "meets", (0, 4_102_444_800_000)).select(
        "left_id", "right_id", "role", "edge_id", "valid_start", "valid_end"
    )


def diff_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Changed members of the fleet between two recorded states, as attachments on the union."""
    def ids(at: int) -> Graph:
        g = fleet(spark, d, recorded_by=at)
        e = g.edges.select(
            "id", "predicate", "src", "dst", F.lit(0).cast("long").alias("valid_start"),
            F.lit(None).cast("long").alias("valid_end")
        )
        return Graph(g.nodes, e)

    x = algebra.diff_graph(ids(T1), ids(T2))
    return x.attachments.groupBy("host_kind", "value").agg(F.count(F.lit(1)).alias("n"))


def union_by_origin(spark: SparkSession, d: str) -> DataFrame:
    """Customers under two names, told by where they come from: each once, under the lesser name."""
    n = star(spark, d).nodes.where("type_id = 'customer'").withColumn("origin", F.col("id"))
    other = n.withColumn("id", F.concat(F.lit("alias:"), "id"))
    e = star(spark, d).edges.limit(0).withColumn("origin", F.lit(None).cast("string"))
    return algebra.union(Graph(n, e), Graph(other, e)).nodes.select("id", "entity_id")


def support_states(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts as a graph: states of claims, and how many proofs they have."""
    g = algebra.support_graph(star(spark, d).edges.where("predicate = 'contains'"), ["predicate", "dst"], V1)
    proofs = g.edges.groupBy(F.col("dst").alias("host_id")).agg(F.count(F.lit(1)).alias("k"))
    x = g.attachments.join(proofs, "host_id", "left")
    return x.groupBy(F.col("value").alias("state")).agg(
        F.count(F.lit(1)).alias("n_claims"), F.sum(F.coalesce("k", F.lit(0))).alias("n_proofs")
    )


def reason_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph with derived edges beside the given ones."""
    A = rules.Atom
    g = star(spark, d)
    g = g.with_(edges=g.edges.where("predicate IN ('placed_by', 'in_nation')"))
    made = rules.reasoned(g, [rules.Rule(A("from", "?o", "?n"), (A("placed_by", "?o", "?c"), A("in_nation", "?c", "?n")))])
    return made.edges.groupBy("predicate", "polarity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def cluster_graph(spark: SparkSession, d: str) -> DataFrame:
    """Stars of customers and nations: at each level a nation can be merged with one customer only."""
    g = star(spark, d)
    g = g.with_(
        nodes=g.nodes.where("type_id IN ('customer', 'nation')"),
        edges=g.edges.where("predicate = 'in_nation' AND src LIKE 'customer:%'")
    )
    c = cluster.clustered(g, "in_nation", 2, V1)
    return c.edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).unionAll(c.nodes.groupBy("type_id").agg(F.count(F.lit(1)).alias("n")))


def metadata_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Orders, customers, nations and regions as graphs that refer to each other: all that finished orders reach."""
    e = star(spark, d).edges.where("predicate IN ('placed_by', 'in_nation', 'in_region')")
    start = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(
        F.lit("order:"), F.col("o_orderkey").cast("string")
    ).alias("graph_id"))
    refs = e.select(F.col("src").alias("graph_id"), F.col("dst").alias("ref_graph"))
    return algebra.metadata_closure(refs, start, 2, max_graphs=10_000_000).withColumn("depth", F.col("depth").cast("long"))


# recorded states and the log ------------------------------------------------------------------


def unit_changes(spark: SparkSession, d: str) -> DataFrame:
    """Edges of every unit that were added, removed or corrected between two recorded times."""
    return changes_of_units(fleet(spark, d, recorded_by=T1), fleet(spark, d, recorded_by=T2)).where("kind = 'edge'")


def facts_selected(spark: SparkSession, d: str) -> DataFrame:
    """Edges valid at a time and recorded in a range, by the key columns of the log."""
    x = facts.selected(table(spark, d, "fact_log"), kind="edge", valid_at=T1, recorded=(T1 - 10**10, T2))
    return x.select("line", "position", "id", "predicate").distinct()


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events (revisions) and operations of each graph's log."""
    return table(spark, d, "fact_log").groupBy("graph_id").agg(
        F.countDistinct("line", "seq").alias("n_events"), F.countDistinct("line", "position").alias("n_operations")
    )


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sync_runs").where("run_id IS NOT NULL AND logged_at IS NOT NULL").distinct()
    ok = F.coalesce(F.lower(F.trim("run_status")) == "succeeded", F.lit(False))
    return t.select(
        "feed", F.coalesce("scope", F.lit("")).alias("scope"), millis("logged_at").alias("decided_at"),
        F.col("run_id").alias("decision_id"), F.col("upto_pos").alias("revision"), ok.alias("accepted")
    )


def accepted_latest(spark: SparkSession, d: str) -> DataFrame:
    return accepted.accepted_at(_decisions(spark, d), ["feed", "scope"])


def accepted_as_of(spark: SparkSession, d: str) -> DataFrame:
    return accepted.accepted_at(_decisions(spark, d), ["feed", "scope"], T2)


def accepted_range(spark: SparkSession, d: str) -> DataFrame:
    return accepted.accepted_range(_decisions(spark, d), ["feed", "scope"], T1, T2)


def import_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers and their edges imported into a store, imported again, put right, and partly taken out by a snapshot."""
    st = facts.FactStore(spark, scratch(spark, "store"))
    g = star(spark, d)
    content = F.to_json(F.struct("type_id", F.size("readers").alias("n_readers")))
    nodes = g.nodes.where("type_id IN ('customer', 'nation')").select(F.lit("node").alias("kind"), "id", content.alias("content"))
    edges = g.edges.where("predicate = 'in_nation' AND src LIKE 'customer:%'").select(
        F.lit("edge").alias("kind"), "id", F.to_json(F.struct("src", "dst")).alias("content")
    )
    most = 10_000_000
    first = facts.imported(st, nodes.unionAll(edges), chunk=most)
    again = facts.imported(st, nodes.unionAll(edges), chunk=most)
    right = nodes.where("id LIKE 'customer:%7'").withColumn("content", F.lit("corrected"))
    facts.imported(st, right, chunk=most)
    floor = st.head()
    st.checkpoint()
    left = st.state().where("NOT (id LIKE 'in_nation:customer:%5')")
    st.commit(left, expected=floor, max_changes=most)
    st.compact(floor)
    told = json.dumps({"first": first["assert"], "again": again["commits"]})
    return st.state().groupBy(
        "kind", F.when(F.col("content") == "corrected", "corrected").otherwise("as given").alias("content")
    ).agg(F.count(F.lit(1)).alias("n")).withColumn("told", F.lit(told))


def node_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Work orders as nodes with their cells as properties."""
    m = table(spark, d, "maintenance").select(
        "work_order", "kind", "performed_by", F.col("started_at").cast("string").alias("started_at"), "readers"
    )
    n = node_rows(m, "work_order", "work_order", "fleet", ["kind", "performed_by"], "started_at")
    return n.select(
        "id", "valid_start", F.size("properties").cast("long").alias("n_properties"),
        F.col("properties")["kind"].alias("kind")
    ).distinct()


# views, programs, vectors ----------------------------------------------------------------------


def view_generations(spark: SparkSession, d: str) -> DataFrame:
    """What each generation of a live view changed: firmware in force at the view's tick, at three ticks."""
    g = fleet(spark, d)
    live = lambda tick: g.edges.where(algebra.edge_filter("runs", valid_at=tick)).select(
        F.col("src").alias("id"), F.concat_ws(">", "dst", "id").alias("content")
    ).groupBy("id").agg(F.max("content").alias("content"))
    v = Views(spark, scratch(spark, "views"))
    v.register("runs", live, ["fleet"])
    out = None
    for i, tick in enumerate((T1, (T1 + T2) // 2, T2)):
        v.drain([("fleet", i)], tick, {"fleet": i})
        part = v.changes("runs").groupBy("change").agg(F.count(F.lit(1)).alias("n")).withColumn("generation", F.lit(i + 1))
        out = part if out is None else out.unionAll(part)
    return out


def program_nested(spark: SparkSession, d: str) -> DataFrame:
    """A program: what is joined from two filters of a bound graph, clipped, and united with a mounted graph's edges."""
    cat = program.Catalog(spark, {"star": lambda at: star(spark, d)}, mounts={"shop": ("star", None)}, clauses=[["alice"]])
    b = program.build
    whole = b["reference"](name="whole")
    joined = b["join"](
        left=b["filter"](input=whole, predicate="placed_by"), right=b["filter"](input=whole, predicate="in_nation"),
        output_predicate="ordered_from"
    )
    clipped = b["window"](input=joined, start=V1 - 10**10, end=V1)
    text = [
        program.bind("whole", b["query"](graph_id="star")),
        program.ask(b["union"](left=clipped, right=b["query_mount"](mount="shop", predicate="in_region")))
    ]
    g = program.run(text, cat)[0]
    return g.edges.groupBy("predicate").agg(
        F.count(F.lit(1)).alias("n"), F.min("valid_start").alias("first"), F.max("valid_end").alias("last")
    )


def _emb(spark: SparkSession, d: str) -> DataFrame:
    lo = (F.col("vec_id") % 50).cast("long")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", lo.alias("valid_start"),
        F.when(F.col("vec_id") % 7 != 0, lo + 20).alias("valid_end")
    )


def nearest_valid(spark: SparkSession, d: str) -> DataFrame:
    """By an embedding, without its own subject's (label), among those that hold at a time."""
    x = vectors.nearest(_emb(spark, d), None, 10, of=10, subject="label", valid_at=12)
    return x.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """By a vector property in one space, of vectors scaled before they are normed."""
    n = table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("vec_id").cast("string").alias("entity_id"),
        F.concat(F.lit("s"), F.col("label") % 2).alias("space_id"), "embedding"
    )
    q = table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]
    return vectors.nearest_vectors(n, q, 10, "s1", vec="embedding").select("id", "space_id", F.round("distance", 6).alias("distance"))


def similar_valid(spark: SparkSession, d: str) -> DataFrame:
    """k nearest targets of another subject with overlapping valid time, of the sources id % 100 = 0."""
    v = _emb(spark, d)
    hits = vectors.knn(v, v.where("id % 100 = 0"), 5, subject="label", valid=("valid_start", "valid_end"))
    return vectors.similar_candidates(hits, 0.95).select("low", "high", F.round("score", 6).alias("score"))


def splitmix_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a seeded stream for every part."""
    return table(spark, d, "part").select("p_partkey", splitmix64(F.col("p_partkey"), 42).alias("number"))


QUERIES = {f.__name__: f for f in (
    join_nested, sequence_graph, sequence_touching, diff_attachments, union_by_origin, support_states, reason_graph, cluster_graph, metadata_graphs,
    unit_changes, facts_selected, event_counts, accepted_latest, accepted_as_of, accepted_range, import_round_trip, node_mapping,
    view_generations, program_nested, nearest_valid, nearest_vectors, similar_valid, splitmix_numbers,
)}
