"""The graph engine's operators over whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import exact
from chronolith.functions.refs import millis, reference
from chronolith.functions.times import text_millis
from chronolith.model import POSITIVE, Graph
from chronolith.operators import access, algebra, cluster, facts, release, rules, temporal, traverse, vectors
from chronolith.operators.intervals import contains
from chronolith.plans.problems import _replacement_links
from chronolith.session import written
from chronolith.sources.graphs import fleet, heads, star
from chronolith.sources.tables import table
from chronolith.streaming import changes as cdc
from chronolith.streaming import feed

#: 1995-06-17 and 1996-06-17 on the star schema; 2024-01-01 and 2025-01-01 on the fleet.
V1, V2 = 803_347_200_000, 834_969_600_000
T1, T2 = 1_704_067_200_000, 1_735_689_600_000


def _members(g: Graph) -> DataFrame:
    return g.nodes.select(F.lit("node").alias("kind"), "id").unionAll(g.edges.select(F.lit("edge"), "id"))


def _counts(g: Graph) -> DataFrame:
    n = g.nodes.groupBy("type_id").count().select(F.lit("node").alias("kind"), F.col("type_id").alias("name"), F.col("count").alias("n"))
    return n.unionAll(g.edges.groupBy("predicate").count().select(F.lit("edge"), "predicate", "count"))


def query_all(spark: SparkSession, d: str) -> DataFrame:
    return _counts(algebra.query(star(spark, d)))


def query_predicate(spark: SparkSession, d: str) -> DataFrame:
    return _members(algebra.query(star(spark, d), predicate="in_nation"))


def query_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return _members(algebra.query(star(spark, d), predicate="in_nation", dst="nation:3"))


def query_valid_at(spark: SparkSession, d: str) -> DataFrame:
    return _counts(algebra.query(star(spark, d), valid_at=V1))


def query_visible(spark: SparkSession, d: str) -> DataFrame:
    return _counts(access.visible(star(spark, d), [["bob"]]))


def query_visible_two_clauses(spark: SparkSession, d: str) -> DataFrame:
    return _counts(access.visible(fleet(spark, d), [["ops-lead", "yard"], ["night-crew"]]))


def filter_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return _members(algebra.filter_graph(star(spark, d), predicate="placed_by", valid_at=V1))


def filter_keeps_timed(spark: SparkSession, d: str) -> DataFrame:
    return _counts(algebra.filter_graph(star(spark, d), valid_at=V1))


def project_members(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d)
    return _members(algebra.project(
        g, g.nodes.where("type_id = 'region'").select("id"),
        g.edges.where("predicate = 'in_nation' AND src LIKE 'supplier:%'").select("id")
    ))


def context_default(spark: SparkSession, d: str) -> DataFrame:
    return algebra.context(star(spark, d), None).edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def context_open(spark: SparkSession, d: str) -> DataFrame:
    return algebra.context(star(spark, d), "open").edges.select("id", "polarity")


def counterparts_bridge(spark: SparkSession, d: str) -> DataFrame:
    return algebra.bridges(star(spark, d), "same_entity")


def counterparts_entity(spark: SparkSession, d: str) -> DataFrame:
    return _members(algebra.counterparts(star(spark, d), "supplier:7", "biz", "geo", V1))


def resolve_identity(spark: SparkSession, d: str) -> DataFrame:
    n = star(spark, d).nodes.where("type_id = 'supplier'")
    parts = n.select(
        F.lit("accepted").alias("mapping"), F.col("entity_id").alias("partition_id"), F.col("id").alias("node_id"),
        "space_id", F.lit(0).cast("long").alias("valid_start"), F.lit(None).cast("long").alias("valid_end")
    )
    return algebra.resolve_identity(parts, n.where("space_id = 'biz'").select("id"), "geo", V1)


def support_verdict(spark: SparkSession, d: str) -> DataFrame:
    e = star(spark, d).edges.where("predicate = 'contains'")
    return algebra.support(e, ["predicate", "dst"], V1)


def assertion_join(spark: SparkSession, d: str) -> DataFrame:
    """Explicit profile: one structure per (order, part), one assertion per line."""
    e = star(spark, d).edges.where("predicate = 'contains'")
    key = F.concat_ws(">", "src", "dst")
    structures = e.groupBy("predicate", "src", "dst").agg(F.first(key).alias("id"))
    said = e.select(
        "id", key.alias("edge_id"), "valid_start", "valid_end", "polarity", "context", "readers",
        F.lit("lines").alias("source")
    )
    return algebra.materialize(structures, said).groupBy("predicate", "polarity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("src", "dst").alias("n_structures")
    )


def union_origin(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d)
    return _members(algebra.union(algebra.query(g, predicate="in_nation"), algebra.query(g, predicate="in_region")))


def diff_membership(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d)
    return algebra.diff(
        algebra.query(g, valid_at=V1), algebra.query(g, valid_at=V2)
    ).groupBy("kind", "membership").agg(F.count(F.lit(1)).alias("n"))


def metadata_follow(spark: SparkSession, d: str) -> DataFrame:
    """A graph-valued attachment, clipped to the attachment's time."""
    g = fleet(spark, d)
    at = g.edges.where("predicate = 'runs'").agg(F.min("src")).select(
        F.lit("a").alias("id"), F.lit("node").alias("host_kind"), F.col("min(src)").alias("host_id"),
        F.lit("history").alias("key"), F.lit("runs").alias("value"), F.lit(T1).alias("valid_start"),
        F.lit(T2).alias("valid_end")
    )
    host = at.first()["host_id"]
    m = algebra.metadata(g.with_(attachments=at), "node", host, "history", g.edges.withColumn("graph_id", F.col("predicate")))
    return m.edges.select("id", "valid_start", "valid_end")


# recorded time --------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "retract").otherwise("assert")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), "user_id", op.alias("op"), millis("ts").alias("recorded_at_ms"),
        F.concat_ws("|", F.round("value", 4).cast("decimal(20,4)").cast("string"), "props").alias("content")
    )


def _events_at(spark: SparkSession, d: str, share: float) -> DataFrame:
    e = _events(spark, d)
    lo, hi = e.agg(F.min("recorded_at_ms"), F.max("recorded_at_ms")).first()
    return facts.live(e, [], ["user_id"], ["recorded_at_ms", "seq"], ["content"], F.col("recorded_at_ms") <= int(lo + (hi - lo) * share))


def as_of_events(spark: SparkSession, d: str) -> DataFrame:
    return _events_at(spark, d, 0.5)


def changes_events(spark: SparkSession, d: str) -> DataFrame:
    return facts.changes(_events_at(spark, d, 0.5), _events_at(spark, d, 0.75), ["user_id"])


def heads_as_of(spark: SparkSession, d: str) -> DataFrame:
    return facts.head_at(heads(spark, d), ["graph_id", "branch_id"], T1)


def recorded_range(spark: SparkSession, d: str) -> DataFrame:
    return facts.recorded_range(heads(spark, d), T1, T2, limit=10_000_000).select("graph_id", "branch_id", "line", "seq", "recorded_at_ms")


def recorded_history(spark: SparkSession, d: str) -> DataFrame:
    """The recorded range with the head of each branch that was in force when it began."""
    return facts.recorded_history(heads(spark, d), ["graph_id", "branch_id"], T1, T2, limit=10_000_000)


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fact_log").select("line", "kind", "id", "op", "seq", "position", "body").distinct()


def facts_at_revision(spark: SparkSession, d: str) -> DataFrame:
    return facts.live(_log(spark, d), ["line"], ["kind", "id"], ["position"], ["body"], F.col("seq") <= 20)


def changes_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Net changes between two revisions of every line; the log between them narrows the keys."""
    log = _log(spark, d)
    keys = ["line", "kind", "id"]
    some = log.join(facts.changed_keys(log, keys, 20, 40), keys, "left_semi")
    state = lambda s: facts.live(some, ["line"], ["kind", "id"], ["position"], ["body"], F.col("seq") <= s)
    return facts.changes(state(20), state(40), keys, "body")


def fact_versions(spark: SparkSession, d: str) -> DataFrame:
    return facts.versions(_log(spark, d), ["line", "kind", "id"]).select("line", "kind", "id", "position", "from_seq", "until_seq")


def reconcile_report(spark: SparkSession, d: str) -> DataFrame:
    """Planned import of the state at 3/4 over that at 1/2: what is asserted, corrected, unchanged."""
    return release.import_report(facts.reconcile(_events_at(spark, d, 0.5), _events_at(spark, d, 0.75), ["user_id"]))


# temporal joins -------------------------------------------------------------------------------


def path_join(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d)
    part = lambda p: g.with_(edges=g.edges.where(F.col("predicate") == p))
    return temporal.path_join(part("placed_by"), part("in_nation"), "ordered_from")


def path_join_fleet(spark: SparkSession, d: str) -> DataFrame:
    g = fleet(spark, d)
    part = lambda p: g.with_(edges=g.edges.where(F.col("predicate") == p))
    return temporal.path_join(part("installed_in"), part("runs"), "part_runs")


def _sequence(name: str):
    def q(spark: SparkSession, d: str) -> DataFrame:
        g = fleet(spark, d)
        part = lambda p: g.with_(edges=g.edges.where(F.col("predicate") == p))
        return temporal.sequence(part("installed_in"), part("runs"), name, (T1, T2))

    q.__name__ = f"sequence_{name}"
    return q


def window_clip(spark: SparkSession, d: str) -> DataFrame:
    return temporal.window(fleet(spark, d), T1, T2).edges.select("id", "valid_start", "valid_end")


def window_attachments(spark: SparkSession, d: str) -> DataFrame:
    return temporal.window(fleet(spark, d), T1, T2).attachments.select("id", "host_id", "valid_start", "valid_end")


def series_overlap(spark: SparkSession, d: str) -> DataFrame:
    m = fleet(spark, d).edges.where("predicate = 'measured_by'").select(
        F.col("dst").alias("sensor_id"), F.col("src").alias("serial"), "valid_start", "valid_end"
    )
    s = table(spark, d, "sensors").groupBy(F.concat(
        F.lit("sensor:"), reference("sensor_id")
    ).alias("sensor_id")).agg(F.min(millis("recorded_at")).alias("s")).select(
        "sensor_id", F.concat(F.lit("series:"), "sensor_id").alias("series_id"), "s",
        (F.col("s") + 365 * 86_400_000).alias("e")
    )
    return temporal.series_overlap(m, s, T1, T2)


def units_running_with_sensor(spark: SparkSession, d: str) -> DataFrame:
    """Units that run some firmware and carry some sensor at a time, with both counts."""
    e = fleet(spark, d).edges.where(contains(F.col("valid_start"), F.col("valid_end"), F.lit(T1)))
    g = e.where("predicate IN ('runs', 'measured_by')").groupBy(F.col("src").alias("unit")).agg(
        F.count(F.when(F.col("predicate") == "runs", 1)).alias("n_firmware"),
        F.count(F.when(F.col("predicate") == "measured_by", 1)).alias("n_sensors")
    )
    return g.where("n_firmware > 0 AND n_sensors > 0")


# traversal and measures ------------------------------------------------------------------------


def _expand(direction: str, seed: str, at: int | None = V1):
    def q(spark: SparkSession, d: str) -> DataFrame:
        nodes, edges, _ = traverse.expand(star(spark, d), spark.createDataFrame([(seed,)], "id string"), 2, direction, valid_at=at)
        return nodes.select(
            F.lit("node").alias("kind"), "id", F.col("hop").cast("long").alias("hop")
        ).unionAll(edges.select(F.lit("edge"), "id", F.lit(-1).cast("long")))

    q.__name__ = f"expand_2hop_{direction}"
    return q


def expand_valid_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Orders hold for sixty days here, so at a time most of them, and the edges to them, can't be passed."""
    g = star(spark, d)
    ends = F.when(F.col("type_id") == "order", F.col("valid_start") + 60 * 86_400_000)
    g = g.with_(nodes=g.nodes.withColumn("valid_end", ends))
    seeds = spark.createDataFrame([("nation:3",)], "id string")
    nodes, edges, _ = traverse.expand(g, seeds, 2, "in", valid_at=V1)
    hops = nodes.select(F.lit("node").alias("kind"), "id", F.col("hop").cast("long").alias("hop"))
    return hops.unionAll(edges.select(F.lit("edge"), "id", F.lit(-1).cast("long")))


def expand_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid question: as a reader, what is within two hops of a seed at a time, and which embeddings among it are nearest."""
    g = access.visible(star(spark, d), [["alice"]])
    nodes, _, _ = traverse.expand(g, spark.createDataFrame([("nation:3",)], "id string"), 2, "in", valid_at=V1)
    emb = table(spark, d, "embeddings").select(
        F.concat(F.lit("customer:"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector")
    )
    q = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]
    return vectors.nearest(emb, q, 10, candidates=nodes).select(
        "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


def degree(spark: SparkSession, d: str) -> DataFrame:
    return traverse.degree(star(spark, d))


def _chains(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = written(_replacement_links(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst")), "chains")
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e


def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return traverse.weak_components(*_chains(spark, d))


def strong_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the links that run in circles (all others are single nodes)."""
    n, e = _chains(spark, d)
    c = traverse.strong_components(n, e)
    return c.join(c.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("id", "component")


def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    g = fleet(spark, d)
    e = written(traverse.topology(g), "topology")
    first = e.agg(F.min("src")).first()[0]
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return traverse.shortest_paths(nodes, e, first or "", directed=False).select("id", "distance")


def pagerank_fixed10(spark: SparkSession, d: str) -> DataFrame:
    e = written(traverse.topology(fleet(spark, d)), "topology")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return traverse.pagerank(nodes, e, tolerance=0, max_iterations=10)[0].select("id", F.round(F.col("score") * 1e6, 4).alias("score_ppm"))


# vectors and geometry --------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _nearest(metric: str):
    def q(spark: SparkSession, d: str) -> DataFrame:
        v = _vectors(spark, d)
        return vectors.nearest(v, v.where("id = 0").first()["vector"], 10, metric, exclude=0).select(
            "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
        )

    q.__name__ = f"nearest_{metric.split('_')[0]}"
    return q


def nearest_candidates(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return vectors.nearest(
        v, v.where("id = 0").first()["vector"], 10, candidates=v.where("label = 3").select("id"), exclude=0
    ).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def knn_search(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return vectors.knn(v, v.where("id % 100 = 0"), 5).select(
        "query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


def similar_candidates(spark: SparkSession, d: str) -> DataFrame:
    """k nearest first, then the score limit, then orientation, then without pairs of one label (linked)."""
    v = _vectors(spark, d)
    hits = vectors.knn(v, v.where("id % 100 = 0"), 5)
    lab = v.select("id", "label")
    ids = hits.select("query_id", "id").join(
        lab.select(F.col("id").alias("query_id"), F.col("label").alias("l1")), "query_id"
    ).join(lab, "id").where("l1 = label").select(F.col("query_id").alias("src"), F.col("id").alias("dst"))
    return vectors.similar_candidates(hits, 0.9, ids).select("low", "high", F.round("score", 6).alias("score"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    at = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit("lab").alias("frame"),
        F.when(F.col("label") % 2 == 0, "mm").otherwise("m").alias("unit"),
        F.when(F.col("label") == 1, "direction").otherwise("position").alias("role"), at.alias("value")
    )


def geometry_distance(spark: SparkSession, d: str) -> DataFrame:
    p = _positions(spark, d)
    moved = p.withColumn("unit", F.lit("m")).withColumn("value", F.transform("value", lambda x: x + 1.0))
    return vectors.geometry_distance(p, moved, "id").select("id", F.round("distance", 6).alias("distance"))


def geometry_transform(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.rigid_transform(F.col("value"), [[0, -1, 0], [1, 0, 0], [0, 0, 1]], [1.0, 2.0, 3.0], "mm", "m")
    return _positions(spark, d).select("id", out.alias("v")).select("id", *(F.round(F.col("v")[i], 9).alias(f"c{i}") for i in range(3)))


def geometry_axes(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.project_axes(F.transform("embedding", lambda x: x.cast("double")), (5, 0, 63))
    return table(spark, d, "embeddings").select("vec_id", out.alias("v")).select(
        "vec_id", *(F.round(F.col("v")[i], 6).alias(f"c{i}") for i in range(3))
    )


# rules, clusters, releases ----------------------------------------------------------------------


def reason_transitive(spark: SparkSession, d: str) -> DataFrame:
    A = rules.Atom
    rs = [
        rules.Rule(A("within", "?x", "?y"), (A("in_nation", "?x", "?y"),)),
        rules.Rule(A("within", "?x", "?y"), (A("in_region", "?x", "?y"),)),
        rules.Rule(A("within", "?x", "?y"), (A("placed_by", "?x", "?y"),)),
        rules.Rule(A("within", "?x", "?z"), (A("within", "?x", "?y"), A("within", "?y", "?z")))
    ]
    return rules.reason(star(spark, d).edges, rs).select("src", "dst", "valid_start", "valid_end")


def reason_signed(spark: SparkSession, d: str) -> DataFrame:
    """Returned goods: a customer disputes a part (negative head) while the line holds."""
    A = rules.Atom
    rs = [rules.Rule(A("keeps", "?c", "?p", True), (A("contains", "?o", "?p", True), A("placed_by", "?o", "?c")))]
    return rules.reason(star(spark, d).edges, rs).select("src", "dst", "negative", "valid_start", "valid_end")


def cluster_matching(spark: SparkSession, d: str) -> DataFrame:
    return cluster.greedy_matching(_chains(spark, d)[1])


def cluster_levels(spark: SparkSession, d: str) -> DataFrame:
    n, e = _chains(spark, d)
    return cluster.hierarchy(n, e, 3)


def aggregate_links(spark: SparkSession, d: str) -> DataFrame:
    """Lines between part brands and supplier nations."""
    own = table(spark, d, "part").select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("cluster")
    ).unionAll(
        table(spark, d, "supplier").select(
            F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")),
            F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string"))
        )
    )
    return cluster.aggregate_links(own, star(spark, d).edges.where("predicate = 'supplied_by'"))


def lineage_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    before = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("leaf"), F.col("c_nationkey").cast("string").alias("cluster"))
    after = c.where("c_acctbal < 8000").select(F.col("c_custkey").alias("leaf"), F.col("c_mktsegment").alias("cluster"))
    return cluster.lineage(before, after)


def release_min_k(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d)
    x = g.edges.where("predicate = 'in_nation'").join(
        g.nodes.where("type_id = 'customer'").select(F.col("id").alias("src"), "entity_id"), "src"
    )
    return release.release_counts(x, ["dst"], 60)


def describe_schema(spark: SparkSession, d: str) -> DataFrame:
    return release.describe(fleet(spark, d))


def explain_paths(spark: SparkSession, d: str) -> DataFrame:
    """The joined edges of path_join with their premises, as an explanation graph's edges."""
    p = path_join(spark, d)
    der = p.groupBy(F.concat_ws(">", "src", "dst").alias("id")).agg(F.array_sort(F.collect_set(F.struct(F.array("left_id", "right_id").alias("premises")))).alias("derivations"))
    return release.explain(der)[1]


def provenance_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct depots whose deliveries speak of each unit."""
    u = table(spark, d, "updates").select(
        F.coalesce("source", F.lit("")).alias("source"), F.explode("tables.maintenance").alias("m")
    ).where("m.serial IS NOT NULL").select("source", F.col("m.serial").alias("serial"))
    return release.assertions_of(u, ["serial"]).select("serial", F.array_join("sources", ";").alias("sources"))


def carrier_algebra(spark: SparkSession, d: str) -> DataFrame:
    """AND and OR of two provenance carriers per part."""
    g = lambda *xs: F.array(*(F.array(*x) for x in xs))
    b, t, s = F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")
    one, two = g((b,), (t, s)), g((s,), (b, s))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x, "+")), "|")
    return table(spark, d, "part").select(
        "p_partkey", text(release.conjunction(one, two)).alias("both"),
        text(release.disjunction(one, two)).alias("either")
    )


def group_closure(spark: SparkSession, d: str) -> DataFrame:
    """Who is in which group, groups being in groups: customers, nations, regions."""
    e = star(spark, d).edges.where("predicate IN ('in_nation', 'in_region')")
    return access.memberships(e.select(F.col("src").alias("member"), F.col("dst").alias("group")))


# scalars, writes, feeds --------------------------------------------------------------------------


def parse_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "updates").select("seq", "reported_at", text_millis("reported_at").alias("ms")).distinct()


def reader_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part_installs").select("install_id", F.array_join(access.reader_list("readers"), ",").alias("who")).distinct()


def exact_decimals(spark: SparkSession, d: str) -> DataFrame:
    """Sums, products and quotients of mixed scales, as text with the digits of the exact result."""
    as_ = lambda c, t, n: F.col(c).cast(t).alias(n)
    cols = [as_("l_extendedprice", "decimal(12,2)", "p"), as_("l_quantity", "decimal(12,2)", "q"), as_("l_discount", "decimal(5,2)", "c")]
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    p, q, c = F.col("p"), F.col("q"), F.col("c")
    number = lambda v: F.lit(v).cast("decimal(38,18)")
    shown = {
        "plus": (exact.add(p, q), 2), "minus": (exact.sub(p, q), 2), "times": (exact.mul(p, c), 4), "fine": (
            exact.mul(q, number("0.1234567891")), 12
        ),
        "eighths": (exact.div(p, number("0.125")), 2), "sixteenth": (exact.div(p, number("16")), 6), "third": (exact.div(p, number("3")), 2),
    }
    return x.select("l_orderkey", "l_linenumber", *(v.cast(f"decimal(30,{n})").cast("string").alias(k) for k, (v, n) in shown.items()))


def row_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Work orders as edges, a missing technician giving no edge."""
    from chronolith.sources.formats import edge_rows

    m = table(spark, d, "maintenance").select(
        "work_order", "serial", "performed_by", "readers", F.col("started_at").cast("string").alias("started_at"),
        F.col("ended_at").cast("string").alias("ended_at")
    )
    e = edge_rows(
        m, "maintenance", "work_order",
        [("hw:performed_on", "work_order", "serial", "serial"), ("hw:performed_by", "work_order", "performed_by", "performed_by")]
    )
    return e.select("id", "src", "dst", "predicate").distinct()


def change_feed_whole(spark: SparkSession, d: str) -> DataFrame:
    """The feed pulled from its first revision to its end: which page gave each revision."""
    return feed.pages(heads(spark, d).groupBy("seq").agg(F.count(F.lit(1)).alias("n_heads"))).select("seq", "n_heads", "page")


def view_membership(spark: SparkSession, d: str) -> DataFrame:
    """A live selection kept up to date from the changed edges only, as a change set."""
    g = fleet(spark, d)
    was = g.edges.where("predicate = 'runs'").where(contains(F.col("valid_start"), F.col("valid_end"), F.lit(T1))).select("id")
    changed = g.edges.where(F.col("valid_start") >= T1).withColumn("change", F.lit("asserted"))
    return feed.change_set(was, feed.refresh_membership(was, changed, "runs", T2))


def windows_tumbling(spark: SparkSession, d: str) -> DataFrame:
    s = cdc.file_stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    w = feed.tumbling_stream(s, "ts", "1 day", "2 days", ["event_type"])
    return w.select(F.unix_millis("window_start").alias("window_ms"), "event_type", "n")


def windows_session(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "n")


def rollup_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("total")
    )


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("what", F.lit("both")).unionAll(c.exceptAll(s).groupBy("k").count().select("k", F.lit("rest").alias("what")))


QUERIES = {f.__name__: f for f in (
    query_all, query_predicate, query_endpoint, query_valid_at, query_visible, query_visible_two_clauses, filter_endpoints, filter_keeps_timed, project_members, context_default, context_open,
    counterparts_bridge, counterparts_entity, resolve_identity, support_verdict, assertion_join, union_origin, diff_membership, metadata_follow, as_of_events, changes_events, heads_as_of, recorded_range, recorded_history,
    facts_at_revision, changes_revisions, fact_versions, reconcile_report, path_join, path_join_fleet, _sequence("before"), _sequence("overlaps"), _sequence("within"), window_clip,
    window_attachments, series_overlap, units_running_with_sensor, _expand("out", "order:1", None), _expand("in", "nation:3"), _expand("both", "customer:1"), expand_valid_nodes, expand_nearest, degree, weak_components, strong_components,
    shortest_paths, pagerank_fixed10, _nearest("cosine_distance"), _nearest("euclidean"), nearest_candidates, knn_search, similar_candidates, geometry_distance, geometry_transform, geometry_axes,
    reason_transitive, reason_signed, cluster_matching, cluster_levels, aggregate_links, lineage_overlap, release_min_k, describe_schema, explain_paths, provenance_union, carrier_algebra, group_closure,
    parse_times, reader_lists, exact_decimals, row_mapping, change_feed_whole, view_membership, windows_tumbling, windows_session, rollup_orders, set_operations,
)}
