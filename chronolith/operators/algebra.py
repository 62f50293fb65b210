"""The graph algebra: selection, projection, set operations, support, identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.errors import EngineError, within
from chronolith.model import NEGATIVE, POSITIVE, Graph, having, hosted
from chronolith.operators.intervals import contains, overlap
from chronolith.session import checkpointed

MAX_GRAPHS = 1000


def edge_filter(predicate: str | None = None, src: str | None = None, dst: str | None = None, valid_at: int | None = None) -> Column:
    """Conjunction of the edge conditions; all plain comparisons, so they reach the Parquet scan."""
    c = F.lit(True)
    if predicate is not None:
        c = c & (F.col("predicate") == predicate)
    if src is not None:
        c = c & (F.col("src") == src)
    if dst is not None:
        c = c & (F.col("dst") == dst)
    if valid_at is not None:
        c = c & contains(F.col("valid_start"), F.col("valid_end"), F.lit(valid_at))
    return c


def node_valid(at: int) -> Column:
    return F.col("valid_start").isNull() | contains(F.col("valid_start"), F.col("valid_end"), F.lit(at))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("_n")).distinct()


def query(g: Graph, predicate: str | None = None, src: str | None = None, dst: str | None = None, valid_at: int | None = None) -> Graph:
    """Read a graph.  Without a condition: all of it.  With one: matching edges and their endpoints;
    if ``valid_at`` is the only condition, also isolated nodes whose own interval holds it.
    Nodes not valid at the time go with their edges; attachments are filtered by time too."""
    if predicate is None and src is None and dst is None and valid_at is None:
        return g
    nodes = g.nodes if valid_at is None else g.nodes.where(node_valid(valid_at))
    att = g.attachments if valid_at is None or g.attachments is None else g.attachments.where(contains(
        F.col("valid_start"), F.col("valid_end"), F.lit(valid_at)
    ))
    x = Graph(nodes, g.edges.where(edge_filter(predicate, src, dst, valid_at)), att, g.coverage, g.diagnostics).pruned()
    return _endpoints_only(x, keep_timed=valid_at if predicate is None and src is None and dst is None else None)


def filter_graph(g: Graph, predicate: str | None = None, valid_at: int | None = None) -> Graph:
    """Matching edges and their endpoints; nodes with an own interval that holds ``valid_at`` stay unless a
    predicate is given.  Attachments follow their hosts and are not filtered by time."""
    x = g.with_(edges=g.edges.where(edge_filter(predicate, valid_at=valid_at)))
    return _endpoints_only(x, keep_timed=valid_at if predicate is None else None)


def _endpoints_only(g: Graph, keep_timed: int | None) -> Graph:
    used = endpoints(g.edges).withColumn("_used", F.lit(True))
    nodes = g.nodes.join(used, F.col("id") == F.col("_n"), "inner" if keep_timed is None else "left")
    if keep_timed is not None:
        timed = F.col("valid_start").isNotNull() & contains(F.col("valid_start"), F.col("valid_end"), F.lit(keep_timed))
        nodes = nodes.where(F.col("_used").isNotNull() | timed)
    nodes = nodes.drop("_n", "_used")
    return g.with_(nodes=nodes, attachments=hosted(g.attachments, nodes, g.edges))


def project(g: Graph, node_ids: DataFrame | None = None, edge_ids: DataFrame | None = None) -> Graph:
    """Only the named members; edges bring their endpoints.  An unknown id is an error (E_PROJECT_MEMBER)."""
    empty = g.nodes.select("id").limit(0)
    n, e = node_ids.select("id").distinct() if node_ids is not None else empty, edge_ids.select("id").distinct() if edge_ids is not None else empty
    for want, have in ((n, g.nodes), (e, g.edges)):
        if not want.join(have.select("id"), "id", "left_anti").isEmpty():
            raise EngineError("E_PROJECT_MEMBER", "an id is not in the graph")
    edges = having(g.edges, "id", e)
    keep = n.unionAll(endpoints(edges).withColumnRenamed("_n", "id"))
    nodes = having(g.nodes, "id", keep)
    return g.with_(nodes=nodes, edges=edges, attachments=hosted(g.attachments, nodes, edges))


def context(g: Graph, selection: str | None) -> Graph:
    """Claims made in exactly one context; null is the default context, not a wildcard."""
    return g.with_(edges=g.edges.where(F.col("context").eqNullSafe(F.lit(selection))), selection=selection)


def same_context(a: Graph, b: Graph) -> None:
    """Claims of different contexts don't combine (E_CONTEXT)."""
    if a.selection != b.selection:
        raise EngineError("E_CONTEXT", f"{a.selection} and {b.selection}")


def counterparts(g: Graph, entity_id: str, source_space: str, target_space: str, valid_at: int) -> Graph:
    """Positive edges between the manifestations of one entity in two spaces, at a time.

    A bridge from the entity's manifestation in the one space to another entity's in
    the other is E_IDENTITY."""
    source = g.nodes.where((F.col("entity_id") == entity_id) & (F.col("space_id") == source_space))
    target = g.nodes.where(F.col("space_id") == target_space)
    edges = g.edges.where(edge_filter(valid_at=valid_at) & (F.col("polarity") == POSITIVE))
    edges = having(edges, "src", source)
    ends = target.select(F.col("id").alias("_t"), F.col("entity_id").alias("_e")).distinct()
    bridged = edges.join(ends, F.col("dst") == F.col("_t"))
    if not bridged.where(F.col("_e") != entity_id).isEmpty():
        raise EngineError("E_IDENTITY", "a bridge joins two entities")
    edges = bridged.select(*g.edges.columns)
    nodes = having(g.nodes, "id", endpoints(edges).withColumnRenamed("_n", "id"))
    return g.with_(nodes=nodes, edges=edges, attachments=None)


def bridges(g: Graph, predicate: str) -> DataFrame:
    """All counterpart edges of a bridging predicate, as (edge_id, entity_id, source_space, target_space, shared): shared is false where the ends are different entities."""
    n = g.nodes.select("id", "entity_id", "space_id")
    x = g.edges.where((F.col("predicate") == predicate) & (F.col("polarity") == POSITIVE)).select(
        F.col("id").alias("edge_id"), "src", "dst"
    )
    x = x.join(n.select(F.col("id").alias("src"), F.col("entity_id").alias("e1"), F.col("space_id").alias("source_space")), "src")
    x = x.join(n.select(F.col("id").alias("dst"), F.col("entity_id").alias("e2"), F.col("space_id").alias("target_space")), "dst")
    return x.select("edge_id", F.col("e1").alias("entity_id"), "source_space", "target_space", (F.col("e1") == F.col("e2")).alias("shared"))


def resolve_identity(partitions: DataFrame, node_ids: DataFrame, target_space: str, at: int) -> DataFrame:
    """Members of the same accepted partition in another space: partitions (mapping, partition_id, node_id, space_id, valid_start, valid_end)."""
    live = partitions.where(contains(F.col("valid_start"), F.col("valid_end"), F.lit(at)))
    mine = live.join(node_ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(
        "mapping", "partition_id", F.col("node_id").alias("from_id"), F.col("space_id").alias("from_space")
    )
    return live.where(F.col("space_id") == target_space).join(mine, ["mapping", "partition_id"]).where("from_space <> space_id").select(
        "mapping", "partition_id", "from_id", F.col("node_id").alias("to_id")
    )


def origin_key(kind: str, cols: Sequence[str]) -> Column:
    """Identity of a member across results: a hash of where it came from, not of its name."""
    return F.sha2(F.to_json(F.struct(F.lit(kind).alias("k"), *cols), {"ignoreNullFields": "false"}), 256)


def _same(df: DataFrame, key: Sequence[str], payload: Sequence[str], code: str) -> DataFrame:
    """One row per key; two payloads under one key are an error raised when the result is computed."""
    digest = F.xxhash64(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))
    a = df.withColumn("_h", digest).groupBy(*key).agg(
        F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), F.max(F.struct(*payload)).alias("_p")
    )
    ok = F.when(F.col("_lo") == F.col("_hi"), F.col("_p")).otherwise(F.raise_error(F.lit(code)).cast(a.schema["_p"].dataType))
    return a.select(*key, ok.alias("_p")).select(*key, *(F.col(f"_p.{c}").alias(c) for c in payload))


def _keyed(df: DataFrame, kind: str, cols: Sequence[str]) -> DataFrame:
    """With ``_key``: members made by the engine or read from a store are told by their origin where they have one."""
    if "origin" not in df.columns:
        return df.withColumn("_key", F.col("id"))
    return df.withColumn("_key", F.when(F.col("origin").isNull(), F.col("id")).otherwise(origin_key(kind, ["origin", *cols])))


NODE_KEY, EDGE_KEY = ["entity_id", "space_id"], ["valid_start", "valid_end"]


def union(a: Graph, b: Graph) -> Graph:
    """Both graphs, each member once by origin; same origin with another payload is E_ORIGIN_CONFLICT.

    Members with an ``origin`` column that is not null are told by it (nodes with
    entity and space, edges with their valid time), others by id; names are never
    merged.  Different contexts are E_CONTEXT."""
    same_context(a, b)

    def merge(x: DataFrame, y: DataFrame, kind: str, cols: Sequence[str]) -> DataFrame:
        both = x.unionByName(y, allowMissingColumns=True)
        key = _keyed(both, kind, cols)
        payload = [c for c in both.columns if c != "id"]
        # of members of one origin under several names the least name stays
        named = key.groupBy("_key").agg(F.min("id").alias("id")) if "origin" in both.columns else None
        one = _same(key, ["_key"], payload, "E_ORIGIN_CONFLICT")
        return (one.join(named, "_key") if named is not None else one.withColumnRenamed("_key", "id")).select(*both.columns)

    att = a.attachments if a.attachments is not None else b.attachments
    if a.attachments is not None and b.attachments is not None:
        att = merge(a.attachments, b.attachments, "attachment", [])
    coverage = "complete" if a.coverage == b.coverage == "complete" else "partial"
    nodes, edges = merge(a.nodes, b.nodes, "node", NODE_KEY), merge(a.edges, b.edges, "edge", EDGE_KEY)
    return Graph(nodes, edges, att, coverage, a.diagnostics + b.diagnostics, a.selection)


def diff(before: Graph, after: Graph) -> DataFrame:
    """(kind, id, membership): members on one side only are ``removed`` or ``added``, others ``kept``.

    Members are told as in union(); of a member kept under two names the least is given."""
    same_context(before, after)

    def side(kind: str, x: DataFrame, y: DataFrame, cols: Sequence[str]) -> DataFrame:
        at = lambda df, b: _keyed(df, kind, cols).select("_key", "id", F.lit(b).alias("b"), F.lit(1 - b).alias("a"))
        g = at(x, 1).unionAll(at(y, 0)).groupBy("_key").agg(F.min("id").alias("id"), F.max("b").alias("b"), F.max("a").alias("a"))
        membership = F.when(F.col("a") == 0, "removed").when(F.col("b") == 0, "added").otherwise("kept")
        return g.select(F.lit(kind).alias("kind"), "id", membership.alias("membership"))

    return side("node", before.nodes, after.nodes, NODE_KEY).unionAll(side("edge", before.edges, after.edges, EDGE_KEY))


def diff_graph(before: Graph, after: Graph) -> Graph:
    """The union of both, with an attachment ``diff:membership`` on every member that was removed or added.

    A member of both sides with another payload is E_ORIGIN_CONFLICT, as in union()."""
    changed = diff(before, after).where("membership <> 'kept'")
    none = F.lit(None).cast("long")
    att = changed.select(
        F.concat_ws(":", F.lit("diff"), "kind", "id").alias("id"), F.col("kind").alias("host_kind"), F.col("id").alias("host_id"),
        F.lit("diff:membership").alias("key"), F.col("membership").alias("value"), F.lit(0).cast("long").alias("valid_start"), none.alias("valid_end"),
        F.array().cast("array<string>").alias("readers"),
    )
    both = union(before.with_(attachments=None), after.with_(attachments=None))
    return both.with_(attachments=att)


def support(edges: DataFrame, claim: Sequence[str], valid_at: int) -> DataFrame:
    """Four-valued verdict per claim: supported, refuted, conflicted; unknown where only other times have evidence.

    Counts are combined before the shuffle.  Refuting evidence is not absence."""
    at = contains(F.col("valid_start"), F.col("valid_end"), F.lit(valid_at))
    g = edges.groupBy(*claim).agg(
        F.count(F.when(at & (F.col("polarity") == POSITIVE), 1)).alias("n_for"),
        F.count(F.when(at & (F.col("polarity") == NEGATIVE), 1)).alias("n_against")
    )
    state = F.when(
        (F.col("n_for") > 0) & (F.col("n_against") > 0), "conflicted"
    ).when(F.col("n_for") > 0, "supported").when(F.col("n_against") > 0, "refuted").otherwise("unknown")
    return g.withColumn("state", state)


def support_graph(edges: DataFrame, claim: Sequence[str], valid_at: int) -> Graph:
    """Verdicts as a graph: one node a claim, its state an attachment, its proofs edges from the claims that make it.

    Every claim valid then is a proof of its own (OR over AND-groups of one)."""
    def name(kind: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.to_json(F.struct(*claim), {"ignoreNullFields": "false"}), 256), 1, 32))

    none, nobody = F.lit(None).cast("long"), F.array().cast("array<string>")
    verdict = support(edges, claim, valid_at).withColumn("id", name("support"))
    nodes = verdict.select(
        "id", F.col("id").alias("entity_id"), F.lit("analysis").alias("space_id"), F.lit("Support").alias("type_id"),
        none.alias("valid_start"), none.alias("valid_end"), nobody.alias("readers")
    )
    att = verdict.select(
        F.concat(F.col("id"), F.lit("/state")).alias("id"), F.lit("node").alias("host_kind"),
        F.col("id").alias("host_id"), F.lit("support:state").alias("key"), F.col("state").alias("value"),
        F.lit(valid_at).cast("long").alias("valid_start"), none.alias("valid_end"), nobody.alias("readers")
    )
    at = contains(F.col("valid_start"), F.col("valid_end"), F.lit(valid_at))
    proofs = edges.where(at).select(
        F.concat(F.lit("proof:"), "id").alias("id"), F.lit("support:proof").alias("predicate"),
        F.col("id").alias("src"), name("support").alias("dst"), "valid_start", "valid_end", "polarity", "context",
        "readers"
    )
    claims = proofs.select(
        F.col("src").alias("id"), F.col("src").alias("entity_id"), F.lit("analysis").alias("space_id"),
        F.lit("Claim").alias("type_id"), none.alias("valid_start"), none.alias("valid_end"), F.col("readers")
    )
    return Graph(nodes.unionAll(claims), proofs, att)


def metadata_closure(refs: DataFrame, start: DataFrame, max_depth: int = 8, max_graphs: int = MAX_GRAPHS) -> DataFrame:
    """(graph_id, depth): graphs that attachments refer to, by way of graphs referred to before, start included.

    refs: (graph_id, ref_graph); start: (graph_id).  Breadth-first, a graph once with
    its least depth, so circles end.  More than ``max_graphs`` are E_BUDGET; depth 0 to 32."""
    if not 0 <= max_depth <= 32:
        raise EngineError("E_DEPTH", "0 to 32")
    links = refs.where("graph_id IS NOT NULL AND ref_graph IS NOT NULL").select("graph_id", "ref_graph").distinct()
    seen = frontier = checkpointed(start.select("graph_id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        near = links.join(frontier.select("graph_id"), "graph_id", "left_semi").select(F.col("ref_graph").alias("graph_id")).distinct()
        frontier = checkpointed(near.join(seen.select("graph_id"), "graph_id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = checkpointed(within(seen.unionAll(frontier), max_graphs))
    return seen


def materialize(structures: DataFrame, assertions: DataFrame) -> DataFrame:
    """Explicit profile: each assertion becomes an edge over the structure it speaks of."""
    s = structures.select(F.col("id").alias("edge_id"), "predicate", "src", "dst")
    return assertions.join(s, "edge_id").select(
        F.col("id"), "predicate", "src", "dst", "valid_start", "valid_end", "polarity", "context", "readers", "source"
    )


def metadata(g: Graph, host_kind: str, host_id: str, key: str, graphs: DataFrame) -> Graph:
    """The graph that one attachment names, clipped to the attachment's time; none or several: empty and partial.

    graphs: edges with a ``graph_id`` column."""
    hit = g.attachments.where((F.col("host_kind") == host_kind) & (F.col("host_id") == host_id) & (F.col("key") == key)).select("value", "valid_start", "valid_end").limit(2).collect()
    if len(hit) != 1:
        return Graph(g.nodes.limit(0), g.edges.limit(0), None, "partial", ("E_METADATA_UNAVAILABLE",))
    v, lo, hi = hit[0]
    e = graphs.where(F.col("graph_id") == v).where(overlap(F.col("valid_start"), F.col("valid_end"), F.lit(lo), F.lit(hi).cast("long")))
    e = e.withColumn("valid_start", F.greatest("valid_start", F.lit(lo))).withColumn(
        "valid_end", F.least("valid_end", F.lit(hi).cast("long"))
    ).drop("graph_id")
    used = endpoints(e)
    return Graph(g.nodes.join(used, g.nodes["id"] == used["_n"], "left_semi"), e, None)
