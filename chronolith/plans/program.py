"""Programs: lists of commands with expression trees, as JSON or from builders.

Decoding is strict (unknown fields, kinds and duplicate keys are errors) and
happens before anything runs.  Evaluation gives lazy DataFrames; only loops act.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.errors import EngineError, within
from chronolith.model import Graph
from chronolith.operators import accepted, access, algebra, cluster, facts, rules, temporal, traverse, vectors

MAX_COMMANDS, MAX_NODES, MAX_DEPTH = 1000, 1000, 32

#: Fields of each expression kind: operands (expressions), then required, then optional.
KINDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "query": ((), ("graph_id",), ("predicate", "from", "to", "valid_at")),
    "as_of": ((), ("graph_id", "unix_millis"), ("predicate", "from", "to", "valid_at")),
    "reference": ((), ("name",), ()),
    "filter": (("input",), (), ("predicate", "valid_at")),
    "project": (("input",), (), ("node_ids", "edge_ids")),
    "context": (("input",), (), ("selection",)),
    "counterparts": (("input",), ("entity_id", "source_space", "target_space", "valid_at"), ()),
    "union": (("left", "right"), (), ()),
    "diff": (("before", "after"), (), ()),
    "join": (("left", "right"), ("output_predicate",), ()),
    "sequence": (("left", "right"), ("relation", "window"), ()),
    "window": (("input",), ("start", "end"), ()),
    "support": (("input",), ("predicate", "valid_at"), ()),
    "expand": (("input",), ("seeds", "hops"), ("direction", "predicates", "valid_at", "limit")),
    "changes": (("before", "after"), (), ("limit",)),
    "nearest": (("candidates",), ("space", "query", "k"), ()),
    "reason": (("input",), ("rules",), ("allow_cross_space",)),
    "cluster": (("input",), ("predicate", "levels", "valid_at"), ()),
    "query_mount": ((), ("mount",), ("predicate", "from", "to", "valid_at")),
    "metadata": (("input",), ("host_kind", "host_id", "key"), ()),
    "typed_context": (("input",), ("selection", "definition"), ()),
}
OPTIONAL_OPERANDS = {"nearest": {"candidates"}}
COMMANDS = {"bind": ("name", "expression"), "evaluate": ("expression",)}


def _pairs(items):
    out = dict(items)
    if len(out) != len(items):
        raise EngineError("E_DUPLICATE_KEY")
    return out


def decode(text: str) -> list[dict]:
    """Commands of a program {version, commands}; nothing of it is run here."""
    def bad(x):
        raise EngineError("E_NUMBER", x)

    try:
        p = json.loads(text, object_pairs_hook=_pairs, parse_constant=bad)
    except json.JSONDecodeError as e:
        raise EngineError("E_JSON", str(e)) from None
    if not isinstance(p, dict) or set(p) != {"version", "commands"}:
        raise EngineError("E_FIELD", "a program has version and commands")
    if p["version"] != 1:
        raise EngineError("E_VERSION", str(p["version"]))
    if not isinstance(p["commands"], list) or len(p["commands"]) > MAX_COMMANDS:
        raise EngineError("E_BUDGET", "commands")
    for c in p["commands"]:
        if not isinstance(c, dict) or c.get("kind") not in COMMANDS or set(c) != {"kind", *COMMANDS[c["kind"]]}:
            raise EngineError("E_COMMAND", str(c)[:80])
        check(c["expression"])
    return p["commands"]


def check(x: object, depth: int = 1, seen: list | None = None) -> None:
    """Fields, kinds, depth and size of an expression tree."""
    seen = [] if seen is None else seen
    seen.append(1)
    if depth > MAX_DEPTH or len(seen) > MAX_NODES:
        raise EngineError("E_BUDGET", "expression")
    if not isinstance(x, dict) or x.get("kind") not in KINDS:
        raise EngineError("E_EXPRESSION", str(x)[:80])
    operands, needed, extra = KINDS[x["kind"]]
    if unknown := set(x) - {"kind", *operands, *needed, *extra}:
        raise EngineError("E_FIELD", ", ".join(sorted(unknown)))
    if missing := {*operands, *needed} - set(x) - OPTIONAL_OPERANDS.get(x["kind"], set()):
        raise EngineError("E_FIELD", ", ".join(sorted(missing)))
    for o in operands:
        if o in x:
            check(x[o], depth + 1, seen)


@dataclass
class Catalog:
    """Where graphs come from: name -> (as-of ms or None) -> Graph; vectors: space -> (DataFrame id, vector; metric)."""

    spark: SparkSession
    graphs: dict[str, Callable[[int | None], Graph]]
    spaces: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    #: Mounts: name -> (graph, as-of ms or None for a live alias).
    mounts: dict[str, tuple[str, int | None]] = field(default_factory=dict)
    #: Typed contexts (context, axes).
    contexts: DataFrame | None = None
    #: One clause a principal; None: everything is seen (no principal).
    clauses: list[list[str]] | None = None

    def graph(self, name: str, at: int | None = None) -> Graph:
        if name not in self.graphs:
            raise EngineError("E_GRAPH", name)
        g = self.graphs[name](at)
        return g if self.clauses is None else access.visible(g, self.clauses)


def run(program: str | list[dict], catalog: Catalog) -> list[Graph | DataFrame]:
    """Results of the evaluate commands, in order."""
    commands = decode(program) if isinstance(program, str) else decode(json.dumps({"version": 1, "commands": program}))
    names: dict[str, Graph | DataFrame] = {}
    out = []
    for c in commands:
        v = evaluate(c["expression"], catalog, names)
        if c["kind"] == "bind":
            names[c["name"]] = v
        else:
            out.append(v)
    return out


def evaluate(x: dict, cat: Catalog, names: dict) -> Graph | DataFrame:
    k = x["kind"]
    sub = {o: evaluate(x[o], cat, names) for o in KINDS[k][0] if o in x}
    for o, v in sub.items():
        if not isinstance(v, Graph):
            raise EngineError("E_OPERAND", f"{k}.{o} takes a graph")
    ids = lambda xs: cat.spark.createDataFrame([(i,) for i in xs], "id string")
    if k in ("query", "as_of"):
        return algebra.query(
            cat.graph(x["graph_id"], x.get("unix_millis")), x.get("predicate"), x.get("from"), x.get("to"),
            x.get("valid_at")
        )
    if k == "query_mount":
        if x["mount"] not in cat.mounts:
            raise EngineError("E_MOUNT", x["mount"])
        return algebra.query(cat.graph(*cat.mounts[x["mount"]]), x.get("predicate"), x.get("from"), x.get("to"), x.get("valid_at"))
    if k == "metadata":
        g = sub["input"]
        if g.attachments is None:
            return Graph(g.nodes.limit(0), g.edges.limit(0), None, "partial", ("E_METADATA_UNAVAILABLE",))
        hit = g.attachments.where((F.col("host_kind") == x["host_kind"]) & (F.col("host_id") == x["host_id"]) & (F.col("key") == x["key"]))
        named = [r["value"] for r in hit.select("value").limit(2).collect()]
        if len(named) != 1 or named[0] not in cat.graphs:
            return Graph(g.nodes.limit(0), g.edges.limit(0), None, "partial", ("E_METADATA_UNAVAILABLE",))
        to = cat.graph(named[0])
        made = algebra.metadata(g, x["host_kind"], x["host_id"], x["key"], to.edges.withColumn("graph_id", F.lit(named[0])))
        return made.with_(nodes=to.nodes).pruned()
    if k == "typed_context":
        if cat.contexts is None or accepted.typed_context(
            cat.contexts.where(F.col("context") == x["selection"]), x["definition"]
        ).isEmpty():
            raise EngineError("E_CONTEXT_TYPE", str(x["selection"]))
        return algebra.context(sub["input"], x["selection"])
    if k == "reference":
        if x["name"] not in names:
            raise EngineError("E_REFERENCE", x["name"])
        return names[x["name"]]
    if k == "filter":
        return algebra.filter_graph(sub["input"], x.get("predicate"), x.get("valid_at"))
    if k == "project":
        return algebra.project(
            sub["input"], ids(x["node_ids"]) if "node_ids" in x else None,
            ids(x["edge_ids"]) if "edge_ids" in x else None
        )
    if k == "context":
        return algebra.context(sub["input"], x.get("selection"))
    if k == "counterparts":
        return algebra.counterparts(sub["input"], x["entity_id"], x["source_space"], x["target_space"], x["valid_at"])
    if k == "union":
        return algebra.union(sub["left"], sub["right"])
    if k == "diff":
        return algebra.diff_graph(sub["before"], sub["after"])
    if k == "join":
        return temporal.joined(sub["left"], sub["right"], x["output_predicate"])
    if k == "sequence":
        return temporal.sequenced(sub["left"], sub["right"], x["relation"], tuple(x["window"]))
    if k == "window":
        return temporal.window(sub["input"], x["start"], x["end"])
    if k == "support":
        claims = sub["input"].edges.where(F.col("predicate") == x["predicate"])
        return algebra.support_graph(claims, ["predicate", "src", "dst"], x["valid_at"])
    if k == "expand":
        how = (x["hops"], x.get("direction", "out"), x.get("predicates"), x.get("valid_at"), x.get("limit", 10_000))
        nodes, edges, lost = traverse.expand(sub["input"], ids(x["seeds"]), *how)
        g = sub["input"]
        return Graph(g.nodes.join(nodes.select("id"), "id", "left_semi"), edges, None, "partial" if lost else g.coverage, lost)
    if k == "changes":
        text = lambda g: g.nodes.select(
            F.lit("node").alias("kind"), "id",
            F.to_json(F.struct(*[c for c in g.nodes.columns if c != "id"])).alias("content")
        ).unionAll(g.edges.select(F.lit("edge"), "id", F.to_json(F.struct(*[c for c in g.edges.columns if c != "id"]))))
        return within(facts.changes(text(sub["before"]), text(sub["after"]), ["kind", "id"]), x.get("limit", 10_000))
    if k == "nearest":
        if x["space"] not in cat.spaces:
            raise EngineError("E_SPACE", x["space"])
        df, metric = cat.spaces[x["space"]]
        return vectors.nearest(df, x["query"], x["k"], metric, candidates=sub["candidates"].nodes if "candidates" in sub else None)
    if k == "reason":
        atom = lambda a: rules.Atom(a["predicate"], a["from"], a["to"], a.get("negative", False))
        made = [rules.Rule(atom(r["head"]), tuple(atom(b) for b in r["body"])) for r in x["rules"]]
        return rules.reasoned(sub["input"], made, x.get("allow_cross_space", False))
    if k == "cluster":
        return cluster.clustered(sub["input"], x["predicate"], x["levels"], x["valid_at"])
    raise EngineError("E_EXPRESSION", k)


def _builder(kind: str) -> Callable[..., dict]:
    def build(**args) -> dict:
        x = {"kind": kind, **{"from" if a == "from_" else a: v for a, v in args.items() if v is not None}}
        check(x)
        return x

    build.__name__ = kind
    build.__doc__ = f"A {kind} expression; fields {KINDS[kind]}."
    return build


#: Builders by kind: build["query"](graph_id="fleet", valid_at=5).
build = {k: _builder(k) for k in KINDS}


def bind(name: str, expression: dict) -> dict:
    return {"kind": "bind", "name": name, "expression": expression}


def ask(expression: dict) -> dict:
    return {"kind": "evaluate", "expression": expression}
