"""Graph operators against brute force, error codes, and noninterference of hidden records."""

import json
import random
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.errors import EngineError
from chronolith.functions import exact
from chronolith.model import ATTACHMENT, EDGE, NODE, Graph
from chronolith.operators import accepted, access, algebra, cluster, facts, release, rules, temporal, traverse, vectors
from chronolith.plans import program
from chronolith.streaming import feed


def graph(spark, nodes, edges, attachments=None):
    n = [(x, x, "s", "t", None, None, r) if isinstance(r, list) else r for x, r in nodes]
    return Graph(
        spark.createDataFrame(n, NODE), spark.createDataFrame(edges, EDGE),
        None if attachments is None else spark.createDataFrame(attachments, ATTACHMENT)
    )


def edge(i, p, a, b, lo=0, hi=None, pol="positive", ctx=None, readers=()):
    return (i, p, a, b, lo, hi, pol, ctx, list(readers))


@pytest.fixture(scope="module")
def small(spark):
    nodes = [(x, []) for x in "abcd"] + [("h", ["bob"])]
    edges = [
        edge("1", "p", "a", "b", 0, 10), edge("2", "p", "b", "c", 5, 20), edge("3", "q", "c", "d"),
        edge("4", "p", "a", "h"), edge("5", "p", "h", "d"), edge("6", "p", "a", "b", 3, 8, "negative"),
        edge("7", "p", "d", "d", 0, 5, ctx="x")
    ]
    att = [
        ("n1", "node", "a", "note", "v", 0, 4, []), ("n2", "edge", "4", "note", "v", 0, None, []),
        ("n3", "node", "b", "note", "w", 2, None, ["bob"])
    ]
    return graph(spark, nodes, edges, att)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_visibility_prunes_dangling(small):
    g = access.visible(small, [["alice"]])
    assert ids(g.nodes) == list("abcd") and ids(g.edges) == ["1", "2", "3", "6", "7"] and ids(g.attachments) == ["n1"]
    assert ids(access.visible(small, [["bob", "x"]]).edges) == list("1234567")
    assert ids(access.visible(small, [["bob"], ["x"]]).nodes) == list("abcd")


def test_query_and_filter(small):
    assert ids(algebra.query(small).nodes) == ["a", "b", "c", "d", "h"]
    q = algebra.query(small, predicate="p", valid_at=10)
    assert ids(q.edges) == ["2", "4", "5"] and ids(q.nodes) == ["a", "b", "c", "d", "h"]
    assert ids(algebra.query(small, valid_at=4).attachments) == ["n2", "n3"]
    assert ids(algebra.filter_graph(small, valid_at=4).attachments) == ["n1", "n2", "n3"]
    assert ids(algebra.context(small, "x").edges) == ["7"] and len(ids(algebra.context(small, None).edges)) == 6


def test_project_unknown_member(small, spark):
    g = algebra.project(small, edge_ids=spark.createDataFrame([("3",)], "id string"))
    assert ids(g.nodes) == ["c", "d"]
    with pytest.raises(EngineError, match="E_PROJECT_MEMBER"):
        algebra.project(small, spark.createDataFrame([("zz",)], "id string"))


def test_union_diff_support(small):
    a, b = algebra.query(small, predicate="p"), algebra.query(small, predicate="q")
    assert ids(algebra.union(a, b).edges) == list("1234567")
    other = b.with_(edges=b.edges.withColumn("dst", F.lit("a")))
    with pytest.raises(Exception, match="E_ORIGIN_CONFLICT"):
        algebra.union(b, other).edges.collect()
    d = {(r["kind"], r["id"]): r["membership"] for r in algebra.diff(a, b).collect()}
    assert d["edge", "1"] == "removed" and d["edge", "3"] == "added" and d["node", "c"] == "kept"
    s = {(r["src"], r["dst"]): r["state"] for r in algebra.support(small.edges, ["src", "dst"], 4).collect()}
    assert s["a", "b"] == "conflicted" and s["b", "c"] == "unknown" and s["c", "d"] == "supported"


def test_relations_and_clipping(small, spark):
    l = graph(
        spark, [("a", []), ("b", [])],
        [edge("l1", "p", "a", "b", 0, 5), edge("l2", "p", "a", "b", 6, None), edge("l3", "p", "a", "b", 0, 5, "negative")]
    )
    r = graph(
        spark, [("b", []), ("c", [])],
        [edge("r1", "p", "b", "c", 5, 9), edge("r2", "p", "b", "c", 6, 7), edge("r3", "p", "b", "c", 0, None)]
    )
    pairs = lambda name: sorted({(x["left_id"], x["right_id"]) for x in temporal.sequence(l, r, name, (0, 100)).collect()})
    assert pairs("before") == [("l1", "r2")] and pairs("meets") == [("l1", "r1")]
    assert pairs("overlaps") == [("l1", "r3"), ("l2", "r1"), ("l2", "r2"), ("l2", "r3")] and pairs("within") == [("l1", "r3"), ("l2", "r3")]
    j = {(x["left_id"], x["right_id"]): (x["valid_start"], x["valid_end"]) for x in temporal.path_join(l, r, "o").collect()}
    assert j == {("l1", "r3"): (0, 5), ("l2", "r1"): (6, 9), ("l2", "r2"): (6, 7), ("l2", "r3"): (6, None)}
    w = temporal.window(small, 4, 6)
    assert {x["id"]: (x["valid_start"], x["valid_end"]) for x in w.edges.collect()}["2"] == (5, 6) and ids(w.nodes) == ids(small.nodes) and ids(w.attachments) == ["n2", "n3"]


def test_expand(small, spark):
    seeds = spark.createDataFrame([("a",), ("zz",)], "id string")
    n, e, lost = traverse.expand(small, seeds, 2)
    assert {r["id"]: r["hop"] for r in n.collect()} == {"a": 0, "b": 1, "h": 1, "c": 2, "d": 2} and ids(e) == ["1", "2", "4", "5", "6"] and lost == ("E_SEED_UNAVAILABLE",)
    with pytest.raises(EngineError):
        traverse.expand(small, seeds, 17)
    for limit in (9, 10):
        if limit < 10:
            with pytest.raises(EngineError, match="E_BUDGET"):
                traverse.expand(small, seeds, 2, limit=limit)
        else:
            traverse.expand(small, seeds, 2, limit=limit)
    with pytest.raises(EngineError, match="E_BUDGET"):
        traverse.expand(small, seeds, 2, max_seeds=1)


def test_expand_passes_only_nodes_valid_then(spark):
    nodes = [(x, x, "s", "t", lo, hi, []) for x, lo, hi in (("a", None, None), ("b", 50, 60), ("c", None, None), ("d", 5, None))]
    g = Graph(
        spark.createDataFrame(nodes, NODE),
        spark.createDataFrame(
            [edge("1", "p", "a", "b"), edge("2", "p", "b", "c"), edge("3", "p", "a", "d"), edge("4", "p", "d", "gone")],
            EDGE
        )
    )
    seeds = spark.createDataFrame([("a",), ("b",)], "id string")
    for at, reached, edges in (
        (10, {"a": 0, "d": 1}, ["3"]), (55, {"a": 0, "b": 0, "c": 1, "d": 1}, ["1", "2", "3"]),
        (60, {"a": 0, "d": 1}, ["3"])
    ):
        n, e, lost = traverse.expand(g, seeds, 3, valid_at=at)
        assert {r["id"]: r["hop"] for r in n.collect()} == reached and ids(e) == edges and lost == ()
        assert set(ids(algebra.query(g, valid_at=at).edges)) == set(edges)


def random_graph(rnd, n, m):
    return [f"n{i:02}" for i in range(n)], [(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)]


def test_measures_against_brute_force(spark):
    rnd = random.Random(2)
    names, links = random_graph(rnd, 14, 18)
    nodes, edges = spark.createDataFrame([(x,) for x in names], "id string"), spark.createDataFrame(links, "src string, dst string")
    reach = {a: {a} for a in names}
    for _ in names:
        for a, b in links:
            for x in names:
                if a in reach[x]:
                    reach[x].add(b)
    und = {a: {a} for a in names}
    for _ in names:
        for a, b in links:
            for x in names:
                if a in und[x] or b in und[x]:
                    und[x] |= {a, b}
    assert {r["id"]: r["component"] for r in traverse.weak_components(nodes, edges).collect()} == {x: min(und[x]) for x in names}
    assert {r["id"]: r["component"] for r in traverse.strong_components(nodes, edges).collect()} == {x: min(y for y in names if y in reach[x] and x in reach[y]) for x in names}
    # a queue in order of ids
    src = names[0]
    dist, pred, queue = {src: 0}, {src: None}, [src]
    for x in queue:
        for y in sorted({b for a, b in links if a == x}):
            if y not in dist:
                dist[y], pred[y] = dist[x] + 1, x
                queue.append(y)
    assert {r["id"]: (r["distance"], r["predecessor"]) for r in traverse.shortest_paths(nodes, edges, src).collect()} == {x: (dist[x], pred[x]) for x in dist}
    n = len(names)
    m = np.zeros((n, n))
    for a, b in links:
        m[names.index(b), names.index(a)] += 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / n)
    want = np.full(n, 1 / n)
    for _ in range(6):
        want = 0.15 / n + 0.85 * m @ want
    got, info = traverse.pagerank(nodes, edges, tolerance=0, max_iterations=6)
    assert not info["converged"] and all(abs(r["score"] - want[names.index(r["id"])]) < 1e-12 for r in got.collect())
    got, info = traverse.pagerank(nodes, edges, tolerance=0.5)
    assert info["converged"] and info["residual"] <= 0.5


def test_matching_is_the_greedy_one(spark):
    rnd = random.Random(4)
    for _ in range(2):
        _, links = random_graph(rnd, 10, 20)
        used, want = set(), set()
        for a, b in sorted({tuple(sorted(x)) for x in links if x[0] != x[1]}):
            if not {a, b} & used:
                used |= {a, b}
                want.add((a, b))
        assert {tuple(r) for r in cluster.greedy_matching(spark.createDataFrame(links, "src string, dst string")).collect()} == want


def test_rules(spark):
    e = spark.createDataFrame(
        [
            edge("1", "p", "a", "b", 0, 10), edge("2", "p", "b", "c", 5, 20), edge("3", "p", "c", "a", 8, None),
            edge("4", "q", "a", "b", 0, None, "negative")
        ],
        EDGE
    )
    A = rules.Atom
    rs = [rules.Rule(A("t", "?x", "?y"), (A("p", "?x", "?y"),)), rules.Rule(A("t", "?x", "?z"), (A("t", "?x", "?y"), A("p", "?y", "?z")))]
    got = {(r["src"], r["dst"], r["valid_start"], r["valid_end"]) for r in rules.reason(e, rs).collect()}
    assert {("a", "b", 0, 10), ("a", "c", 5, 10), ("b", "a", 8, 20), ("a", "a", 8, 10), ("b", "b", 8, 10)} <= got
    neg = rules.reason(e, [rules.Rule(A("n", "?x", "b", True), (A("q", "?x", "b", True),))]).collect()
    assert [(r["src"], r["negative"]) for r in neg] == [("a", True)]
    with pytest.raises(EngineError, match="E_RULE_UNSAFE"):
        rules.check([rules.Rule(A("t", "?x", "?w"), (A("p", "?x", "?y"),))])
    with pytest.raises(EngineError, match="E_RULE_BUDGET"):
        rules.reason(e, rs, max_facts=1)


def test_knn_and_candidates(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5)).astype("float32")
    m[7] = m[3]
    m[9] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(60, None), (61, [1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(5)
    for metric in (vectors.COSINE, vectors.EUCLIDEAN):
        got = {}
        for r in vectors.knn(df, df.where("id % 10 = 0"), 4, metric, block=3).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
        for q in range(0, 60, 10):
            a = m.astype(float)
            d = np.sqrt(((a - a[q]) ** 2).sum(axis=1)) if metric == vectors.EUCLIDEAN else np.array([2.5 if not v.any() else 1 - v @ a[q] / np.sqrt((v @ v) * (a[q] @ a[q])) for v in a])
            order = [i for i in np.lexsort((np.arange(60), d.round(12))) if i != q and not (metric == vectors.COSINE and i == 9)][:4]
            assert [i for _, i in sorted(got[q])] == order
        one = vectors.nearest(df, rows[0][1], 4, metric, exclude=0).collect()
        assert [r["id"] for r in one] == [i for _, i in sorted(got[0])]
    hits = spark.createDataFrame([(1, 2, 0.1), (2, 1, 0.1), (1, 3, 0.2), (4, 1, 0.9)], "query_id long, id long, score double")
    link = spark.createDataFrame([(3, 1)], "src long, dst long")
    assert [tuple(r)[:2] for r in vectors.similar_candidates(hits, 0.5, link).collect()] == [(1, 2)]
    with pytest.raises(EngineError, match="E_K"):
        vectors.nearest(df, [1.0] * 5, 0)


def changes_of(spark, *xs):
    return spark.createDataFrame([x if len(x) == 4 else (*x, None) for x in xs], "kind string, id string, op string, content string")


AB = json.dumps({"src": "a", "dst": "b"})


def test_fact_store(spark, tmp_path):
    now = iter(range(10, 1000, 10))
    st = facts.FactStore(spark, str(tmp_path / "store"), clock=lambda: next(now))
    f = lambda *xs: changes_of(spark, *xs)
    assert st.head() is None and st.state().count() == 0
    assert st.write(f(("node", "a", "assert", "1"), ("node", "b", "assert", "1"), ("edge", "e", "assert", AB)), expected=None)["head"] == 0
    assert st.write(f(("node", "a", "assert", "1")))["status"] == "unchanged"
    for bad, code in (
        (f(("node", "a", "retract")), "E_DEPENDENT_FACT"),
        (f(("edge", "z", "assert", json.dumps({"src": "a", "dst": "q"}))), "E_ENDPOINT"),
        (f(("node", "zz", "retract")), "E_UNKNOWN_FACT"),
        (f(("edge", "e", "assert", json.dumps({"src": "b", "dst": "b"}))), "E_CONFLICT"),
        (f(("node", "a", "assert", "1"), ("node", "a", "assert", "2")), "E_CONFLICT"),
        (f(("node", "a", "drop")), "E_OP"),
        (f(("node", "a", "retract"), ("edge", "y", "assert", AB)), "E_DEPENDENT_FACT")
    ):
        with pytest.raises(EngineError, match=code):
            st.write(bad)
    with pytest.raises(EngineError, match="E_STALE_HEAD"):
        st.write(f(("node", "c", "assert", "1")), expected=5)
    with pytest.raises(EngineError, match="E_BUDGET"):
        st.write(f(("node", "c", "assert", "1"), ("node", "d", "assert", "1")), max_changes=1)
    for want in (-1, 7):
        each = f(("node", "a", "assert", "9")).withColumn("expected", F.lit(want))
        if want == -1:
            with pytest.raises(EngineError, match="E_STALE_FACT"):
                st.write(each)
    st.write(f(("edge", "e", "retract"), ("node", "a", "assert", "2")), expected=0)
    with pytest.raises(EngineError, match="E_STALE_FACT"):
        st.write(f(("node", "a", "assert", "9")).withColumn("expected", F.lit(0)))
    st.checkpoint()
    st.write(f(("node", "b", "retract")))
    assert {r["id"]: r["content"] for r in st.state().collect()} == {"a": "2"}
    assert {r["id"] for r in st.state(0).collect()} == {"a", "b", "e"} and {r["id"] for r in st.state(1).collect()} == {"a", "b"}
    ch = {r["id"]: r["change"] for r in facts.changes(st.state(0), st.state(), ["kind", "id"]).collect()}
    assert ch == {"a": "corrected", "b": "retracted", "e": "retracted"}
    times = [st.commit_of(i)["recorded_at_ms"] for i in range(3)]
    assert ids(st.as_of(times[1])) == ["a", "b"] and ids(st.as_of(times[0] - 1)) == []
    with pytest.raises(EngineError, match="E_HISTORY_TIME"):
        st.as_of(10**9)
    state, seen = st.recorded_query(F.lit(True), at=times[1])
    assert ids(state) == ["a", "b"] and seen["seq"] == 1 and len(seen["revision"]) == 64
    with pytest.raises(EngineError, match="E_HISTORY_UNAVAILABLE"):
        st.recorded_query(F.col("id") != "b", seq=1)
    st.compact(1)
    assert ids(st.state()) == ["a"] and ids(st.state(1)) == ["a", "b"] and st.floor() == 1
    for read in (lambda: st.state(0), lambda: st.as_of(times[0])):
        with pytest.raises(EngineError, match="E_HISTORY_EXPIRED"):
            read()
    with pytest.raises(EngineError, match="E_CHECKPOINT"):
        st.drop_checkpoint(1)
    st.compact(1)
    st.checkpoint()
    st.drop_checkpoint(2)
    assert ids(facts.FactStore(spark, str(tmp_path / "store")).state()) == ["a"]


def test_of_two_writers_the_first_keeps_its_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    a, b = facts.FactStore(spark, path), facts.FactStore(spark, path)
    checked = facts.FactStore._checked

    def overtaken(self, *args):
        out = checked(self, *args)
        if self is b:
            monkeypatch.setattr(facts.FactStore, "_checked", checked)
            a.write(changes_of(spark, ("node", "x", "assert", "1")))
        return out

    monkeypatch.setattr(facts.FactStore, "_checked", overtaken)
    with pytest.raises(EngineError, match="E_STALE_HEAD"):
        b.write(changes_of(spark, ("node", "y", "assert", "1")))
    assert ids(a.state()) == ids(b.state()) == ["x"]
    assert b.write(changes_of(spark, ("node", "y", "assert", "1")))["head"] == 1 and ids(a.state()) == ["x", "y"]


def test_batches_are_seen_together_and_a_snapshot_replaces(spark, tmp_path):
    st = facts.FactStore(spark, str(tmp_path / "store"))
    node = lambda *xs: changes_of(spark, *(("node", x, "assert", "1") for x in xs))
    st.commit_batch({"g": node("a", "b"), "h": node("c")}, {"g": None, "h": None})
    with pytest.raises(EngineError, match="E_STALE_HEAD"):
        st.commit_batch({"g": node("z"), "h": node("z")}, {"g": 0, "h": 7})
    assert ids(st.state(graph="g")) == ["a", "b"] and ids(st.state(graph="h")) == ["c"]
    out = st.commit_batch({"g": node("d"), "h": node("c")})
    assert out == {"g": {"status": "written", "head": 1}, "h": {"status": "unchanged", "head": 0}} and st.head("h") == 0
    st.commit(changes_of(spark, ("node", "a", None, "2"), ("node", "q", None, "1")).drop("op"), graph="g")
    assert {r["id"]: r["content"] for r in st.state(graph="g").collect()} == {"a": "2", "q": "1"} and ids(st.state(1, "g")) == ["a", "b", "d"]


def test_import_writes_only_what_differs(spark, tmp_path):
    st = facts.FactStore(spark, str(tmp_path / "store"))
    rows = [("node", f"n{i}", "1") for i in range(40)] + [(
        "edge", f"e{i}", json.dumps({"src": f"n{i}", "dst": f"n{i + 1}"})
    ) for i in range(39)]
    wanted = lambda rs: spark.createDataFrame(rs, "kind string, id string, content string")
    first = facts.imported(st, wanted([*rows, rows[0]]), chunk=25)
    assert (first["assert"], first["correct"], first["unchanged"]) == (79, 0, 0) and first["commits"] > 2 and st.state().count() == 79
    assert facts.imported(st, wanted(rows), chunk=25) == {"assert": 0, "correct": 0, "unchanged": 79, "commits": 0}
    assert facts.imported(st, wanted([("node", "n3", "2"), *rows[5:]]))["correct"] == 1
    assert facts.imported(st, wanted([]))["commits"] == 0


def test_facts_are_selected_by_their_keys(spark):
    cols = "kind string, id string, entity string, subject string, object string, predicate string, valid_from long, valid_to long, recorded_at_ms long"
    df = spark.createDataFrame(
        [
            ("node", "a", "E", None, None, None, None, None, 1), ("edge", "e", None, "a", "b", "p", 0, 5, 2),
            ("edge", "f", None, "b", "a", "q", 3, None, 3), ("space", "s", None, None, None, None, None, None, 4)
        ],
        cols
    )
    f = lambda **k: ids(facts.selected(df, **k))
    assert f() == ["a", "e", "f", "s"] and f(kind="edge", valid_at=5) == ["f"] and f(subject="a") == ["e"] and f(object_="a") == ["f"]
    assert f(recorded=(2, 4)) == ["e", "f"] and f(unanchored=True) == ["s"] and f(entity="E", predicate="p") == []


def test_programs(spark, small):
    cat = program.Catalog(spark, {"g": lambda at: small}, clauses=[["alice"]])
    b = program.build
    q = b["query"](graph_id="g")
    out = program.run(
        [
            program.bind("x", q), program.ask(b["expand"](input=b["reference"](name="x"), seeds=["a"], hops=2)),
            program.ask(b["diff"](before=b["filter"](input=q, predicate="q"), after=q))
        ],
        cat
    )
    assert ids(out[0].nodes) == ["a", "b", "c"] and out[1].attachments.count() > 0
    for text, code in (
        ('{"version":1,"commands":[],"x":1}', "E_FIELD"), ('{"version":2,"commands":[]}', "E_VERSION"),
        ('{"version":1,"version":1,"commands":[]}', "E_DUPLICATE_KEY"),
        ('{"version":1,"commands":[{"kind":"drop"}]}', "E_COMMAND"),
        ('{"version":1,"commands":[{"kind":"evaluate","expression":{"kind":"query"}}]}', "E_FIELD"),
        ('{"version":1,"commands":[{"kind":"evaluate","expression":{"kind":"query","graph_id":NaN}}]}', "E_NUMBER"),
        ("{", "E_JSON")
    ):
        with pytest.raises(EngineError, match=code):
            program.run(text, cat)
    with pytest.raises(EngineError, match="E_BUDGET"):
        program.run([program.ask(b["expand"](input=q, seeds=["a"], hops=2, limit=1))], cat)


def test_programs_nest_and_mount(spark, small):
    contexts = spark.createDataFrame([("x", {"n": "5"})], "context string, axes map<string,string>")
    cat = program.Catalog(spark, {"g": lambda at: small}, mounts={"m": ("g", None)}, contexts=contexts)
    b = program.build
    q = b["query"](graph_id="g")
    p = b["filter"](input=q, predicate="p")
    inner = b["join"](left=p, right=p, output_predicate="pp")
    outer = b["join"](left=inner, right=b["filter"](input=q, predicate="q"), output_predicate="ppq")
    rule = [{"head": {"predicate": "r", "from": "?x", "to": "?y"}, "body": [{"predicate": "pp", "from": "?x", "to": "?y"}]}]
    asked = [
        outer, b["reason"](input=inner, rules=rule),
        b["sequence"](left=p, right=p, relation="overlaps", window=[0, 100]),
        b["support"](input=b["query_mount"](mount="m"), predicate="p", valid_at=4),
        b["cluster"](input=q, predicate="p", levels=1, valid_at=6),
        b["typed_context"](input=q, selection="x", definition={"n": {"type": "integer"}}),
        b["expand"](input=b["union"](left=inner, right=q), seeds=["a"], hops=1)
    ]
    got = program.run([program.ask(x) for x in asked], cat)
    entity = {r["id"]: r["entity_id"] for r in got[0].nodes.collect()}
    # a-b [0,10) and b-c [5,20) give a-c [5,10), which then meets c-d
    assert [(entity[r["src"]], entity[r["dst"]], r["valid_start"], r["valid_end"]) for r in got[0].edges.collect()] == [("a", "d", 5, 10)]
    assert {r["predicate"] for r in got[1].edges.collect()} == {"pp", "r"}
    assert got[2].edges.count() == 2 * temporal.sequence(
        *(small.with_(edges=small.edges.where("predicate = 'p'")),) * 2, "overlaps", (0, 100)
    ).select("left_id", "right_id").distinct().count()
    states = {r["value"] for r in got[3].attachments.collect()}
    assert states == {"conflicted", "supported", "unknown"} and got[3].edges.count() == small.edges.where("predicate = 'p' AND valid_start <= 4 AND (valid_end IS NULL OR valid_end > 4)").count()
    assert got[4].coverage == "partial" and got[4].edges.where("predicate = 'cluster:member'").count() > 0
    assert ids(got[5].edges) == ["7"] and set(ids(got[6].edges)) >= {"1", "4", "6"}
    with pytest.raises(EngineError, match="E_CONTEXT"):
        program.run([program.ask(b["union"](left=b["context"](input=q, selection="x"), right=q))], cat)
    for bad, code in (
        (b["query_mount"](mount="none"), "E_MOUNT"),
        (b["typed_context"](input=q, selection="x", definition={"k": {"type": "string"}}), "E_CONTEXT_TYPE")
    ):
        with pytest.raises(EngineError, match=code):
            program.run([program.ask(bad)], cat)


def test_union_by_origin_and_identity(spark, small):
    n = lambda *xs: spark.createDataFrame([(*x[:2], "s", "t", None, None, [], x[2]) for x in xs], f"{NODE}, origin string")
    e = spark.createDataFrame([], f"{EDGE}, origin string")
    a, b = Graph(n(("1", "E", "g@1"), ("2", "F", None)), e), Graph(n(("9", "E", "g@1"), ("2", "F", None), ("3", "E", "g@2")), e)
    assert ids(algebra.union(a, b).nodes) == ["1", "2", "3"]
    assert {(r["id"], r["membership"]) for r in algebra.diff(a, b).collect()} == {("1", "kept"), ("2", "kept"), ("3", "added")}
    nodes = [("p", "E", "phys"), ("d", "E", "digi"), ("z", "F", "digi")]
    g = Graph(
        spark.createDataFrame([(i, en, sp, "t", None, None, []) for i, en, sp in nodes], NODE),
        spark.createDataFrame([edge("1", "same", "p", "d")], EDGE)
    )
    assert ids(algebra.counterparts(g, "E", "phys", "digi", 1).nodes) == ["d", "p"]
    wrong = g.with_(edges=g.edges.unionAll(spark.createDataFrame([edge("2", "same", "p", "z")], EDGE)))
    with pytest.raises(EngineError, match="E_IDENTITY"):
        algebra.counterparts(wrong, "E", "phys", "digi", 1)
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("a", None)], "graph_id string, ref_graph string")
    start = spark.createDataFrame([("a",)], "graph_id string")
    assert {tuple(r) for r in algebra.metadata_closure(refs, start).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(EngineError, match="E_BUDGET"):
        algebra.metadata_closure(refs, start, max_graphs=2)


def test_results_are_kept_for_those_who_may_read_all(spark, small):
    results = spark.createDataFrame([("a", 1), ("b", 2)], "id string, value int")
    g = release.persisted(small, results, "degree", 5)
    kept = g.attachments.where("key = 'degree'").collect()
    assert sorted(r["host_id"] for r in kept) == ["a", "b"] and all(r["readers"] == ["bob"] for r in kept)
    two = small.with_(edges=small.edges.unionAll(spark.createDataFrame([edge("8", "p", "a", "b", readers=["ann"])], EDGE)))
    assert {tuple(r["readers"]) for r in release.persisted(two, results, "k", 5).attachments.where("key = 'k'").collect()} == {("-",)}
    with pytest.raises(EngineError, match="E_PROJECT_MEMBER"):
        release.persisted(small, results.withColumn("id", F.lit("zz")), "k", 5)
    told = release.release_audit(release.release_counts(small.nodes, ["space_id"], 9), 9, 7, "alice").collect()
    assert [(r["released"], r["principal"]) for r in told] == [(False, "alice")]


def test_forks_proposals_and_exports(spark, tmp_path):
    st = facts.FactStore(spark, str(tmp_path / "store"))
    f = lambda *xs: changes_of(spark, *xs)
    st.write(f(("node", "a", "assert", "1"), ("node", "b", "assert", "1")))
    st.fork("main", "draft")
    st.write(f(("node", "a", "assert", "2"), ("node", "c", "assert", "1")), graph="draft")
    st.write(f(("node", "d", "assert", "1")))
    assert st.integrate("draft", 0)["status"] == "written" and {r["id"]: r["content"] for r in st.state().collect()} == {"a": "2", "b": "1", "c": "1", "d": "1"}
    assert st.integrate("draft", 0)["status"] == "unchanged"
    st.write(f(("node", "a", "assert", "3")), graph="draft")
    st.write(f(("node", "a", "assert", "4")))
    with pytest.raises(EngineError, match="E_STALE_FACT"):
        st.integrate("draft", 0)
    assert st.graphs() == ["draft", "main"] and st.lookup("node", "a") == "4" and st.lookup("node", "q") is None
    page, more = st.audit(limit=2)
    assert [r["seq"] for r in page] == [0, 1] and more == 1 and st.audit(after=more, limit=256)[1] is None
    told = st.export(str(tmp_path / "out"))
    other = facts.FactStore(spark, str(tmp_path / "other"))
    other.import_export(str(tmp_path / "out"), "copy")
    assert told["n"] == 4 and {r["id"] for r in other.state(graph="copy").collect()} == set("abcd")
    spark.createDataFrame(
        [("node", "z", "1")], "kind string, id string, content string"
    ).write.mode("append").parquet(str(tmp_path / "out" / "facts"))
    with pytest.raises(EngineError, match="E_CAPSULE"):
        other.import_export(str(tmp_path / "out"), "again")
    with pytest.raises(EngineError, match="E_GRAPH"):
        st.write(f(("node", "a", "assert", "1")), graph="a/b")


def test_views_and_experiments(spark, tmp_path, small):
    from chronolith.plans.experiments import Experiments
    from chronolith.streaming.views import Views

    v = Views(spark, str(tmp_path / "views"))
    plan = lambda tick: small.edges.where(algebra.edge_filter("p", valid_at=tick)).select(
        "id", F.concat("dst", F.lit(tick % 2)).alias("content")
    )
    v.register("ps", plan, ["g"])
    with pytest.raises(EngineError, match="E_VIEW_STALE"):
        v.current("ps", 4, {"g": 1})
    assert v.drain([("other", 1)], 4, {"g": 1}) == [] and v.drain([("g", 1)], 4, {"g": 1}) == ["ps"] and v.drain([("g", 1)], 4, {"g": 1}) == []
    assert ids(v.current("ps", 4, {"g": 1})) == ["1", "4", "5", "6", "7"]
    assert v.refresh("ps", 9, {"g": 2}) == 2
    assert {tuple(r) for r in v.changes("ps").collect()} == {
        ("2", "added"), ("6", "removed"), ("7", "removed"), ("1", "changed"), ("4", "changed"), ("5", "changed")
    }
    with pytest.raises(EngineError, match="E_CLOCK"):
        v.refresh("ps", 8, {"g": 2})
    with pytest.raises(EngineError, match="E_VIEW"):
        v.register("ps", plan, [])
    cat = program.Catalog(spark, {"g": lambda at: small})
    text = json.dumps({"version": 1, "commands": [program.ask(program.build["query"](graph_id="g", predicate="p"))]})
    x = Experiments(spark, str(tmp_path / "exp"))
    x.save("one", text, cat, {"g": 3})
    assert x.names() == ["one"] and x.replay("one", cat, {"g": 3}) == {"moved": [], "drifted": []}
    less = program.Catalog(spark, {"g": lambda at: small.with_(edges=small.edges.where("id <> '1'"))})
    assert x.replay("one", less, {"g": 4}) == {"moved": ["g"], "drifted": [0]}
    with pytest.raises(EngineError, match="E_EXPERIMENT"):
        x.save("one", text, cat)


def test_vector_properties_and_generator(spark):
    from chronolith.functions.splitmix import splitmix64, unit_interval

    rows = [
        ("a", "E", "s", [3e200, 0.0]), ("b", "E", "s", [1e200, 1e200]), ("c", "E", "t", [1.0, 0.0]),
        ("d", "E", "s", None), ("e", "E", "s", [0.0, -2.0])
    ]
    n = spark.createDataFrame(rows, "id string, entity_id string, space_id string, v array<double>")
    near = lambda m, q, df=n: [(r["id"], round(r["distance"], 9)) for r in vectors.nearest_vectors(df, q, 5, "s", m, "v").collect()]
    assert near(vectors.COSINE, [2.0, 0.0]) == [("a", 0.0), ("b", round(1 - 0.5**0.5, 9)), ("e", 1.0)]
    assert [i for i, _ in near(vectors.EUCLIDEAN, [1e200, 0.0])][0] in ("b", "e")
    for bad in ([1.0], [float("nan"), 1.0], [0.0, 0.0]):
        wrong = n.unionAll(spark.createDataFrame([("z", "E", "s", bad)], n.schema))
        with pytest.raises(Exception, match="E_VECTOR"):
            near(vectors.COSINE, [1.0, 0.0], wrong)
    g = spark.createDataFrame(
        [("a", [1.0, 2.0], None, None, []), ("b", None, None, None, [])],
        "id string, v array<double>, valid_start long, valid_end long, readers array<string>"
    )
    assert [tuple(r)[:3] for r in vectors.embedding_facts(g, "v", 2).collect()] == [("embedding:a", "a", [1.0, 2.0])]
    # the first numbers of seed 0, as published with the generator
    got = [r[0] for r in spark.range(3).select(splitmix64(F.col("id"), 0)).collect()]
    assert [x % 2**64 for x in got] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    assert spark.range(200).select(unit_interval(splitmix64(F.col("id"), 7)).alias("u")).where("u < 0 OR u >= 1").count() == 0
    e = spark.createDataFrame(
        [(i, [float(i % 5), 1.0], f"s{i % 3}", i, i + 4) for i in range(20)],
        "id long, vector array<double>, who string, valid_start long, valid_end long"
    )
    hit = vectors.nearest(e, None, 3, of=6, subject="who", valid_at=8).collect()
    assert [r["id"] for r in hit] == sorted(
        (i for i in range(5, 9) if i % 3), key=lambda i: (1 - (i % 5 * 1 + 1) / ((i % 5) ** 2 + 1) ** 0.5 / 2**0.5, i)
    )[:3]
    with pytest.raises(EngineError, match="E_EMBEDDING"):
        vectors.nearest(e, None, 3, of=99)


def test_updates_are_read_strictly(spark, tmp_path):
    from pyspark.sql.types import StructType

    from chronolith.sources.formats import read_batch, read_updates

    row = "struct<work_order:string,kind:string>"
    schema = StructType.fromDDL(f"seq long, kind string, tables struct<maintenance:array<{row}>,parts:array<{row}>>")
    good = [
        {"seq": 1, "kind": "maintenance", "tables": {"maintenance": [{"work_order": "W1"}]}},
        {"seq": 2, "tables": {"parts": None}}, {"seq": 3}
    ]
    bad = [
        {"seq": 1, "new": 1}, {"seq": 1, "tables": {"other": []}},
        {"seq": 1, "tables": {"maintenance": [{"work_order": "W", "x": 1}]}}, [1]
    ]
    (tmp_path / "ok.jsonl").write_text("\n".join(map(json.dumps, good)) + "\n\n")
    got = read_updates(spark, str(tmp_path / "ok.jsonl"), schema).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [1, 2, 3] and got[0]["tables"]["maintenance"][0]["work_order"] == "W1"
    for i, line in enumerate(bad):
        (tmp_path / f"bad{i}.jsonl").write_text(json.dumps(line))
        with pytest.raises(Exception, match="E_FIELD"):
            read_updates(spark, str(tmp_path / f"bad{i}.jsonl"), schema).collect()
    (tmp_path / "batch").mkdir()
    (tmp_path / "batch" / "b.json").write_text(json.dumps(good[0], indent=2))
    assert read_batch(spark, str(tmp_path / "batch"), schema).first()["seq"] == 1


def test_shared_scratch_is_removed_and_required_on_a_cluster(spark):
    import os

    from chronolith import session

    with session.scratch_scope(spark):
        path = session.scratch(spark, "x")
        spark.range(3).write.parquet(path)
        assert os.path.exists(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))

    class Conf:
        def get(self, *_):
            return None

    class Far:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = Conf

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        def isDefined(self):
                            return False

    with pytest.raises(EngineError, match="E_SHARED_DIR"):
        session.shared_dir(Far)


def test_plans_read_each_table_a_few_times_only(spark):
    """Of the star graph's 14 tables: what a plan scans before it is run, shared scans counted again."""
    from chronolith.plans import graph_queries, problems

    d = "/root/testdata/sf0.001"
    for q, scans, exchanges in (
        (graph_queries.query_visible, 28, 6), (graph_queries.query_valid_at, 49, 10), (graph_queries.diff_membership, 98, 20),
        (graph_queries.degree, 21, 2), (graph_queries.project_members, 60, 20), (problems.p4_found, 6, 12), (problems.p5_found, 2, 4),
    ):
        plan = q(spark, d)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= scans, q.__name__
        assert plan.count("Exchange hashpartitioning") <= exchanges, q.__name__


def test_hidden_records_change_nothing(spark, small):
    """Two worlds that differ only in what alice may not read give her the same answers."""
    more = small.with_(
        nodes=small.nodes.unionAll(spark.createDataFrame([("z", "z", "s", "t", None, None, ["bob"])], NODE)),
        edges=small.edges.unionAll(spark.createDataFrame(
            [edge("90", "p", "a", "z"), edge("91", "q", "a", "c", readers=["bob"]), edge("92", "p", "z", "b")], EDGE
        )),
    )
    seeds = spark.createDataFrame([("a",), ("z",)], "id string")

    def answers(w):
        g = access.visible(w, [["alice"]])
        n, e, lost = traverse.expand(g, seeds, 3, "both")
        all_ = [
            algebra.query(g, valid_at=4).nodes.select("id"), temporal.path_join(g, g, "o"),
            algebra.support(g.edges, ["src", "dst"], 4), traverse.degree(g), release.describe(g), n, e.select("id"),
            temporal.window(g, 1, 6).edges.select("id")
        ]
        return [sorted(map(str, map(tuple, x.collect()))) for x in all_], lost

    assert answers(small) == answers(more)
    seen = access.visible(more, [["bob"]])
    assert "90" in ids(seen.edges)


def test_exact_decimals(spark):
    cases = [
        ("0.1", "0.2"), ("1", "3"), ("123456789012345678", "0.1"), ("2.5", "0"), ("2", "0.1234567891"),
        ("0.0000000003", "3"), ("1", "0.125"), ("-1", "0.298023223876953125"), ("0", "7"), (None, "1"),
        ("1000000000", "1000000000"), ("-0.5", "-8")
    ]
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)], "i int, a string, b string"
    ).select("i", *(F.col(c).cast("decimal(38,18)").alias(c) for c in "ab"))
    rnd = random.Random(1)
    value = lambda: Decimal(rnd.choice([1, -1]) * rnd.randrange(10 ** rnd.choice([1, 3, 6, 9]))).scaleb(-rnd.randrange(12))
    more = [(
        i + 100, value(),
        rnd.choice([value(), Decimal(5 ** rnd.randrange(20)).scaleb(-rnd.randrange(9)), Decimal(2 ** rnd.randrange(25))])
    ) for i in range(150)]
    df = df.unionAll(spark.createDataFrame(more, "i int, a decimal(38,18), b decimal(38,18)"))
    a, b = F.col("a"), F.col("b")

    def fits(x):
        digits = x.normalize().as_tuple()
        return x if len(digits.digits) <= 18 and -digits.exponent <= 18 and abs(x) < 10**20 else None

    with localcontext() as c:
        c.prec = 250
        for r in df.select(
            "a", "b", exact.add(a, b).alias("plus"), exact.sub(a, b).alias("minus"), exact.mul(a, b).alias("times"),
            exact.div(a, b).alias("by")
        ).collect():
            x, y = r["a"], r["b"]
            want = (None,) * 4 if x is None else (fits(x + y), fits(x - y), fits(x * y), fits(x / y) if y and x / y * y == x else None)
            assert (r["plus"], r["minus"], r["times"], r["by"]) == want, r


def test_carriers_contexts_and_views(spark):
    d = spark.createDataFrame([([["b", "a"], ["a", "b"], ["a"]], [["c"]])], "x array<array<string>>, y array<array<string>>")
    r = d.select(release.canonical(F.col("x")).alias("c"), release.conjunction(F.col("x"), F.col("y")).alias("k")).first()
    assert r["c"] == [["a"]] and r["k"] == [["a", "c"]]
    dec = spark.createDataFrame(
        [("v", 1, 10, "r1", True), ("v", 2, 20, "r2", False), ("v", 3, 30, "r3", True)],
        "view string, decision_id int, decided_at long, revision string, accepted boolean"
    )
    assert accepted.accepted_at(dec, ["view"]).first()["revision"] == "r3" and accepted.accepted_at(dec, ["view"], 25).first()["revision"] == "r1"
    assert [r["revision"] for r in accepted.accepted_range(dec, ["view"], 15, 40).orderBy("decided_at").collect()] == ["r1", "r3"]
    ctx = spark.createDataFrame(
        [("c1", {"n": "5"}), ("c2", {"n": "x"}), ("c3", {"q": "1", "n": "2"}), ("c4", {})],
        "context string, axes map<string,string>"
    )
    assert [r[0] for r in accepted.typed_context(ctx, {"n": {"type": "integer", "required": True}}).select("context").collect()] == ["c1"]
    h = spark.createDataFrame([("g", "main", 4)], "graph_id string, branch_id string, seq long")
    assert accepted.current_view(
        {"tick": 1, "coverage": "complete", "inputs": {("g", "main"): 4}}, 1, h
    ) and not accepted.current_view({"tick": 1, "coverage": "complete", "inputs": {("g", "main"): 3}}, 1, h)
    with pytest.raises(EngineError, match="E_CLOCK"):
        accepted.next_tick(5, 4)


def test_dispatch_once_with_dead_letters(spark, tmp_path):
    src, out = str(tmp_path / "ev"), str(tmp_path / "d")
    spark.range(1, 11).withColumnRenamed("id", "event_id").write.parquet(src)
    stream = lambda: spark.readStream.schema("event_id long").parquet(src)
    deliver = lambda df: df.select("event_id", (F.col("event_id") != 7).alias("ok"))
    feed.dispatch(stream(), "a", deliver, out, attempts=2)
    spark.range(5, 13).withColumnRenamed("id", "event_id").write.mode("append").parquet(src)
    feed.dispatch(stream(), "a", deliver, out, attempts=2)
    got = spark.read.schema("event_id long, adapter string, status string").option("recursiveFileLookup", "true").parquet(f"{out}/receipts").collect()
    assert sorted(r["event_id"] for r in got) == list(range(1, 13)) and [r["event_id"] for r in got if r["status"] == "dead"] == [7]


def test_csv_source(spark, tmp_path):
    from chronolith.sources.formats import edge_rows, export_csv, read_csv

    (tmp_path / "u.csv").write_text('serial,model_id,readers\nU1,"M,1",b;a; a\nU2,,\n')
    df = read_csv(spark, str(tmp_path / "u.csv"), ["serial", "model_id", "commissioned_at"], "serial")
    e = edge_rows(df, "units", "serial", [("hw:has_model", "serial", "model_id", "model_id")], "commissioned_at")
    r = e.collect()
    assert len(r) == 1 and r[0]["dst"] == "M,1" and r[0]["readers"] == ["a", "b"]
    export_csv(e, str(tmp_path / "out"))
    (tmp_path / "bad.csv").write_text("serial,nope\nU1,1\n")
    with pytest.raises(EngineError, match="E_COLUMN"):
        read_csv(spark, str(tmp_path / "bad.csv"), ["serial"], "serial")


def test_feed_is_read_to_its_end(spark):
    from chronolith.streaming import feed

    seqs = [*range(0, 37), *range(25_000, 25_040), 7, 7, None]
    log = spark.createDataFrame([(s, i) for i, s in enumerate(seqs)], "seq long, n int")
    want, cursor, page = set(), None, 0
    while True:
        got, cursor = feed.pull(log, cursor, 10)
        rows = got.collect()
        if not rows:
            break
        page += 1
        want |= {(r["seq"], r["n"], page) for r in rows}
    assert {s for s, _, _ in want} == {s for s in seqs if s is not None} and page == 8
    assert {(r["seq"], r["n"], r["page"]) for r in feed.pages(log, 10).collect()} == want


def test_recorded_history_has_the_start_state(spark):
    h = spark.createDataFrame(
        [("a", 1, 5), ("a", 2, 9), ("a", 3, 10), ("b", 1, 3), ("c", 1, 10), ("c", 2, 20), ("d", 7, 9), ("d", 8, 9)],
        "branch string, seq long, recorded_at_ms long"
    )
    got = {tuple(r) for r in facts.recorded_history(h, ["branch"], 10, 20).collect()}
    assert got == {("a", 2, 9, True), ("b", 1, 3, True), ("d", 8, 9, True), ("a", 3, 10, False), ("c", 1, 10, False)}


def test_knn_ranks_only_what_may_be_paired(spark):
    rnd = np.random.default_rng(5)
    m = rnd.integers(-9, 9, (80, 4))
    m[~m.any(axis=1)] = 1
    rows = [
        (
            i, [float(x) for x in v], None if i % 13 == 0 else f"s{i % 6}", None if i % 17 == 0 else i % 10 * 10,
            None if i % 5 == 0 else i % 10 * 10 + 25
        ) for i,
        v in enumerate(m)
    ]
    df = spark.createDataFrame(rows, "id long, vector array<float>, who string, vs long, ve long").repartition(4)
    got = {}
    for r in vectors.knn(
        df.where("id >= 20"), df.where("id % 4 = 0"), 3, vectors.EUCLIDEAN, block=7, subject="who", valid=("vs", "ve")
    ).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    far = 10**9
    for i, _, who, vs, ve in rows[::4]:
        ok = [
            j for j, _, w, s,
            e in rows[20:] if j != i and (w is None or w != who) and None not in (vs, s) and max(vs, s) < min(
                far if ve is None else ve, far if e is None else e
            )
        ]
        want = sorted(ok, key=lambda j: (((m[j] - m[i]) ** 2).sum(), j))[:3]
        assert [j for _, j in sorted(got.get(i, []))] == want
    assert len(got) > 15
