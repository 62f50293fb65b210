"""SQL (DuckDB) for the queries of plans.graph_queries."""

from __future__ import annotations

from chronolith.plans.problems_sql import _LINKS, _TREE, _hold, _ms, _ref

V1, V2, T1, T2 = 803_347_200_000, 834_969_600_000, 1_704_067_200_000, 1_735_689_600_000

_N = "CAST(NULL AS BIGINT)"
_STAR = f"""n AS (
  SELECT 'region:' || r_regionkey AS id, 'region:' || r_regionkey AS entity_id, 'biz' AS space_id, 'region' AS type_id, {_N} AS vs, {_N} AS ve, CAST([] AS VARCHAR[]) AS readers FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey, 'biz', 'nation', NULL, NULL, [] FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier:' || s_suppkey, 'biz', 'supplier', NULL, NULL, [] FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part:' || p_partkey, 'biz', 'part', NULL, NULL, [] FROM part
  UNION ALL SELECT 'customer:' || c_custkey, 'customer:' || c_custkey, 'biz', 'customer', NULL, NULL, CASE WHEN c_mktsegment = 'BUILDING' THEN ['alice'] ELSE [] END FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'order:' || o_orderkey, 'biz', 'order', epoch_ms(o_orderdate), NULL, [] FROM orders
  UNION ALL SELECT 'geo:supplier:' || s_suppkey, 'supplier:' || s_suppkey, 'geo', 'supplier', NULL, NULL, [] FROM supplier),
e AS (
  SELECT 'in_region:nation:' || n_nationkey AS id, 'in_region' AS predicate, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, CAST(0 AS BIGINT) AS vs, {_N} AS ve, 'positive' AS polarity, CAST(NULL AS VARCHAR) AS context FROM nation
  UNION ALL SELECT 'in_nation:customer:' || c_custkey, 'in_nation', 'customer:' || c_custkey, 'nation:' || c_nationkey, 0, NULL, 'positive', NULL FROM customer
  UNION ALL SELECT 'in_nation:supplier:' || s_suppkey, 'in_nation', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 0, NULL, 'positive', NULL FROM supplier
  UNION ALL SELECT 'placed_by:' || o_orderkey, 'placed_by', 'order:' || o_orderkey, 'customer:' || o_custkey, epoch_ms(o_orderdate), NULL, 'positive', NULL FROM orders
  UNION ALL SELECT 'contains:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'contains', 'order:' || l_orderkey, 'part:' || l_partkey, epoch_ms(l_shipdate), epoch_ms(l_shipdate) + 2592000000, CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END, CASE WHEN l_linestatus = 'O' THEN 'open' END FROM lineitem
  UNION ALL SELECT 'supplied_by:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'supplied_by', 'part:' || l_partkey, 'supplier:' || l_suppkey, epoch_ms(l_shipdate), NULL, 'positive', NULL FROM lineitem
  UNION ALL SELECT 'bridge:supplier:' || s_suppkey, 'same_entity', 'supplier:' || s_suppkey, 'geo:supplier:' || s_suppkey, 0, NULL, 'positive', NULL FROM supplier)"""


def _fleet_rows(t: str, key: str) -> str:
    return f"(SELECT *, epoch_ms(valid_from) AS lo, epoch_ms(valid_to) AS hi FROM {_hold(t, key)} WHERE valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from) AND serial IS NOT NULL)"


_READ = "list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(readers, ''), ';'), lambda x: trim(x)), lambda x: x <> '')))"
_FLEET = f"""e AS (
  SELECT 'installed_in:' || install_id AS id, 'installed_in' AS predicate, 'part:' || part_serial AS src, 'unit:' || serial AS dst, lo AS vs, hi AS ve, {_READ} AS readers FROM {_fleet_rows("part_installs", "install_id")} WHERE part_serial IS NOT NULL
  UNION ALL SELECT 'runs:' || install_id, 'runs', 'unit:' || serial, 'fw:' || {_ref("firmware_id", True)}, lo, hi, {_READ} FROM {_fleet_rows("firmware_installs", "install_id")} WHERE {_ref("firmware_id", True)} IS NOT NULL
  UNION ALL SELECT 'measured_by:' || mount_id, 'measured_by', 'unit:' || serial, 'sensor:' || {_ref("sensor_id")}, lo, hi, {_READ} FROM {_fleet_rows("sensor_mounts", "mount_id")} WHERE {_ref("sensor_id")} IS NOT NULL),
n AS (SELECT id, split_part(id, ':', 1) AS type_id FROM (SELECT DISTINCT unnest([src, dst]) AS id FROM e)),
att AS (SELECT 'note:' || work_order AS id, 'unit:' || serial AS host_id, epoch_ms(started_at) AS vs, {_READ} AS readers FROM {_hold("maintenance", "work_order")} WHERE note IS NOT NULL AND started_at IS NOT NULL AND deleted_at IS NULL)"""

_AT = "({0}.vs <= {1} AND ({0}.ve IS NULL OR {1} < {0}.ve))"


def at(t: str, v: int) -> str:
    return _AT.format(t, v)


def _counts(n: str, e: str) -> str:
    return f"SELECT 'node' AS kind, type_id AS name, count(*) AS n FROM {n} GROUP BY ALL UNION ALL SELECT 'edge', predicate, count(*) FROM {e} GROUP BY ALL"


def _members(n: str, e: str) -> str:
    return f"SELECT 'node' AS kind, id FROM {n} UNION ALL SELECT 'edge', id FROM {e}"


def _at_graph(v: int, tag: str) -> str:
    """query(valid_at): nodes valid then, edges valid then between them, only endpoints and timed nodes."""
    ok = f"(n.vs IS NULL OR {at('n', v)})"
    return f"""nv{tag} AS (SELECT * FROM n WHERE {ok}), ev{tag} AS (SELECT e.* FROM e WHERE {at("e", v)} AND src IN (SELECT id FROM nv{tag}) AND dst IN (SELECT id FROM nv{tag})),
    nn{tag} AS (SELECT * FROM nv{tag} WHERE id IN (SELECT src FROM ev{tag} UNION SELECT dst FROM ev{tag}) OR vs IS NOT NULL)"""


_EVENTS = """ev AS (SELECT event_id AS seq, user_id, CASE WHEN event_type = 'error' THEN 'retract' ELSE 'assert' END AS op, epoch_us(ts) // 1000 AS ms, concat_ws('|', CAST(CAST(round(value, 4) AS DECIMAL(20,4)) AS VARCHAR), props) AS content FROM events),
b AS (SELECT min(ms) AS lo, max(ms) AS hi FROM ev)"""


def _events_at(share: float) -> str:
    return f"(SELECT user_id, content FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, seq DESC) AS rn FROM ev, b WHERE ms <= CAST(trunc(lo + (hi - lo) * {share}::DOUBLE) AS BIGINT)) WHERE rn = 1 AND op <> 'retract')"


_LOG = "lg AS (SELECT DISTINCT line, kind, id, lower(trim(op)) AS op, seq, position, body FROM fact_log), hd AS (SELECT graph_id, branch_id, line, seq, max(recorded_at_ms) AS recorded_at_ms FROM fact_log GROUP BY ALL)"


def _rev(s: int) -> str:
    return f"(SELECT line, kind, id, body FROM (SELECT *, row_number() OVER (PARTITION BY line, kind, id ORDER BY position DESC) AS rn FROM lg WHERE seq <= {s}) WHERE rn = 1 AND op <> 'retract')"


def _changes(keys: str, b: str, a: str, col: str) -> str:
    k = keys.split(", ")
    on = " AND ".join(f"x.{c} = y.{c}" for c in k)
    return f"""SELECT {", ".join(f"coalesce(x.{c}, y.{c}) AS {c}" for c in k)}, CASE WHEN x.{k[0]} IS NULL THEN 'asserted' WHEN y.{k[0]} IS NULL THEN 'retracted' ELSE 'corrected' END AS change, x.{col} AS before, y.{col} AS after
      FROM {b} x FULL JOIN {a} y ON {on} WHERE x.{k[0]} IS NULL OR y.{k[0]} IS NULL OR x.{col} IS DISTINCT FROM y.{col}"""


_OVER = "(l.ve IS NULL OR r.vs < l.ve) AND (r.ve IS NULL OR l.vs < r.ve)"
_FLEET_PAIR = "FROM e l JOIN e r ON l.dst = r.src WHERE l.predicate = 'installed_in' AND r.predicate = 'runs'"
_REL = {"before": "l.ve < r.vs", "meets": "l.ve = r.vs", "overlaps": _OVER, "within": "l.vs >= r.vs AND (r.ve IS NULL OR l.ve <= r.ve)"}
_IN = "({0}.vs < " + str(T2) + " AND ({0}.ve IS NULL OR " + str(T1) + " < {0}.ve))"


def _seq(name: str) -> str:
    p = f"p AS (SELECT l.id AS left_id, r.id AS right_id, l.vs AS ls, l.ve AS le, r.vs AS rs, r.ve AS re {_FLEET_PAIR} AND {_IN.format('l')} AND {_IN.format('r')} AND {_REL[name]})"
    side = lambda role, i, s, x: f"SELECT left_id, right_id, '{role}' AS role, {i} AS edge_id, greatest({s}, {T1}) AS valid_start, least(coalesce({x}, {T2}), {T2}) AS valid_end FROM p"
    return f"WITH {_FLEET}, {p} {side('left', 'left_id', 'ls', 'le')} UNION ALL {side('right', 'right_id', 'rs', 're')}"


def _hops(direction: str, seed: str, v: int | None, nodes: str = "") -> str:
    """Two hops; edges that leave a node met before the last hop; ``nodes`` is a condition on both ends."""
    out, back = "SELECT id, src AS a, dst AS b FROM ex", "SELECT id, dst AS a, src AS b FROM ex"
    legs = {"out": out, "in": back, "both": f"{out} UNION ALL {back}"}[direction]
    alive = f" AND src IN (SELECT id FROM n WHERE {nodes}) AND dst IN (SELECT id FROM n WHERE {nodes})" if nodes else ""
    return f"""WITH {_STAR}, ex AS (SELECT * FROM e WHERE {at("e", v) if v else "TRUE"}{alive}), leg AS ({legs}),
      h1 AS (SELECT DISTINCT b AS id FROM leg WHERE a = '{seed}' AND b <> '{seed}'),
      h2 AS (SELECT DISTINCT b AS id FROM leg WHERE a IN (SELECT id FROM h1) AND b <> '{seed}' AND b NOT IN (SELECT id FROM h1)),
      r AS (SELECT '{seed}' AS id UNION SELECT id FROM h1)
      SELECT 'node' AS kind, '{seed}' AS id, CAST(0 AS BIGINT) AS hop UNION ALL SELECT 'node', id, 1 FROM h1 UNION ALL SELECT 'node', id, 2 FROM h2
      UNION ALL SELECT 'edge', id, -1 FROM (SELECT DISTINCT leg.id FROM leg JOIN r ON r.id = leg.a)"""


def _cos(a: str, b: str) -> str:
    d = lambda x: f"list_transform({x}, lambda z: CAST(z AS DOUBLE))"
    return f"least(greatest(1.0 - list_inner_product({d(a)}, {d(b)}) / (sqrt(list_inner_product({d(a)}, {d(a)})) * sqrt(list_inner_product({d(b)}, {d(b)}))), 0.0), 2.0)"


def _euc(a: str, b: str) -> str:
    d = lambda x: f"list_transform({x}, lambda z: CAST(z AS DOUBLE))"
    return f"list_distance({d(a)}, {d(b)})"


def _near(expr: str, more: str = "") -> str:
    return f"""SELECT id, round(s, 6) AS score, rank FROM (SELECT v.vec_id AS id, {expr} AS s, row_number() OVER (ORDER BY {expr}, v.vec_id) AS rank FROM embeddings v, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE v.vec_id <> 0 {more}) WHERE rank <= 10"""


_KNN = f"""k AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS l1, v.label AS l2, {_cos("q.embedding", "v.embedding")} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cos("q.embedding", "v.embedding")}, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5)"""

_RANK = ", ".join(
    f"r{i} AS (SELECT n.id, 0.15 / c.n + 0.85 * d.m / c.n + 0.85 * coalesce(s.s, 0) AS score FROM n CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(score), 0) AS m FROM r{i - 1} WHERE id NOT IN (SELECT src FROM e)) d LEFT JOIN (SELECT dst, sum(score / o.k) AS s FROM e JOIN o ON o.src = e.src JOIN r{i - 1} r ON r.id = e.src GROUP BY dst) s ON s.dst = n.id)"
    for i in range(1, 11)
)
_DIGIT = "CAST({0} AS DECIMAL(15,2))"

SQL = {
    "query_all": f"WITH {_STAR} {_counts('n', 'e')}",
    "query_predicate": f"WITH {_STAR}, x AS (SELECT * FROM e WHERE predicate = 'in_nation') {_members('(SELECT DISTINCT unnest([src, dst]) AS id FROM x)', 'x')}",
    "query_endpoint": f"WITH {_STAR}, x AS (SELECT * FROM e WHERE predicate = 'in_nation' AND dst = 'nation:3') {_members('(SELECT DISTINCT unnest([src, dst]) AS id FROM x)', 'x')}",
    "query_valid_at": f"WITH {_STAR}, {_at_graph(V1, '')} {_counts('nn', 'ev')}",
    "query_visible": f"WITH {_STAR}, y AS (SELECT * FROM n WHERE len(readers) = 0), z AS (SELECT * FROM e WHERE src IN (SELECT id FROM y) AND dst IN (SELECT id FROM y)) {_counts('y', 'z')}",
    "query_visible_two_clauses": f"WITH {_FLEET}, z AS (SELECT * FROM e WHERE len(readers) = 0 OR (list_has_any(readers, ['ops-lead', 'yard']) AND list_contains(readers, 'night-crew'))) {_counts('n', 'z')}",
    "filter_endpoints": f"WITH {_STAR}, x AS (SELECT * FROM e WHERE predicate = 'placed_by' AND {at('e', V1)}) {_members('(SELECT DISTINCT unnest([src, dst]) AS id FROM x)', 'x')}",
    "filter_keeps_timed": f"WITH {_STAR}, x AS (SELECT * FROM e WHERE {at('e', V1)}), y AS (SELECT * FROM n WHERE id IN (SELECT src FROM x UNION SELECT dst FROM x) OR {at('n', V1)}) {_counts('y', 'x')}",
    "project_members": f"WITH {_STAR}, x AS (SELECT * FROM e WHERE predicate = 'in_nation' AND src LIKE 'supplier:%'), y AS (SELECT id FROM n WHERE type_id = 'region' OR id IN (SELECT src FROM x UNION SELECT dst FROM x)) {_members('y', 'x')}",
    "context_default": f"WITH {_STAR} SELECT predicate, count(*) AS n FROM e WHERE context IS NULL GROUP BY 1",
    "context_open": f"WITH {_STAR} SELECT id, polarity FROM e WHERE context = 'open'",
    "counterparts_bridge": f"WITH {_STAR} SELECT e.id AS edge_id, a.entity_id, a.space_id AS source_space, b.space_id AS target_space, a.entity_id = b.entity_id AS shared FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE predicate = 'same_entity' AND polarity = 'positive'",
    "counterparts_entity": "SELECT 'node' AS kind, 'supplier:7' AS id UNION ALL SELECT 'node', 'geo:supplier:7' UNION ALL SELECT 'edge', 'bridge:supplier:' || s_suppkey FROM supplier WHERE s_suppkey = 7",
    "resolve_identity": "SELECT 'accepted' AS mapping, 'supplier:' || s_suppkey AS partition_id, 'supplier:' || s_suppkey AS from_id, 'geo:supplier:' || s_suppkey AS to_id FROM supplier",
    "support_verdict": f"""WITH {_STAR}, s AS (SELECT predicate, dst, count(*) FILTER (WHERE {at("e", V1)} AND polarity = 'positive') AS n_for, count(*) FILTER (WHERE {at("e", V1)} AND polarity = 'negative') AS n_against FROM e WHERE predicate = 'contains' GROUP BY ALL)
      SELECT *, CASE WHEN n_for > 0 AND n_against > 0 THEN 'conflicted' WHEN n_for > 0 THEN 'supported' WHEN n_against > 0 THEN 'refuted' ELSE 'unknown' END AS state FROM s""",
    "assertion_join": f"WITH {_STAR} SELECT predicate, polarity, count(*) AS n, count(DISTINCT (src, dst)) AS n_structures FROM e WHERE predicate = 'contains' GROUP BY ALL",
    "union_origin": f"WITH {_STAR}, x AS (SELECT * FROM e WHERE predicate IN ('in_nation', 'in_region')) {_members('(SELECT DISTINCT unnest([src, dst]) AS id FROM x)', 'x')}",
    "diff_membership": f"""WITH {_STAR}, {_at_graph(V1, "1")}, {_at_graph(V2, "2")}, d AS (SELECT 'node' AS kind, x.id AS b, y.id AS a FROM (SELECT DISTINCT id FROM nn1) x FULL JOIN (SELECT DISTINCT id FROM nn2) y ON x.id = y.id UNION ALL SELECT 'edge', x.id, y.id FROM (SELECT DISTINCT id FROM ev1) x FULL JOIN (SELECT DISTINCT id FROM ev2) y ON x.id = y.id)
      SELECT kind, CASE WHEN a IS NULL THEN 'removed' WHEN b IS NULL THEN 'added' ELSE 'kept' END AS membership, count(*) AS n FROM d GROUP BY ALL""",
    "metadata_follow": f"WITH {_FLEET} SELECT id, greatest(vs, {T1}) AS valid_start, least(coalesce(ve, {T2}), {T2}) AS valid_end FROM e WHERE predicate = 'runs' AND {_IN.format('e')}",
    "as_of_events": f"WITH {_EVENTS} SELECT user_id, content FROM {_events_at(0.5)}",
    "changes_events": f"WITH {_EVENTS} {_changes('user_id', _events_at(0.5), _events_at(0.75), 'content')}",
    "heads_as_of": f"WITH {_LOG} SELECT graph_id, branch_id, arg_max(seq, (recorded_at_ms, seq)) AS head_seq, max(recorded_at_ms) AS head_ms FROM hd WHERE recorded_at_ms <= {T1} GROUP BY ALL",
    "recorded_range": f"WITH {_LOG} SELECT graph_id, branch_id, line, seq, recorded_at_ms FROM hd WHERE recorded_at_ms >= {T1} AND recorded_at_ms < {T2}",
    "recorded_history": f"WITH {_LOG} SELECT graph_id, branch_id, arg_max(seq, (recorded_at_ms, seq)) AS seq, max(recorded_at_ms) AS recorded_at_ms, TRUE AS is_start FROM hd WHERE recorded_at_ms < {T1} GROUP BY graph_id, branch_id UNION ALL SELECT graph_id, branch_id, seq, recorded_at_ms, FALSE FROM hd WHERE recorded_at_ms >= {T1} AND recorded_at_ms < {T2}",
    "facts_at_revision": f"WITH {_LOG} SELECT * FROM {_rev(20)}",
    "changes_revisions": f"WITH {_LOG} {_changes('line, kind, id', _rev(20), _rev(40), 'body')}",
    "fact_versions": f"WITH {_LOG} SELECT line, kind, id, position, from_seq, until_seq FROM (SELECT line, kind, id, op, position, seq AS from_seq, lead(seq) OVER (PARTITION BY line, kind, id ORDER BY seq, position) AS until_seq FROM lg) WHERE op <> 'retract'",
    "reconcile_report": f"WITH {_EVENTS} SELECT CASE WHEN c.user_id IS NULL THEN 'assert' WHEN c.content IS NOT DISTINCT FROM x.content THEN 'unchanged' ELSE 'correct' END AS action, count(*) AS n FROM {_events_at(0.75)} x LEFT JOIN {_events_at(0.5)} c ON c.user_id = x.user_id GROUP BY 1",
    "path_join": f"WITH {_STAR} SELECT l.id AS left_id, r.id AS right_id, 'ordered_from' AS predicate, l.src, r.dst, greatest(l.vs, r.vs) AS valid_start, {_N} AS valid_end FROM e l JOIN e r ON l.dst = r.src WHERE l.predicate = 'placed_by' AND r.predicate = 'in_nation'",
    "path_join_fleet": f"WITH {_FLEET} SELECT l.id AS left_id, r.id AS right_id, 'part_runs' AS predicate, l.src, r.dst, greatest(l.vs, r.vs) AS valid_start, CASE WHEN l.ve IS NULL THEN r.ve WHEN r.ve IS NULL THEN l.ve ELSE least(l.ve, r.ve) END AS valid_end {_FLEET_PAIR} AND {_OVER}",
    **{f"sequence_{k}": _seq(k) for k in _REL if k != "meets"},  # see sequence_touching
    "window_clip": f"WITH {_FLEET} SELECT id, greatest(vs, {T1}) AS valid_start, least(coalesce(ve, {T2}), {T2}) AS valid_end FROM e WHERE {_IN.format('e')}",
    "window_attachments": f"WITH {_FLEET} SELECT id, host_id, greatest(vs, {T1}) AS valid_start, CAST({T2} AS BIGINT) AS valid_end FROM att WHERE vs < {T2}",
    "series_overlap": f"""WITH {_FLEET}, s AS (SELECT 'sensor:' || {_ref("sensor_id")} AS sensor_id, min(epoch_ms(recorded_at)) AS s FROM sensors GROUP BY 1), j AS (SELECT s.sensor_id, e.src AS serial, greatest(e.vs, s.s, {T1}) AS lo, least(coalesce(e.ve, 9000000000000000), s.s + 31536000000, {T2}) AS hi FROM e JOIN s ON s.sensor_id = e.dst WHERE predicate = 'measured_by')
      SELECT 'series:' || sensor_id AS series_id, sensor_id, serial, lo AS valid_start, hi AS valid_end FROM j WHERE lo < hi""",
    "units_running_with_sensor": f"WITH {_FLEET} SELECT * FROM (SELECT src AS unit, count(*) FILTER (WHERE predicate = 'runs') AS n_firmware, count(*) FILTER (WHERE predicate = 'measured_by') AS n_sensors FROM e WHERE predicate <> 'installed_in' AND {at('e', T1)} GROUP BY 1) WHERE n_firmware > 0 AND n_sensors > 0",
    "expand_2hop_out": _hops("out", "order:1", None),
    "expand_2hop_in": _hops("in", "nation:3", V1),
    "expand_2hop_both": _hops("both", "customer:1", V1),
    "expand_valid_nodes": _hops("in", "nation:3", V1, f"vs IS NULL OR (vs <= {V1} AND {V1} < vs + 5184000000)"),
    "expand_nearest": f"""WITH {_STAR}, h1 AS (SELECT src AS id FROM e WHERE dst = 'nation:3' AND {at("e", V1)}), h2 AS (SELECT src AS id FROM e WHERE dst IN (SELECT id FROM h1) AND {at("e", V1)}), r AS (SELECT 'nation:3' AS id UNION SELECT id FROM h1 UNION SELECT id FROM h2),
      c AS (SELECT 'customer:' || vec_id AS id, {_cos("embedding", "q")} AS s FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)) SELECT id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY s, id) AS rank FROM c WHERE id IN (SELECT id FROM r)) WHERE rank <= 10""",
    "degree": f"WITH {_STAR}, i AS (SELECT dst AS id, count(*) AS c FROM e WHERE polarity = 'positive' GROUP BY 1), o AS (SELECT src AS id, count(*) AS c FROM e WHERE polarity = 'positive' GROUP BY 1) SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree FROM n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id",
    "weak_components": f"WITH RECURSIVE {_LINKS}, b AS (SELECT child AS x, parent AS y FROM links UNION SELECT parent, child FROM links), w AS (SELECT DISTINCT x AS id, x AS c FROM b UNION SELECT b.y, w.c FROM w JOIN b ON b.x = w.id) SELECT id, min(c) AS component FROM w GROUP BY id",
    "strong_components": f"WITH RECURSIVE {_TREE}, q AS (SELECT * FROM links WHERE child NOT IN (SELECT node FROM walk)), w AS (SELECT child AS a, parent AS b FROM q UNION SELECT w.a, q.parent FROM w JOIN q ON q.child = w.b) SELECT a AS id, min(b) AS component FROM w WHERE EXISTS (SELECT 1 FROM w v WHERE v.a = w.b AND v.b = w.a) AND EXISTS (SELECT 1 FROM w v WHERE v.a = w.a AND v.b <> w.a AND EXISTS (SELECT 1 FROM w u WHERE u.a = v.b AND u.b = w.a)) GROUP BY a",
    "shortest_paths": f"WITH RECURSIVE {_FLEET}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), w AS (SELECT min(src) AS id, CAST(0 AS BIGINT) AS k FROM e UNION SELECT b.y, w.k + 1 FROM w JOIN b ON b.x = w.id WHERE w.k < 40) SELECT id, min(k) AS distance FROM w GROUP BY id",
    "pagerank_fixed10": f"WITH {_FLEET}, c AS (SELECT count(*) AS n FROM n), o AS (SELECT src, count(*) AS k FROM e GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / c.n AS score FROM n, c), {_RANK} SELECT id, round(score * 1e6, 4) AS score_ppm FROM r10",
    "nearest_cosine": _near(_cos("v.embedding", "q")),
    "nearest_euclidean": _near(_euc("v.embedding", "q")),
    "nearest_candidates": _near(_cos("v.embedding", "q"), "AND v.label = 3"),
    "knn_search": f"WITH {_KNN} SELECT query_id, id, round(s, 6) AS score, rank FROM k",
    "similar_candidates": f"WITH {_KNN} SELECT least(query_id, id) AS low, greatest(query_id, id) AS high, round(min(s), 6) AS score FROM k WHERE s <= 0.9 AND l1 <> l2 GROUP BY 1, 2",
    "geometry_distance": "SELECT vec_id AS id, CASE WHEN label % 2 <> 0 AND label <> 1 THEN round(sqrt(3.0), 6) END AS distance FROM embeddings",
    "geometry_transform": "SELECT vec_id AS id, round(-CAST(embedding[2] AS DOUBLE) * 0.001 + 1.0, 9) AS c0, round(CAST(embedding[1] AS DOUBLE) * 0.001 + 2.0, 9) AS c1, round(CAST(embedding[3] AS DOUBLE) * 0.001 + 3.0, 9) AS c2 FROM embeddings",
    "geometry_axes": "SELECT vec_id, round(CAST(embedding[6] AS DOUBLE), 6) AS c0, round(CAST(embedding[1] AS DOUBLE), 6) AS c1, round(CAST(embedding[64] AS DOUBLE), 6) AS c2 FROM embeddings",
    "reason_transitive": f"WITH RECURSIVE {_STAR}, b AS (SELECT DISTINCT src, dst, vs FROM e WHERE predicate IN ('in_nation', 'in_region', 'placed_by')), w AS (SELECT src, dst, vs FROM b UNION SELECT w.src, b.dst, greatest(w.vs, b.vs) FROM w JOIN b ON b.src = w.dst) SELECT src, dst, vs AS valid_start, {_N} AS valid_end FROM w",
    "reason_signed": f"WITH {_STAR} SELECT DISTINCT p.dst AS src, c.dst AS dst, TRUE AS negative, greatest(c.vs, p.vs) AS valid_start, c.ve AS valid_end FROM e c JOIN e p ON p.src = c.src AND p.predicate = 'placed_by' WHERE c.predicate = 'contains' AND c.polarity = 'negative' AND p.vs < c.ve",
    "aggregate_links": "SELECT p_brand AS from_cluster, 'nation:' || s_nationkey AS to_cluster, count(*) AS n_links FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL",
    "lineage_overlap": """WITH x AS (SELECT CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS VARCHAR) END AS before, CASE WHEN c_acctbal < 8000 THEN c_mktsegment END AS after FROM customer), n AS (SELECT before, after, count(*) AS n_shared FROM x GROUP BY ALL),
      o AS (SELECT before, count(*) AS k FROM n WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY 1), i AS (SELECT after, count(*) AS k FROM n WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY 1)
      SELECT n.before, n.after, n_shared, CASE WHEN n.after IS NULL THEN 'retired' WHEN n.before IS NULL THEN 'created' WHEN o.k > 1 AND i.k > 1 THEN 'split_merge' WHEN o.k > 1 THEN 'split' WHEN i.k > 1 THEN 'merged' ELSE 'kept' END AS change FROM n LEFT JOIN o ON o.before = n.before LEFT JOIN i ON i.after = n.after WHERE n.before IS NOT NULL OR n.after IS NOT NULL""",
    "release_min_k": "SELECT 'nation:' || c_nationkey AS dst, CASE WHEN count(*) >= 60 THEN count(*) END AS n, count(*) >= 60 AS released FROM customer GROUP BY c_nationkey",
    "describe_schema": f"WITH {_FLEET} SELECT 'type' AS what, type_id AS name, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'space', 'fleet', count(*) FROM n UNION ALL SELECT 'predicate', predicate, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'attachment', 'hw:note', count(*) FROM att",
    "explain_paths": f"""WITH {_STAR}, p AS (SELECT DISTINCT l.src || '>' || r.dst AS c, l.id AS a, r.id AS b FROM e l JOIN e r ON l.dst = r.src WHERE l.predicate = 'placed_by' AND r.predicate = 'in_nation'), d AS (SELECT *, c || '/d' || (row_number() OVER (PARTITION BY c ORDER BY a, b) - 1) AS did FROM p)
      SELECT c AS src, did AS dst, 'alternative' AS predicate FROM d UNION ALL SELECT did, did || '/p0', 'joint_premise' FROM d UNION ALL SELECT did, did || '/p1', 'joint_premise' FROM d""",
    "provenance_union": "SELECT serial, array_to_string(list_sort(list_distinct(list(source))), ';') AS sources FROM (SELECT coalesce(source, '') AS source, m.serial AS serial FROM (SELECT source, unnest(tables.maintenance) AS m FROM updates)) WHERE serial IS NOT NULL GROUP BY serial",
    "carrier_algebra": """SELECT p_partkey, array_to_string(list_transform(list_sort([list_sort([s, b]), list_sort([s, t])]), lambda x: array_to_string(x, '+')), '|') AS "both",
      array_to_string(list_sort([s, b]), '|') AS either FROM (SELECT p_partkey, p_brand AS b, p_type AS t, CAST(p_size AS VARCHAR) AS s FROM part)""",
    "group_closure": "SELECT 'customer:' || c_custkey AS member, 'nation:' || c_nationkey AS \"group\" FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "parse_times": f"SELECT DISTINCT seq, reported_at, {_ms('reported_at')} AS ms FROM updates",
    "reader_lists": f"SELECT DISTINCT install_id, array_to_string({_READ}, ',') AS who FROM part_installs",
    "exact_decimals": """SELECT l_orderkey, l_linenumber, CAST(p + q AS VARCHAR) AS plus, CAST(p - q AS VARCHAR) AS minus, CAST(p * c AS VARCHAR) AS times,
      CAST(q * CAST(0.1234567891 AS DECIMAL(11,10)) AS VARCHAR) AS fine, CAST(p * 8 AS VARCHAR) AS eighths, CAST(p * CAST(0.0625 AS DECIMAL(5,4)) AS VARCHAR) AS sixteenth,
      CASE WHEN CAST(p * 100 AS BIGINT) % 3 = 0 THEN CAST(CAST(CAST(p * 100 AS BIGINT) // 3 AS DECIMAL(15,0)) * CAST(0.01 AS DECIMAL(3,2)) AS VARCHAR) END AS third
      FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_quantity AS DECIMAL(12,2)) AS q, CAST(l_discount AS DECIMAL(5,2)) AS c FROM lineitem)""",
    "row_mapping": "SELECT DISTINCT 'hw:performed_on:' || work_order AS id, work_order AS src, serial AS dst, 'hw:performed_on' AS predicate FROM maintenance WHERE serial IS NOT NULL UNION SELECT 'hw:performed_by:' || work_order, work_order, performed_by, 'hw:performed_by' FROM maintenance WHERE performed_by IS NOT NULL",
    "change_feed_whole": f"WITH {_LOG} SELECT seq, count(*) AS n_heads, (dense_rank() OVER (ORDER BY seq) - 1) // 1000 + 1 AS page FROM hd GROUP BY seq",
    "view_membership": f"WITH {_FLEET}, a AS (SELECT id FROM e WHERE predicate = 'runs' AND {at('e', T1)}), b AS (SELECT id FROM a WHERE id NOT IN (SELECT id FROM e WHERE vs >= {T1}) UNION SELECT id FROM e WHERE vs >= {T1} AND predicate = 'runs' AND {at('e', T2)}) SELECT id, 'added' AS change FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'removed' FROM a WHERE id NOT IN (SELECT id FROM b)",
    "windows_tumbling": "SELECT epoch_ms(date_trunc('day', ts)) AS window_ms, event_type, count(*) AS n FROM events GROUP BY ALL",
    "windows_session": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM s GROUP BY user_id, k",
    "rollup_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "set_operations": "SELECT c_nationkey AS k, 'both' AS what FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT DISTINCT c_nationkey, 'rest' FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)",
}
