"""SQL (DuckDB) for the queries of plans.more_queries."""

from __future__ import annotations

from chronolith.plans.graph_sql import _FLEET, _FLEET_PAIR, _IN, _OVER, _STAR, _cos, at
from chronolith.plans.problems_sql import _ref

V1, T1, T2 = 803_347_200_000, 1_704_067_200_000, 1_735_689_600_000


def _known(t: str, key: str, when: int, interval: bool = True) -> str:
    ok = "WHERE valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from) AND serial IS NOT NULL" if interval else ""
    return f"(SELECT * FROM (SELECT * FROM {t} WHERE epoch_us(recorded_at) // 1000 <= {when} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY recorded_at DESC) = 1) {ok})"


def _edges_known(when: int) -> str:
    """(id, src, dst, lo, hi, readers) of the fleet's edges as recorded by a time."""
    return f"""(SELECT 'installed_in:' || install_id AS id, 'part:' || part_serial AS src, 'unit:' || serial AS dst, epoch_ms(valid_from) AS lo, epoch_ms(valid_to) AS hi, readers FROM {_known("part_installs", "install_id", when)} WHERE part_serial IS NOT NULL
      UNION ALL SELECT 'runs:' || install_id, 'unit:' || serial, 'fw:' || {_ref("firmware_id", True)}, epoch_ms(valid_from), epoch_ms(valid_to), readers FROM {_known("firmware_installs", "install_id", when)} WHERE {_ref("firmware_id", True)} IS NOT NULL
      UNION ALL SELECT 'measured_by:' || mount_id, 'unit:' || serial, 'sensor:' || {_ref("sensor_id")}, epoch_ms(valid_from), epoch_ms(valid_to), readers FROM {_known("sensor_mounts", "mount_id", when)} WHERE {_ref("sensor_id")} IS NOT NULL)"""


_READ = "list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(readers, ''), ';'), lambda x: trim(x)), lambda x: x <> '')))"


def _units(when: int) -> str:
    return f"(SELECT DISTINCT unit, id, b FROM (SELECT unnest([src, dst]) AS unit, id, CAST(struct_pack(src, dst, lo, hi, r := {_READ}) AS VARCHAR) AS b FROM {_edges_known(when)}) WHERE unit LIKE 'unit:%')"


_DECISIONS = """t AS (SELECT DISTINCT * FROM sync_runs WHERE run_id IS NOT NULL AND logged_at IS NOT NULL),
  x AS (SELECT feed, coalesce(scope, '') AS scope, epoch_us(logged_at) // 1000 AS decided_at, run_id AS decision_id, upto_pos AS revision FROM t WHERE lower(trim(run_status)) = 'succeeded')"""


def _accepted(when: int | None) -> str:
    cond = "" if when is None else f"WHERE decided_at <= {when}"
    return f"SELECT feed, scope, revision, decision_id, decided_at FROM x {cond} QUALIFY row_number() OVER (PARTITION BY feed, scope ORDER BY decided_at DESC, decision_id DESC, revision DESC NULLS LAST) = 1"


def _view(tick: int) -> str:
    return f"(SELECT src AS id, max(dst || '>' || id) AS c FROM e WHERE predicate = 'runs' AND {at('e', tick)} GROUP BY src)"


def _generation(i: int, before: str | None, now: str) -> str:
    if before is None:
        return f"SELECT 'added' AS change, count(*) AS n, {i} AS generation FROM {now}"
    return f"""SELECT change, count(*), {i} FROM (SELECT CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.c <> b.c THEN 'changed' END AS change
      FROM {before} b FULL JOIN {now} a ON a.id = b.id) WHERE change IS NOT NULL GROUP BY change"""


_OVERLAP = "greatest(q.lo, v.lo) < least(coalesce(q.hi, 1000), coalesce(v.hi, 1000))"
_EMB = "em AS (SELECT vec_id, embedding, label, vec_id % 50 AS lo, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 50 + 20 END AS hi FROM embeddings)"
_ORDERED = "e l JOIN e r ON l.dst = r.src WHERE l.predicate = 'placed_by' AND r.predicate = 'in_nation'"
_WRAP = "18446744073709551616::UHUGEINT"
_ALICE = "n.id IN (SELECT id FROM n WHERE len(readers) = 0 OR list_contains(readers, 'alice'))"

SQL = {
    "join_nested": f"""WITH {_STAR} SELECT l.src AS "order", x.dst AS region, 'ordered_in' AS predicate, greatest(l.vs, r.vs, x.vs) AS valid_start, CAST(NULL AS BIGINT) AS valid_end
      FROM e l JOIN e r ON l.dst = r.src JOIN e x ON x.src = r.dst WHERE l.predicate = 'placed_by' AND r.predicate = 'in_nation' AND x.predicate = 'in_region'""",
    "sequence_graph": f"""WITH {_FLEET}, p AS (SELECT l.src AS a, r.src AS b, l.vs AS ls, r.vs AS rs {_FLEET_PAIR} AND {_IN.format('l')} AND {_IN.format('r')} AND {_OVER})
      SELECT 'installed_in' AS predicate, a AS entity_id, count(*) AS n, min(greatest(ls, {T1})) AS first FROM p GROUP BY a UNION ALL SELECT 'runs', b, count(*), min(greatest(rs, {T1})) FROM p GROUP BY b""",
    "sequence_touching": f"""WITH {_FLEET}, k AS (SELECT src, vs, min(id) AS id FROM e WHERE predicate = 'runs' GROUP BY ALL), c AS (SELECT *, lead(vs) OVER (PARTITION BY src ORDER BY vs) AS ve, lead(id) OVER (PARTITION BY src ORDER BY vs) AS nxt FROM k),
      p AS (SELECT a.id AS l, b.id AS r, a.vs AS ls, a.ve AS le, b.vs AS rs, b.ve AS re FROM c a JOIN c b ON a.nxt = b.id AND a.src = b.src WHERE a.vs < 4102444800000 AND b.vs < 4102444800000)
      SELECT l AS left_id, r AS right_id, 'left' AS role, l AS edge_id, greatest(ls, 0) AS valid_start, least(coalesce(le, 4102444800000), 4102444800000) AS valid_end FROM p
      UNION ALL SELECT l, r, 'right', r, greatest(rs, 0), least(coalesce(re, 4102444800000), 4102444800000) FROM p""",
    "diff_attachments": f"""WITH a AS (SELECT * FROM {_edges_known(T1)}), b AS (SELECT * FROM {_edges_known(T2)}), na AS (SELECT DISTINCT unnest([src, dst]) AS id FROM a), nb AS (SELECT DISTINCT unnest([src, dst]) AS id FROM b),
      d AS (SELECT 'edge' AS host_kind, a.id AS x, b.id AS y FROM a FULL JOIN b ON a.id = b.id UNION ALL SELECT 'node', na.id, nb.id FROM na FULL JOIN nb ON na.id = nb.id)
      SELECT host_kind, CASE WHEN y IS NULL THEN 'removed' ELSE 'added' END AS value, count(*) AS n FROM d WHERE x IS NULL OR y IS NULL GROUP BY ALL""",
    "union_by_origin": "SELECT 'alias:customer:' || c_custkey AS id, 'customer:' || c_custkey AS entity_id FROM customer",
    "support_states": f"""WITH {_STAR}, s AS (SELECT dst, count(*) FILTER (WHERE {at("e", V1)} AND polarity = 'positive') AS p, count(*) FILTER (WHERE {at("e", V1)} AND polarity = 'negative') AS q FROM e WHERE predicate = 'contains' GROUP BY dst)
      SELECT CASE WHEN p > 0 AND q > 0 THEN 'conflicted' WHEN p > 0 THEN 'supported' WHEN q > 0 THEN 'refuted' ELSE 'unknown' END AS state, count(*) AS n_claims, CAST(sum(p + q) AS BIGINT) AS n_proofs FROM s GROUP BY 1""",
    "reason_graph": f"""WITH {_STAR}, f AS (SELECT DISTINCT l.src, r.dst, greatest(l.vs, r.vs) AS vs FROM {_ORDERED})
      SELECT predicate, polarity, count(*) AS n, count(DISTINCT id) AS n_ids FROM e WHERE predicate IN ('placed_by', 'in_nation') GROUP BY ALL UNION ALL SELECT 'from', 'positive', count(*), count(*) FROM f""",
    "cluster_graph": """WITH k AS (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1), m AS (SELECT sum(least(c, 2)) AS merges, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS leaves FROM k)
      SELECT 'cluster:member' AS predicate, CAST(2 * merges AS BIGINT) AS n FROM m UNION ALL SELECT 'cluster:frontier', CAST(leaves - merges AS BIGINT) FROM m
      UNION ALL SELECT 'Leaf', leaves FROM m UNION ALL SELECT 'Cluster', CAST(merges AS BIGINT) FROM m UNION ALL SELECT 'Manifest', 1""",
    "metadata_graphs": """WITH o AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN o ON o_custkey = c_custkey)
      SELECT 'order:' || o_orderkey AS graph_id, CAST(0 AS BIGINT) AS depth FROM o UNION ALL SELECT 'customer:' || c_custkey, 1 FROM c UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, 2 FROM c""",
    "unit_changes": f"""SELECT coalesce(x.unit, y.unit) AS unit, 'edge' AS kind, coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'added' WHEN y.id IS NULL THEN 'removed' ELSE 'corrected' END AS change
      FROM {_units(T1)} x FULL JOIN {_units(T2)} y ON x.unit = y.unit AND x.id = y.id WHERE x.id IS NULL OR y.id IS NULL OR x.b <> y.b""",
    "facts_selected": f"SELECT DISTINCT line, position, id, predicate FROM fact_log WHERE kind = 'edge' AND (valid_from IS NULL OR (valid_from <= {T1} AND (valid_to IS NULL OR valid_to > {T1}))) AND recorded_at_ms >= {T1 - 10**10} AND recorded_at_ms < {T2}",
    "event_counts": "SELECT graph_id, count(DISTINCT (line, seq)) AS n_events, count(DISTINCT (line, position)) AS n_operations FROM fact_log GROUP BY graph_id",
    "accepted_latest": f"WITH {_DECISIONS} {_accepted(None)}",
    "accepted_as_of": f"WITH {_DECISIONS} {_accepted(T2)}",
    "accepted_range": f"WITH {_DECISIONS} SELECT * FROM ({_accepted(T1)}) UNION ALL SELECT feed, scope, revision, decision_id, decided_at FROM x WHERE decided_at > {T1} AND decided_at < {T2}",
    "import_round_trip": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE CAST(c_custkey AS VARCHAR) LIKE '%7') AS r, count(*) FILTER (WHERE CAST(c_custkey AS VARCHAR) LIKE '%5') AS gone FROM customer), k AS (SELECT count(*) AS m FROM nation),
      t AS (SELECT '{"first": ' || (2 * n + m) || ', "again": 0}' AS told FROM c, k)
      SELECT 'node' AS kind, 'corrected' AS content, r AS n, told FROM c, t UNION ALL SELECT 'node', 'as given', n - r + m, told FROM c, k, t UNION ALL SELECT 'edge', 'as given', n - gone, told FROM c, t""",
    "node_mapping": "SELECT DISTINCT 'work_order:' || work_order AS id, epoch_us(started_at) // 1000 AS valid_start, CAST((CASE WHEN kind IS NULL THEN 0 ELSE 1 END) + (CASE WHEN performed_by IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_properties, kind FROM maintenance",
    "view_generations": f"WITH {_FLEET} {_generation(1, None, _view(T1))} UNION ALL {_generation(2, _view(T1), _view((T1 + T2) // 2))} UNION ALL {_generation(3, _view((T1 + T2) // 2), _view(T2))}",
    "program_nested": f"""WITH {_STAR}, j AS (SELECT greatest(l.vs, r.vs) AS vs FROM {_ORDERED} AND l.dst IN (SELECT id FROM n WHERE len(readers) = 0 OR list_contains(readers, 'alice')))
      SELECT 'ordered_from' AS predicate, count(*) AS n, min(greatest(vs, {V1 - 10**10})) AS first, CAST({V1} AS BIGINT) AS last FROM j WHERE vs < {V1} UNION ALL SELECT 'in_region', count(*), 0, NULL FROM nation""",
    "nearest_valid": f"""WITH {_EMB} SELECT id, round(s, 6) AS score, rank FROM (SELECT v.vec_id AS id, {_cos("v.embedding", "q.embedding")} AS s, row_number() OVER (ORDER BY {_cos("v.embedding", "q.embedding")}, v.vec_id) AS rank
      FROM em v, (SELECT * FROM em WHERE vec_id = 10) q WHERE v.vec_id <> 10 AND v.label <> q.label AND v.lo <= 12 AND (v.hi IS NULL OR v.hi > 12)) WHERE rank <= 10""",
    "nearest_vectors": f"""SELECT id, space_id, round(s, 6) AS distance FROM (SELECT CAST(v.vec_id AS VARCHAR) AS id, 's1' AS space_id, {_cos("v.embedding", "q")} AS s FROM embeddings v, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE v.label % 2 = 1) ORDER BY s, id LIMIT 10""",
    "similar_valid": f"""WITH {_EMB}, k AS (SELECT * FROM (SELECT q.vec_id AS a, v.vec_id AS b, {_cos("q.embedding", "v.embedding")} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cos("q.embedding", "v.embedding")}, v.vec_id) AS rank
      FROM em q JOIN em v ON q.vec_id <> v.vec_id AND q.label <> v.label AND {_OVERLAP} WHERE q.vec_id % 100 = 0) WHERE rank <= 5)
      SELECT least(a, b) AS low, greatest(a, b) AS high, round(min(s), 6) AS score FROM k WHERE s <= 0.95 GROUP BY 1, 2""",
    "splitmix_numbers": f"""WITH s AS (SELECT p_partkey, CAST((42::UHUGEINT + (p_partkey + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % {_WRAP} AS UBIGINT) AS z FROM part),
      a AS (SELECT p_partkey, CAST((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {_WRAP} AS UBIGINT) AS z FROM s),
      b AS (SELECT p_partkey, CAST((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {_WRAP} AS UBIGINT) AS z FROM a)
      SELECT p_partkey, CAST(CASE WHEN y >= 9223372036854775808 THEN y::HUGEINT - 18446744073709551616::HUGEINT ELSE y END AS BIGINT) AS number FROM (SELECT p_partkey, xor(z, z >> 31) AS y FROM b)""",
}
