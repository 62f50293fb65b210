"""SQL (DuckDB) for the queries of plans.problems, written from the definitions, not from the operators."""

from __future__ import annotations


def _ref(c: str, lower: bool = False) -> str:
    f = "lower" if lower else "upper"
    return f"CASE WHEN lower(trim({c})) IN ('', '-', 'n/a', 'none') THEN NULL ELSE {f}(trim({c})) END"


def _hold(t: str, key: str, by: str = "recorded_at") -> str:
    return f"(SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {by} DESC) = 1)"


_CASES = " UNION ALL ".join(
    f"SELECT '{src}' AS src_table, '{par}' AS parent_table, {key} AS record_key, strftime(recorded_at, '%Y-%m') AS ref_month, {_ref(ref, low)} AS k, recorded_at AS t FROM {src}"
    for src, key, ref, par, low in (
        ("part_installs", "install_id", "work_order", "maintenance", False),
        ("sensor_mounts", "mount_id", "sensor_id", "sensors", False),
        ("firmware_installs", "install_id", "firmware_id", "firmware", True)
    )
)
_TARGETS = " UNION ALL ".join(
    f"SELECT '{par}' AS parent_table, {_ref(key, low)} AS k, recorded_at AS r, deleted_at AS x FROM {par}" for par, key,
    low in (("maintenance", "work_order", False), ("sensors", "sensor_id", False), ("firmware", "firmware_id", True))
)
_ORPHANS = f"""WITH c AS ({_CASES}), p AS ({_TARGETS}), j AS (
  SELECT c.src_table, c.record_key, c.ref_month, c.k, c.parent_table, c.t, count(p.k) AS n, count(*) FILTER (WHERE p.r <= c.t) AS seen,
         count(*) FILTER (WHERE p.r <= c.t AND (p.x IS NULL OR c.t < p.x)) AS standing
  FROM (SELECT DISTINCT *, count(*) OVER (PARTITION BY src_table, record_key, t, k) AS copies FROM c WHERE k IS NOT NULL) c LEFT JOIN p ON p.parent_table = c.parent_table AND p.k = c.k GROUP BY ALL)
SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN seen > 0 THEN 'deleted' ELSE 'late' END AS reason FROM j WHERE standing = 0"""

_FACTS = """SELECT line, kind, id, seq FROM (SELECT *, row_number() OVER (PARTITION BY line, kind, id ORDER BY position DESC, received_at DESC) AS rn FROM fact_log) WHERE rn = 1 AND lower(trim(op)) <> 'retract'"""

_LINKS = f"""h AS {_hold("part_installs", "install_id")}, links AS (
  SELECT h.install_id AS child, p.install_id AS parent FROM h JOIN h AS p ON {_ref("h.replaces")} = upper(trim(p.part_serial)))"""
_TREE = f"""{_LINKS}, walk AS (
  SELECT parent AS node, parent AS root, 0 AS depth, [parent] AS path FROM (SELECT DISTINCT parent FROM links WHERE parent NOT IN (SELECT child FROM links))
  UNION ALL SELECT l.child, w.root, w.depth + 1, list_append(w.path, l.child) FROM walk w JOIN links l ON l.parent = w.node)"""

_KNOWN = """e AS (SELECT work_order, serial, epoch_us(started_at) AS s FROM (SELECT * FROM maintenance QUALIFY row_number() OVER (PARTITION BY work_order ORDER BY recorded_at DESC) = 1) WHERE started_at IS NOT NULL AND deleted_at IS NULL)"""


def _known(t: str, attr: str) -> str:
    return f"""(SELECT * FROM (SELECT e.work_order, e.s, f.install_id, f.valid_from, f.valid_to, {attr} AS v,
      row_number() OVER (PARTITION BY e.work_order, f.install_id ORDER BY f.recorded_at DESC) AS rn
      FROM e JOIN {t} f ON f.serial = e.serial AND epoch_us(f.recorded_at) <= e.s) WHERE rn = 1 AND epoch_us(valid_from) <= s AND (valid_to IS NULL OR s < epoch_us(valid_to)))"""


def _ms(c: str) -> str:
    t = f"upper(trim({c}))"
    return f"""CASE WHEN regexp_full_match({t}, '[+-]?[0-9]{{1,18}}') THEN CAST({t} AS BIGINT)
      WHEN regexp_full_match({t}, '\\d{{4}}-\\d\\d-\\d\\d') THEN epoch_ms(TRY_CAST({t} AS TIMESTAMP))
      WHEN regexp_full_match({t}, '\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d(:\\d\\d([.]\\d+)?)?') THEN epoch_ms(TRY_CAST({t} AS TIMESTAMP))
      WHEN regexp_full_match({t}, '\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d(:\\d\\d([.]\\d+)?)?(Z|[+-]\\d\\d:\\d\\d)') THEN epoch_ms(TRY_CAST({t} AS TIMESTAMPTZ)) END"""


_REPORTS = f"""r AS (SELECT seq, coalesce(source, '') AS source, work_order, t0, ended, reported, t0 - ((t0 - 345600000) % 604800000 + 604800000) % 604800000 AS ps FROM (
  SELECT seq, source, {_ref("m.work_order")} AS work_order, {_ms("m.started_at")} AS t0, {_ms("m.ended_at")} AS ended, {_ms("reported_at")} AS reported
  FROM (SELECT seq, source, reported_at, unnest(tables.maintenance) AS m FROM {_hold("updates", "seq", "received_at")})) WHERE t0 IS NOT NULL AND reported IS NOT NULL)"""

SQL = {
    "p1_found": f"SELECT DISTINCT src_table, record_key, ref_month, reason FROM ({_ORPHANS})",
    "p1_counts": f"SELECT src_table, parent_table, ref_month, reason, CAST(sum(copies) AS BIGINT) AS n_rows, count(DISTINCT k) AS n_keys FROM ({_ORPHANS.replace('c.t, count(p.k)', 'c.t, c.copies, count(p.k)')}) GROUP BY ALL",
    "p2_found": f"""SELECT 'fact_log' AS feed, CAST(line AS BIGINT) AS line, kind, id, CAST(seq AS BIGINT) AS seq FROM ({_FACTS})
      UNION ALL SELECT 'updates', 0, 'maintenance', wo, CAST(seq AS BIGINT) FROM (SELECT wo, max(seq) AS seq, max_by(k, seq) AS k FROM (
        SELECT seq, replace(lower(trim(kind)), '-', '_') AS k, {_ref("m.work_order")} AS wo FROM (SELECT seq, kind, unnest(tables.maintenance) AS m FROM {_hold("updates", "seq", "received_at")})) WHERE wo IS NOT NULL GROUP BY wo) WHERE k IS DISTINCT FROM 'withdrawal'""",
    "p2_lines": f"SELECT line, kind, count(*) AS n_facts, max(seq) AS last_seq FROM ({_FACTS}) GROUP BY ALL",
    "p3_found": f"""WITH RECURSIVE {_TREE} SELECT l.child AS install_id, coalesce(w.root, 'cycle') AS root_install_id, CAST(coalesce(w.depth, -1) AS BIGINT) AS depth FROM links l LEFT JOIN walk w ON w.node = l.child""",
    "p3_paths": f"""WITH RECURSIVE {_TREE} SELECT l.child AS install_id, coalesce(w.root, 'cycle') AS root_install_id, CAST(coalesce(w.depth, -1) AS BIGINT) AS depth, array_to_string(w.path, '>') AS path FROM links l LEFT JOIN walk w ON w.node = l.child""",
    "p3_later": f"""WITH RECURSIVE {_TREE} SELECT a AS install_id, count(*) AS n_later, CAST(max(depth - d) AS BIGINT) AS height FROM (SELECT unnest(path[:-2]) AS a, unnest(range(len(path) - 1)) AS d, depth FROM walk WHERE depth > 0) GROUP BY a""",
    "p3_cycles": f"""WITH RECURSIVE {_TREE} SELECT child AS install_id, parent AS replaced_install_id FROM links WHERE child NOT IN (SELECT node FROM walk)""",
    "p4_found": f"""WITH {_KNOWN}
      SELECT work_order, 'firmware_id' AS field, v AS known_value FROM (SELECT *, row_number() OVER (PARTITION BY work_order ORDER BY valid_from DESC, CAST(regexp_extract(install_id, '([0-9]+)$', 1) AS HUGEINT) DESC) AS best FROM {_known("firmware_installs", _ref("f.firmware_id", True))}) WHERE best = 1 AND v IS NOT NULL
      UNION ALL SELECT DISTINCT work_order, 'part_serial', v FROM {_known("part_installs", "f.part_serial")} WHERE v IS NOT NULL""",
    "p5_found": f"""WITH i AS (
      SELECT 'firmware_installs' AS src_table, serial AS entity, epoch_ms(valid_from) AS s, coalesce(epoch_ms(valid_to), 9000000000000000000) AS e FROM {_hold("firmware_installs", "install_id")}
      UNION ALL SELECT 'sensor_mounts', {_ref("sensor_id")}, epoch_ms(valid_from), coalesce(epoch_ms(valid_to), 9000000000000000000) FROM {_hold("sensor_mounts", "mount_id")}),
      o AS (SELECT *, max(e) OVER (PARTITION BY src_table, entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE entity IS NOT NULL AND s IS NOT NULL AND e > s),
      g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY src_table, entity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM o),
      p AS (SELECT src_table, entity, min(s) AS s, max(e) AS e FROM g GROUP BY src_table, entity, grp)
      SELECT src_table, entity, 'period' AS what, s AS start_ms, CASE WHEN e = 9000000000000000000 THEN -1 ELSE e END AS end_ms FROM p
      UNION ALL SELECT src_table, entity, 'gap', e, n FROM (SELECT *, lead(s) OVER (PARTITION BY src_table, entity ORDER BY s) AS n FROM p) WHERE n IS NOT NULL""",
    "p6_found": f"""WITH {_REPORTS} SELECT DISTINCT CAST(seq AS BIGINT) AS seq, work_order, CASE WHEN reported <= ps + 604800000 + 1814400000 THEN 'corrects' ELSE 'too_late' END AS verdict FROM r WHERE reported >= ps + 604800000""",
    "p6_weeks": f"""WITH {_REPORTS}, v AS (SELECT *, CASE WHEN ended >= t0 THEN (ended - t0) / 3600000.0 ELSE 0.0 END AS hours, reported < ps + 604800000 AS ontime, reported <= ps + 604800000 + 1814400000 AS intime FROM r)
      SELECT ps AS period_start, count(*) FILTER (WHERE ontime) AS n_first, count(*) FILTER (WHERE intime) AS n_corrected, count(*) FILTER (WHERE NOT intime) AS n_diverted, round(sum(hours) FILTER (WHERE ontime), 4) AS hours_first, round(sum(hours) FILTER (WHERE intime), 4) AS hours_corrected FROM v GROUP BY ps""",
    "p6_closings": f"""WITH {_REPORTS}, w AS (SELECT DISTINCT ps + 604800000 AS pe FROM r), s AS (SELECT DISTINCT source FROM r), n AS (SELECT max(reported) AS now FROM r),
      x AS (SELECT w.pe, s.source, min(r.reported) FILTER (WHERE r.reported > w.pe + 1814400000) AS nxt, max(r.reported) FILTER (WHERE r.reported <= w.pe + 1814400000) AS prv FROM w CROSS JOIN s JOIN r ON r.source = s.source GROUP BY ALL),
      y AS (SELECT pe, now, CASE WHEN prv IS NULL THEN pe + 1814400000 ELSE least(nxt, CASE WHEN greatest(pe + 1814400000, prv + 2419200000) <= now THEN greatest(pe + 1814400000, prv + 2419200000) END) END AS a FROM x CROSS JOIN n)
      SELECT pe AS period_end, CASE WHEN count(a) = count(*) AND max(a) <= any_value(now) THEN max(a) END AS closed_at, count(*) AS n_sources FROM y GROUP BY pe""",
    "p7_found": f"""WITH u AS (SELECT feed, scope, pos, received_at, c FROM (
        SELECT 'fact_log' AS feed, CAST(line AS VARCHAR) AS scope, position AS pos, received_at, CAST(struct_pack(graph_id, branch_id, revision, parent, line, seq, position, op, kind, id, entity, subject, object, predicate, valid_from, valid_to, writer, on_behalf_of, recorded_at_ms, body) AS VARCHAR) AS c FROM fact_log
        UNION ALL SELECT 'updates', coalesce(source, ''), seq, received_at, CAST(struct_pack(seq, kind, reported_at, source, tables) AS VARCHAR) FROM updates)),
      a AS (SELECT feed, scope, pos, c, min(received_at) AS first, max(received_at) AS last FROM u GROUP BY ALL),
      n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY feed, scope, pos ORDER BY last DESC) = 1),
      runs AS (SELECT * FROM {_hold("sync_runs", "run_id", "logged_at")} WHERE lower(trim(run_status)) = 'succeeded' AND scope <> '')
      SELECT feed, scope, CAST(pos AS BIGINT) AS pos FROM n WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.feed = n.feed AND r.scope = n.scope AND r.after_pos < n.pos AND n.pos <= r.upto_pos AND n.first <= r.started_at)""",
}
