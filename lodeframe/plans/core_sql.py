"""SQL that DuckDB runs on the same tables, for the general problems."""

ID = "lower(replace(trim({c}, ' \t\r\n\f\v'), '-', ''))"


def _id(c: str) -> str:
    return ID.format(c=c)


def _ref(c: str) -> str:
    return f"CASE WHEN {_id(c)} NOT IN ('', repeat('0', 36)) THEN {_id(c)} END"


def _p1(table: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, from_id FROM (SELECT {_ref('from_id')} AS from_id, count(*) AS n FROM {table} GROUP BY 1) "
        f"WHERE from_id IS NOT NULL AND n >= 0.02 * (SELECT count(*) FROM {table})"
    )


def _totals(table: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, from_id, count(*)::BIGINT AS n_rows, round(sum(CASE WHEN isnan(weight) THEN NULL ELSE weight END::DECIMAL(28,6))::DOUBLE, 4) AS sum_weight, "
        f"max(created_at) AS last_created_at FROM (SELECT {_ref('from_id')} AS from_id, weight, created_at FROM {table}) WHERE from_id IS NOT NULL GROUP BY from_id"
    )


P3 = f"""
WITH last AS (
  SELECT source_table, run_no, arg_max(lower(trim(event)), (logged_at, log_no)) AS ev, arg_max(read_upto, (logged_at, log_no)) AS upto
  FROM run_log GROUP BY 1, 2),
rec AS (
  SELECT 'beings' AS source_table, {_id('id')} AS rec_id, updated_at AS rec_version, min(arrived_at) AS at FROM beings WHERE {_id('id')} <> '' GROUP BY 1, 2, 3)
SELECT r.source_table, coalesce((SELECT min(run_no) FROM last l WHERE l.source_table = r.source_table AND l.ev = 'succeeded' AND l.upto >= r.at),
  (SELECT coalesce(max(run_no), 0) + 1 FROM run_log l WHERE l.source_table = r.source_table)) AS run_no, rec_id, rec_version
FROM rec r
"""

P4 = f"""
WITH n AS (
  SELECT {_id('being_id')} AS being_id, tx_begin, coalesce(tx_end, 9223372036854775807) AS tx_end, created_at, node_no,
    struct_pack(s := core.status, n := core.name, c := coalesce(core.code, ''), w := core.weight, p := core.priority, k := coalesce(core.category, '')) AS a
  FROM version_nodes WHERE coalesce(tx_end, 9223372036854775807) > tx_begin),
d AS (SELECT *, row_number() OVER (PARTITION BY being_id, tx_begin ORDER BY created_at DESC, node_no DESC) AS rn FROM n),
v AS (SELECT being_id, tx_begin, least(tx_end, coalesce(lead(tx_begin) OVER w, 9223372036854775807)) AS tx_end, a FROM d WHERE rn = 1 WINDOW w AS (PARTITION BY being_id ORDER BY tx_begin)),
g AS (SELECT *, CASE WHEN lag(tx_end) OVER w = tx_begin AND lag(a) OVER w IS NOT DISTINCT FROM a THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY being_id ORDER BY tx_begin)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY being_id ORDER BY tx_begin ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT being_id, min(tx_begin) AS tx_begin, CASE WHEN max(tx_end) = 9223372036854775807 THEN -1 ELSE max(tx_end) END AS tx_end FROM i GROUP BY being_id, island
"""

ORPHANS = f"""
WITH par AS (
  SELECT id, min(created_at) AS born, arg_max(CASE WHEN tx_end IS NOT NULL THEN updated_at ELSE -1 END, (updated_at, tx_end IS NOT NULL)) AS dead FROM (
    SELECT {_id('id')} AS id, created_at, updated_at, tx_end FROM beings UNION ALL SELECT {_id('id')}, created_at, -1, NULL FROM defs) GROUP BY id),
ref AS (
  SELECT ord, 'from_id' AS side, {_ref('from_id')} AS id, created_at FROM relations UNION ALL SELECT ord, 'to_id', {_ref('to_id')}, created_at FROM relations),
j AS (SELECT r.*, p.born, nullif(p.dead, -1) AS dead, p.id IS NULL AS absent FROM ref r LEFT JOIN par p USING (id) WHERE r.id IS NOT NULL),
o AS (
  SELECT ord, side, 'missing' AS reason, created_at FROM j WHERE absent
  UNION ALL SELECT ord, side, 'late', created_at FROM j WHERE created_at < born
  UNION ALL SELECT ord, side, 'deleted', created_at FROM j WHERE created_at > dead)
"""


def core_sql() -> dict[str, str]:
    return {
        "p1_found": " UNION ALL ".join(_p1(t) for t in ("relations", "edge_records")),
        "p1_totals": " UNION ALL ".join(_totals(t) for t in ("relations", "edge_records")),
        "p4_found": P4,
        "p4_ledger": f"SELECT {_id('being_id')} AS being_id, tx_begin, coalesce(tx_end, 9223372036854775807) AS tx_end, created_at AS recorded_at, "
        f"coalesce(lead(created_at) OVER (PARTITION BY {_id('being_id')}, tx_begin ORDER BY created_at, node_no), -1) AS superseded_at, node_no, "
        "core.name AS name, coalesce(core.code, '') AS code, core.weight AS weight, coalesce(core.category, '') AS category FROM version_nodes WHERE coalesce(tx_end, 9223372036854775807) > tx_begin",
        "p5_found": ORPHANS + "SELECT ord, side, reason FROM o",
        "p5_report": ORPHANS + "SELECT side, reason, strftime(make_timestamp(created_at // 1000), '%Y-%m') AS month, count(*)::BIGINT AS n FROM o GROUP BY 1, 2, 3",
        "p3_beings": P3,
    }
