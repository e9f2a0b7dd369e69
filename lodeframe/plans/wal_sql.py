"""SQL for the log: CRC-32 by its rule, and the state after the log."""

from lodeframe.plans.core_sql import ID, P3

_FIELDS = ("status", "name", "weight", "priority", "category")

#: seq, payload, arrived_at of the intact rows. The checksum's table is computed from its polynomial.
INTACT = """
T AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
H AS (SELECT rec_no, seq, payload, arrived_at, crc32, hex(encode(payload)) AS h FROM wal_records
  WHERE magic = '\\x57\\x41\\x4C\\x01'::BLOB AND payload IS NOT NULL AND strlen(payload) = payload_len AND seq IS NOT NULL),
Y AS (SELECT H.*, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM H),
INTACT AS (SELECT rec_no, seq, payload, arrived_at FROM Y, T WHERE xor(list_reduce(bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) = crc32)
"""

_STATE = f"""
WITH {INTACT},
S AS (SELECT seq, min(payload) AS payload FROM INTACT GROUP BY seq),
A AS (SELECT seq, payload FROM S QUALIFY (payload->>'$.tx_id') IS NULL OR row_number() OVER (PARTITION BY payload->>'$.tx_id' ORDER BY seq) = 1),
L AS (SELECT seq, json_extract(payload, '$.ops[*]') AS ops FROM A),
O AS (SELECT seq, unnest(ops) AS op, unnest(range(len(ops))) AS op_no FROM L),
C AS (SELECT {ID.format(c="(op->>'$.CreateBeing.being.core.id')")} AS id, seq, op_no, op FROM O WHERE (op->'$.CreateBeing') IS NOT NULL),
U AS (SELECT {ID.format(c="(op->>'$.UpdateBeing.id')")} AS id, seq, op_no, unnest(json_extract(op, '$.UpdateBeing.updates[*]')) AS u, unnest(range(len(json_extract(op, '$.UpdateBeing.updates[*]')))) AS set_no FROM O WHERE (op->'$.UpdateBeing') IS NOT NULL),
D AS (SELECT {ID.format(c="(op->>'$.DeleteBeing.id')")} AS id, seq, op_no FROM O WHERE (op->'$.DeleteBeing') IS NOT NULL),
LIFE AS (SELECT id, arg_max(kind, (seq, op_no)) AS kind FROM (SELECT id, seq, op_no, 'create' AS kind FROM C UNION ALL SELECT id, seq, op_no, 'delete' FROM D) GROUP BY id),
E AS ({" UNION ALL ".join(f"SELECT id, seq, op_no, 0 AS set_no, '{f}' AS field_name, op->>'$.CreateBeing.being.core.{f}' AS value FROM C" for f in _FIELDS)}
  UNION ALL SELECT id, seq, op_no, set_no, u->>'$.field_name', u->>'$.new_value' FROM U),
F AS (SELECT id, field_name, seq, value FROM E WHERE id IN (SELECT id FROM LIFE WHERE kind = 'create') AND field_name IN {_FIELDS}
  QUALIFY row_number() OVER (PARTITION BY id, field_name ORDER BY seq DESC, op_no DESC, set_no DESC) = 1)
"""


def wal_sql() -> dict[str, str]:
    pick = lambda f, kind: f"max(CASE WHEN field_name = '{f}' THEN value END)::{kind} AS {f}"
    records = P3.replace("WITH last AS", f"WITH {INTACT}, last AS", 1).replace(
        "GROUP BY 1, 2, 3)\nSELECT", "GROUP BY 1, 2, 3 UNION ALL SELECT 'wal_records', seq::VARCHAR, seq, min(arrived_at) FROM INTACT GROUP BY seq)\nSELECT"
    )
    state = _STATE + f"SELECT id, {pick('status', 'DOUBLE')}, {pick('name', 'VARCHAR')}, {pick('weight', 'DOUBLE')}, {pick('priority', 'DOUBLE')}, {pick('category', 'VARCHAR')} FROM F GROUP BY id"
    return {
        "p3_found": records,
        "p3_replayed": f"SELECT source_table, (run_no = (SELECT coalesce(max(run_no), 0) + 1 FROM run_log l WHERE l.source_table = r.source_table))::BIGINT AS batch, rec_id, rec_version FROM ({records}) r",
        "p6_found": _STATE + "SELECT id, field_name, seq FROM F",
        "p6_beings": state,
        "p6_merged": state,
    }
