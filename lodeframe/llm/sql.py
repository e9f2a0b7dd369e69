"""SQL for DuckDB, where the result can be expressed in it.

p2: every member of a cluster is similar to every other, so the smallest similar id is the cluster's. p7: the tables of the comparison have fewer values per group than a sketch keeps, so its percentiles are exact there.
"""

from lodeframe.plans.core_sql import ID

_VALUES = f"""
WITH c AS (SELECT DISTINCT ON (chunk_no) * FROM projected_columns),
v AS (SELECT name, day, unnest(being_ids) AS being, unnest("values") AS value FROM c),
d AS (SELECT {ID.format(c='id')} AS id, arg_max("def", (updated_at, "def")) AS "def" FROM beings WHERE "def" IS NOT NULL GROUP BY 1),
j AS (SELECT v.name, d."def", v.day, v.value FROM v JOIN d ON d.id = {ID.format(c='v.being')} WHERE v.value IS NOT NULL AND NOT isnan(v.value))
"""

_NODES = f"""
SELECT {ID.format(c='id')} AS id, min(vector::DOUBLE[]) AS v FROM hnsw_nodes
WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
  AND {ID.format(c='id')} NOT IN ('', repeat('0', 36)) GROUP BY 1
"""

_CLUSTERS = f"""
WITH N AS ({_NODES})
SELECT a.id, min(b.id) AS cluster_id FROM N a JOIN N b ON list_cosine_similarity(a.v, b.v) >= 0.8 GROUP BY a.id HAVING count(*) > 1
"""


def llm_sql() -> dict[str, str]:
    return {
        "p2_found": _CLUSTERS,
        "p2_described": f"WITH C AS ({_CLUSTERS}), U AS (SELECT C.id, cluster_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM C JOIN ({_NODES}) n USING (id)), "
        "D AS (SELECT id, cluster_id, u, unnest(range(1, 65)) AS k FROM U), S AS (SELECT cluster_id, k, sum(u[k]) AS s FROM D GROUP BY 1, 2), T AS (SELECT cluster_id, list(s ORDER BY k) AS total FROM S GROUP BY 1), "
        "Z AS (SELECT id, cluster_id, round(list_cosine_similarity(u, total), 4) AS closeness FROM U JOIN T USING (cluster_id)), "
        "R AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY closeness DESC, id)::INTEGER AS rank, count(*) OVER (PARTITION BY cluster_id)::BIGINT AS size FROM Z) SELECT cluster_id, size, rank, id, closeness FROM R WHERE rank <= 5",
        "p7_percentiles": _VALUES
        + 'SELECT name, "def", count(*)::BIGINT AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM j GROUP BY 1, 2',
        "p7_days": _VALUES + 'SELECT name, "def", day::VARCHAR AS day, count(*)::BIGINT AS n FROM j GROUP BY 1, 2, 3',
    }
