"""Queries of the engine's own operators over the whole tables, each with the SQL that gives the same result."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.engine import DEFAULTS, Engine, load_config, save_config
from lodeframe.functions.ids import norm_id, time_bucket_ms
from lodeframe.model import Def, Field, FieldType, NotFound
from lodeframe.operators import aggregates, graph, predicates, temporal, validate, vectors
from lodeframe.operators.changefeed import intact
from lodeframe.operators.predicates import All, Any, Compare, condition_of
from lodeframe.operators.temporal import History
from lodeframe.plans import fixtures
from lodeframe.plans.core_sql import ID
from lodeframe.plans.fixtures import KIND, B, R, ns
from lodeframe.plans.logical import PlanStep, run_plan
from lodeframe.plans.wal_sql import INTACT
from lodeframe.sources.store import DocumentLog, Store, replay, replayable
from lodeframe.sources.tables import scratch_path, table
from lodeframe.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return keep


def _engine(spark: SparkSession, d: str) -> Engine:
    return Engine(spark, catalog=fixtures.catalog(spark, d))


def _b(sql: str) -> str:
    return f"WITH {B} {sql}"


def _br(sql: str) -> str:
    return f"WITH {B}, {R} {sql}"


# scans and lookups


@query(_b("""SELECT id, name, weight, priority FROM B WHERE "def" = 'Order'"""))
def scan_by_def(spark, d):
    return _engine(spark, d).query().scan("Order").select("name", "weight", "priority").execute()


@query(_b('SELECT id, "def" FROM B'))
def scan_all(spark, d):
    return _engine(spark, d).query().scan().select("def").execute()


@query(_b('SELECT id, "def", name, weight, priority, category FROM B WHERE id = \'c:42\''))
def point_lookup(spark, d):
    return _engine(spark, d).query().being("c:42").select("def", "name", "weight", "priority", "category").execute()


_T0, _T1 = 1704672000000000000, 1705276800000000000


@query(f"SELECT DISTINCT 'e:' || event_id AS id FROM events WHERE epoch_us(ts) // 1000000 * 1000 >= {_T0 // 10**6} AND epoch_us(ts) // 1000000 * 1000 < {_T1 // 10**6}")
def time_range_bucket(spark, d):
    """Ids whose one-second bucket lies in a half-open range of buckets: whole seconds, so bounds that reach the scan."""
    second = 10**9
    q = _engine(spark, d).query().scan("Event").filter("created_at", ">=", _T0 // second * second).filter("created_at", "<", _T1 // second * second)
    bucket = time_bucket_ms(F.col("created_at"))
    return q.where((bucket >= time_bucket_ms(F.lit(_T0))) & (bucket < time_bucket_ms(F.lit(_T1)))).select("id").execute().distinct()


@query(f"SELECT 'e:' || event_id AS id FROM events WHERE epoch_us(ts) * 1000 >= {_T0} AND epoch_us(ts) * 1000 < {_T1}")
def time_range_exact(spark, d):
    return _engine(spark, d).query().scan("Event").filter("created_at", ">=", _T0).filter("created_at", "<", _T1).select("id").execute()


def _document_log(spark: SparkSession, d: str) -> DocumentLog:
    """All documents in two appends, a copy of the store of raw documents."""
    rows = table(spark, d, "documents").select(
        F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("being_id"), F.lit("Document").alias("def"), "doc_id", F.lit(0).alias("stamp"), F.to_json(F.struct("lang", "source")).alias("core"), F.col("text").alias("ext")
    )
    log = DocumentLog(spark, _scratch(spark))
    log.append(rows.where("doc_id % 2 = 0"))
    log.append(rows.where("doc_id % 2 = 1"))
    return log


@query("SELECT 'd:' || doc_id AS being_id, text AS ext FROM documents WHERE doc_id = 17")
def raw_doc_find(spark, d):
    return _document_log(spark, d).find("d:17").select("being_id", "ext")


@query("SELECT 'd:' || doc_id AS being_id, 'Document' AS \"def\", md5(text) AS ext, lang FROM documents")
def raw_doc_scan(spark, d):
    return _document_log(spark, d).scan().select("being_id", "def", F.md5("ext").alias("ext"), F.get_json_object("core", "$.lang").alias("lang"))


@query("SELECT count(*)::BIGINT AS n FROM documents")
def raw_doc_count(spark, d):
    return spark.createDataFrame([(_document_log(spark, d).count(),)], "n long")


@query(_b("""SELECT id, weight FROM B WHERE "def" = 'Part'"""))
def column_projection(spark, d):
    return _engine(spark, d).query().scan("Part").select("weight").execute()


@query("SELECT 'e:' || event_id AS id, (props->>'$.k')::DOUBLE AS k FROM events")
def ext_attr_projection(spark, d):
    b = _engine(spark, d).catalog.beings.where("def = 'Event'")
    return b.select("id", predicates.attribute("k", 0.0).alias("k"))


@query(
    "WITH c AS (SELECT DISTINCT ON (chunk_no) * FROM projected_columns), v AS (SELECT chunk_no, name, unnest(being_ids) AS id, unnest(\"values\") AS value, unnest(range(len(being_ids))) AS pos FROM c) "
    f"SELECT name, {ID.format(c='id')} AS id, arg_min(value, (chunk_no, pos)) AS value FROM v WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2"
)
def first_value_by_id(spark, d):
    """The first number written for each id in each projected column."""
    chunks = table(spark, d, "projected_columns").dropDuplicates(["chunk_no"])
    rows = chunks.select("chunk_no", "name", F.posexplode(F.arrays_zip("being_ids", "values")).alias("pos", "e"))
    rows = rows.select("chunk_no", "name", "pos", norm_id("e.being_ids").alias("id"), F.col("e.values").alias("value")).where("value is not null and not isnan(value)")
    return aggregates.first_written(rows, ["name", "id"], "value", ["chunk_no", "pos"])


@query(f"SELECT {ID.format(c='id')} AS id, (('0x' || substr({ID.format(c='id')}, 5, 12))::BIGINT) AS created_ms FROM beings")
def id_times(spark, d):
    """The time held in each id."""
    from lodeframe.functions.ids import id_created_ms

    return table(spark, d, "beings").select(norm_id("id").alias("id"), id_created_ms("id").alias("created_ms"))


# filters


def _filter(name: str, field: str, op: str, value: object, target: str = "Order") -> None:
    sign = {"==": "=", "!=": "<>"}.get(op, op)
    text = f"'{value}'" if isinstance(value, str) else str(value)

    def run(spark, d):
        return _engine(spark, d).query().scan(target).filter(field, op, value).select("id").execute()

    QUERIES[name] = run
    SQL[name] = _b(f"SELECT id FROM B WHERE \"def\" = '{target}' AND {field} {sign} {text}")


_filter("filter_eq_num", "priority", "==", 2)
_filter("filter_eq_str", "category", "==", "BUILDING", "Customer")
_filter("filter_ne", "priority", "!=", 3)
_filter("filter_gt", "weight", ">", 100000)
_filter("filter_lt", "weight", "<", 20000.5)
_filter("filter_gte", "status", ">=", 2)
_filter("filter_lte", "priority", "<=", 2)
_filter("filter_negative_literal", "weight", "<", -500.5, "Customer")


@query(_b("""SELECT id, name FROM B WHERE "def" = 'Order' AND weight > 100000 AND priority = 1"""))
def filter_and(spark, d):
    return _engine(spark, d).execute_dsl("query { Order(filter: {weight > 100000} and {priority: 1}) { id, name } }")


@query(_b("""SELECT id, name FROM B WHERE "def" = 'Order' AND (status = 3 OR priority = 5)"""))
def filter_or(spark, d):
    return _engine(spark, d).execute_dsl("query { Order(filter: {status: 3} or {priority: 5}) { id, name } }")


@query(_b("""SELECT id, name FROM B WHERE "def" = 'Order' AND (status = 3 OR priority = 5 AND weight < 30000)"""))
def filter_and_or_precedence(spark, d):
    return _engine(spark, d).execute_dsl("query { Order(\n  filter: {status: 3} or {priority: 5} and {weight < 3e4}\n) { id name } }")


@query("SELECT 'e:' || event_id AS id FROM events WHERE (props->>'$.k')::DOUBLE > 50")
def filter_ext_attr(spark, d):
    return _engine(spark, d).query().scan("Event").filter("k", ">", 50).select("id").execute()


def _filter_dsl(name: str, target: str, cond: str, sql: str) -> None:
    def run(spark, d):
        return _engine(spark, d).execute_dsl(f"query {{ {target}(filter: {cond}) {{ id }} }}")

    QUERIES[name] = run
    SQL[name] = _b(f"SELECT id FROM B WHERE \"def\" = '{target}' AND {sql}")


_filter_dsl("filter_not", "Order", "not {priority: 3} and not ({status: 1} or {weight > 100000})", "NOT priority = 3 AND NOT (status = 1 OR weight > 100000)")
_filter_dsl("filter_in", "Customer", '{category in ["BUILDING", "MACHINERY"]} and {priority not in [1, 2, 3]}', "category IN ('BUILDING', 'MACHINERY') AND priority NOT IN (1, 2, 3)")
_filter_dsl("filter_between", "Order", "{weight between [1000, 50000.5]} or {priority not between [2, 5]}", "(weight BETWEEN 1000 AND 50000.5 OR priority NOT BETWEEN 2 AND 5)")
_filter_dsl("filter_like", "Part", '{name like "red%"} or {code like "Brand#_"}', "(name LIKE 'red%' OR code LIKE 'Brand#_')")
_filter_dsl("filter_is_null", "Document", "{category is null}", "category IS NULL")
_filter_dsl("filter_is_not_null", "Document", "{category is not null} and {weight is null}", "category IS NOT NULL AND weight IS NULL")
_filter_dsl("filter_fields", "Order", "{priority > status}", "priority > status")
_filter_dsl("filter_type_mismatch", "Order", "{name > 3} or {priority: 5}", "priority = 5")


@query(_b("""SELECT id FROM B WHERE "def" = 'Part' AND (name LIKE '%bolt' AND category NOT IN ('SMALL') OR weight BETWEEN 900 AND 950) AND NOT priority = 7 AND category IS NOT NULL"""))
def filter_builder(spark, d):
    """The same conditions from the builder."""
    named = All((condition_of("name", "like", "%bolt"), condition_of("category", "not in", ["SMALL"])))
    q = _engine(spark, d).query().scan("Part").where(Any((named, condition_of("weight", "between", (900, 950)))))
    return q.filter("priority", "not ==", 7).filter("category", "is not null").select("id").execute()


@query(_b("""SELECT id FROM B WHERE "def" = 'Order' AND weight > priority * 50000"""))
def filter_closure(spark, d):
    """A condition of one's own, as a function of the attributes."""
    return _engine(spark, d).query().scan("Order").where(lambda attribute: attribute("weight") > attribute("priority") * 50000).select("id").execute()


@query(f"SELECT ({6 * KIND} + o_orderkey) // 1024 AS granule, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY 1 HAVING max(o_totalprice) >= 400000 AND min(o_totalprice) <= 500000")
def granule_prune(spark, d):
    b = _engine(spark, d).catalog.beings.where("def = 'Order'")
    return aggregates.prune_granules(aggregates.granule_stats(b, "ord", "weight", 1024), 400000, 500000)


# projections, limits, order


@query(_b("""SELECT id, name AS label, weight, code FROM B WHERE "def" = 'Part'"""))
def dsl_project(spark, d):
    return _engine(spark, d).execute_dsl("query { Part { id, label: name, weight, code } }")


@query(_b("""SELECT id, name FROM B WHERE "def" = 'Order' AND weight > 50000 ORDER BY ord LIMIT 25"""))
def dsl_limit_after_filter(spark, d):
    return _engine(spark, d).execute_dsl("query { Order(filter: {weight > 50000}, limit: 25) { id, name } }")


@query(_b("""SELECT id, name FROM (SELECT * FROM B WHERE "def" = 'Order' ORDER BY ord LIMIT 100) WHERE weight > 50000"""))
def scan_limit_before_filter(spark, d):
    return _engine(spark, d).query().scan("Order").scan_limit(100).filter("weight", ">", 50000).select("name").execute()


@query(_b("""SELECT id, name FROM B WHERE "def" = 'Customer' AND category = 'BUILDING' ORDER BY ord LIMIT 1"""))
def fetch_one(spark, d):
    row = _engine(spark, d).query().scan("Customer").filter("category", "==", "BUILDING").order_by("ord").select("name").fetch_one()
    return spark.createDataFrame([row] if row else [], "id string, name string")


@query(_b("""SELECT count(*)::BIGINT AS n FROM B WHERE FALSE"""))
def limit_zero(spark, d):
    q = _engine(spark, d).query().scan("Order")
    return q.limit(0).select("name").execute().union(q.scan_limit(0).select("name").execute()).agg(F.count(F.lit(1)).alias("n"))


@query(_b("""SELECT id, weight FROM B WHERE "def" = 'Order' ORDER BY weight DESC, ord LIMIT 20"""))
def order_by_topk(spark, d):
    return _engine(spark, d).execute_dsl("query { Order(orderBy: weight desc, limit: 20) { id, weight } }")


@query(_b("""SELECT category, round(avg(weight), 4) AS aggregate, count(weight)::BIGINT AS count FROM B WHERE "def" = 'Order' AND weight > 1000 GROUP BY 1 ORDER BY 1 LIMIT 3"""))
def plan_steps(spark, d):
    """A plan of steps instead of a query."""
    steps = [PlanStep("Scan", ("Order",)), PlanStep("Filter", (Compare("weight", ">", 1000),)), PlanStep("Aggregate", ("weight", "avg", "category")), PlanStep("Sort", ("category",)), PlanStep("Limit", (3,))]
    return run_plan(steps, _engine(spark, d).catalog).withColumn("aggregate", F.round("aggregate", 4))


@query(_b("""SELECT id, name, weight FROM B WHERE "def" = 'Part' AND weight > 950 ORDER BY weight DESC, ord LIMIT 7"""))
def plan_limit(spark, d):
    steps = [PlanStep("Scan", ("Part",)), PlanStep("Filter", (Compare("weight", ">", 950),)), PlanStep("Sort", ("weight", True)), PlanStep("Project", ("name", "weight")), PlanStep("Limit", (7,))]
    return run_plan(steps, _engine(spark, d).catalog)


# aggregates


def _aggregate(name: str, op: str, sql: str) -> None:
    def run(spark, d):
        out = _engine(spark, d).query().scan("Order").aggregate("weight", op).execute()
        return out.withColumn("aggregate", F.round("aggregate", 2))

    QUERIES[name] = run
    SQL[name] = f"SELECT round({sql}::DOUBLE, 2) AS aggregate, count(o_totalprice)::BIGINT AS count, '{op}' AS op FROM orders"


for _op, _sql in {
    "count": "count(o_totalprice)", "sum": "sum(o_totalprice)", "avg": "avg(o_totalprice)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "median": "median(o_totalprice)",
    "stddev": "stddev_pop(o_totalprice)", "variance": "var_pop(o_totalprice)", "percentile:90": "quantile_cont(o_totalprice, 0.9)", "count_distinct": "count(DISTINCT o_totalprice)",
}.items():
    _aggregate("agg_" + _op.split(":")[0], _op, _sql)


@query("SELECT 0.0::DOUBLE AS aggregate, 0::BIGINT AS count, 'sum' AS op")
def agg_empty(spark, d):
    return _engine(spark, d).query().scan("Order").filter("weight", "<", -1).aggregate("weight", "sum").execute()


@query("SELECT round(sum(o_totalprice), 2) AS aggregate, count(*)::BIGINT AS count, 'sum' AS op FROM orders WHERE o_totalprice > 150000")
def scan_filter_agg(spark, d):
    """Scan, filter and sum in one pass."""
    out = _engine(spark, d).query().scan("Order").filter("weight", "gt", 150000).aggregate("weight", "sum").execute()
    return out.withColumn("aggregate", F.round("aggregate", 2))


@query("SELECT round(avg(c_acctbal), 4) AS aggregate, count(*)::BIGINT AS count, 'avg' AS op FROM customer WHERE c_mktsegment = 'MACHINERY'")
def agg_dsl_filtered(spark, d):
    out = _engine(spark, d).execute_dsl('query { Customer(filter: {category: "MACHINERY"}, aggregate: {weight: AVG}) }')
    return out.withColumn("aggregate", F.round("aggregate", 4))


def _grouped(name: str, op: str, sql: str) -> None:
    def run(spark, d):
        out = _engine(spark, d).execute_dsl(f"query {{ Order(aggregate: {{weight: {op}}}, groupBy: [category]) }}")
        return out.withColumn("aggregate", F.round("aggregate", 2))

    QUERIES[name] = run
    SQL[name] = f"SELECT o_orderpriority AS category, round({sql}::DOUBLE, 2) AS aggregate, count(*)::BIGINT AS count FROM orders GROUP BY 1"


_grouped("group_by_sum", "sum", "sum(o_totalprice)")
_grouped("group_by_avg", "avg", "avg(o_totalprice)")
_grouped("group_by_count", "count", "count(o_totalprice)")
_grouped("group_by_median", "median", "median(o_totalprice)")


@query("SELECT event_type AS category, (props->>'$.k')::DOUBLE AS k, count(value)::BIGINT AS n FROM events GROUP BY 1, 2")
def group_by_ext(spark, d):
    b = _engine(spark, d).catalog.beings.where("def = 'Event'").select("category", predicates.attribute("k", 0.0).alias("k"), "weight")
    return aggregates.grouped_aggregate(b, ["category", "k"], F.col("weight"), "count").select("category", "k", F.col("count").alias("n"))


def _sets(kind: str) -> None:
    def run(spark, d):
        e = table(spark, d, "events").select(F.col("event_type").alias("category"), (F.col("user_id") % 10).alias("g"), "value")
        return aggregates.grouping_sets(e, ["category", "g"], F.col("value"), "sum", kind).withColumn("aggregate", F.round("aggregate", 2))

    QUERIES[f"group_by_{kind}"] = run
    SQL[f"group_by_{kind}"] = f"SELECT category, g, grouping(category, g)::BIGINT AS level, round(sum(value), 2) AS aggregate, count(value)::BIGINT AS count FROM (SELECT event_type AS category, user_id % 10 AS g, value FROM events) GROUP BY {kind} (category, g)"


_sets("rollup")
_sets("cube")


@query("SELECT event_type AS category, count(DISTINCT user_id % 10)::DOUBLE AS aggregate FROM events GROUP BY 1")
def agg_approx_count_distinct(spark, d):
    """Few values, of which the sketch gives the exact number."""
    e = table(spark, d, "events").select(F.col("event_type").alias("category"), (F.col("user_id") % 10).alias("g"))
    return aggregates.grouped_aggregate(e, ["category"], F.col("g"), "approx_count_distinct").select("category", "aggregate")


@query("SELECT * FROM (VALUES ('approx_median', TRUE), ('approx_percentile:99', TRUE)) t(op, within)")
def agg_approx_percentiles(spark, d):
    """Whether the share of orders up to an approximate percentile is the one asked for, but for the stated error."""
    out = []
    orders = _engine(spark, d).catalog.beings.where("def = 'Order'")
    for op, share in (("approx_median", 0.5), ("approx_percentile:99", 0.99)):
        got = aggregates.global_aggregate(orders, F.col("weight"), op).select("op", F.col("aggregate").alias("x"))
        rank = orders.crossJoin(F.broadcast(got)).groupBy("op").agg(F.avg((F.col("weight") <= F.col("x")).cast("int")).alias("upto"), F.avg((F.col("weight") < F.col("x")).cast("int")).alias("below"))
        out.append(rank.select("op", ((F.col("below") <= share + 0.0002) & (F.col("upto") >= share - 0.0002)).alias("within")))
    return out[0].unionByName(out[1])


# joins


@query(_br("SELECT round(sum(b.weight), 2) AS total, count(*)::BIGINT AS n FROM R r JOIN B b ON b.id = r.to_id WHERE r.from_id = 'c:1' AND r.relation_type = 3"))
def point_relation_agg(spark, d):
    c = _engine(spark, d).catalog
    e = graph.EdgeFilter.by_type(3).apply(graph.out_edges(c.relations, "c:1"))
    return e.join(c.beings, F.col("to_id") == F.col("id")).agg(F.round(F.sum(c.beings["weight"]), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query(_br("SELECT r.from_id AS id, string_agg(b.name, ',' ORDER BY r.ord DESC) AS relations, count(*)::INTEGER AS relation_count FROM R r JOIN B b ON b.id = r.to_id WHERE r.relation_type = 1 GROUP BY 1"))
def one_hop_names(spark, d):
    c = _engine(spark, d).catalog
    hits = c.beings.where("def = 'Region'").select("id")
    got = graph.neighbour_names(hits, graph.EdgeFilter.by_type(1).apply(c.relations), c.beings)
    return got.where("relations is not null").select("id", F.concat_ws(",", "relations").alias("relations"), "relation_count")


@query(_br("SELECT id FROM B WHERE \"def\" = 'Customer' AND id IN (SELECT from_id FROM R WHERE relation_type = 3)"))
def has_relation_semi(spark, d):
    c = _engine(spark, d).catalog
    return graph.connected(c.beings.where("def = 'Customer'"), graph.EdgeFilter.by_type(3).apply(c.relations)).select("id")


@query(_br("SELECT id FROM B WHERE \"def\" = 'Order' AND id NOT IN (SELECT from_id FROM R WHERE relation_type = 5 AND weight > 45)"))
def no_relation_anti(spark, d):
    """Orders without any item of more than 45."""
    c = _engine(spark, d).catalog
    return graph.connected(c.beings.where("def = 'Order'"), graph.EdgeFilter.by_type(5).apply(c.relations).where("weight > 45"), False).select("id")


@query(_b("SELECT name FROM B WHERE \"def\" = 'Nation' UNION SELECT name FROM B WHERE \"def\" = 'Region' EXCEPT SELECT name FROM B WHERE \"def\" = 'Nation' AND priority > 20"))
def set_operations(spark, d):
    q = _engine(spark, d).query()
    names = lambda x: x.select("name").execute().select("name")
    return names(q.scan("Nation")).union(names(q.scan("Region"))).distinct().exceptAll(names(q.scan("Nation").filter("priority", ">", 20)))


# graph


@query(_br("SELECT from_id, to_id, relation_type, ord FROM R WHERE from_id = 'n:3'"))
def out_edges(spark, d):
    return graph.out_edges(_engine(spark, d).catalog.relations, "n:3").select("from_id", "to_id", "relation_type", "ord")


@query(_br("SELECT from_id, to_id, relation_type, ord FROM R WHERE to_id = 's:7'"))
def in_edges(spark, d):
    return graph.in_edges(_engine(spark, d).catalog.relations, "s:7").select("from_id", "to_id", "relation_type", "ord")


@query(_br("SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT from_id AS id, 1 AS o, 0 AS i FROM R UNION ALL SELECT to_id, 0, 1 FROM R) GROUP BY 1"))
def degree(spark, d):
    return graph.degrees(_engine(spark, d).catalog.relations)


def _walk(depth: int, where: str = "TRUE", start: str = "r:1", edges: str = "R") -> str:
    return _br(
        f", X AS (SELECT from_id, to_id FROM {edges} WHERE {where}), W AS (WITH RECURSIVE w(id, depth) AS (SELECT '{start}', 0 UNION SELECT X.to_id, w.depth + 1 FROM w JOIN X ON X.from_id = w.id WHERE w.depth < {depth}) "
        "SELECT id, min(depth)::INTEGER AS depth FROM w GROUP BY id) "
    )


def _bfs(name: str, depth: int) -> None:
    def run(spark, d):
        c = _engine(spark, d).catalog
        return graph.bfs(c.relations, spark.createDataFrame([("r:1",)], "id string"), depth).select("id", "depth")

    QUERIES[name] = run
    SQL[name] = _walk(depth) + "SELECT id, depth FROM W"


_bfs("bfs_depth1", 1)
_bfs("bfs_depth2", 2)
_bfs("bfs_depth3", 3)


@query(_walk(3, "relation_type = 5 OR relation_type = 3", "c:1") + "SELECT id, depth FROM W")
def bfs_edge_filter(spark, d):
    r = _engine(spark, d).catalog.relations.where("relation_type in (3, 5)")
    return graph.bfs(r, spark.createDataFrame([("c:1",)], "id string"), 3).select("id", "depth")


@query(_walk(4, "relation_type = 5 AND weight <= 10 OR relation_type <> 5", "c:1") + "SELECT id, depth FROM W")
def bfs_max_weight(spark, d):
    r = _engine(spark, d).catalog.relations.where("relation_type <> 5").unionByName(graph.EdgeFilter(5, True, 10.0).apply(_engine(spark, d).catalog.relations))
    return graph.bfs(r, spark.createDataFrame([("c:1",)], "id string"), 4).select("id", "depth")


@query(_walk(2) + "SELECT W.depth, b.id, b.name, round(b.weight, 2) AS weight, b.priority FROM W JOIN B b ON b.id = W.id")
def bfs_column_read(spark, d):
    c = _engine(spark, d).catalog
    found = graph.bfs(c.relations, spark.createDataFrame([("r:1",)], "id string"), 2)
    return found.join(c.beings.select("id", "name", F.round("weight", 2).alias("weight"), "priority"), "id").select("depth", "id", "name", "weight", "priority")


@query(_walk(3) + "SELECT b.\"def\" AS \"def\", round(sum(b.weight), 2) AS total, count(*)::BIGINT AS n FROM W JOIN B b ON b.id = W.id GROUP BY 1")
def bfs_group_agg(spark, d):
    """A traversal, then an aggregate per def of what it reached."""
    c = _engine(spark, d).catalog
    found = graph.bfs(c.relations, spark.createDataFrame([("r:1",)], "id string"), 3)
    return found.join(c.beings.select("id", "def", "weight"), "id").groupBy("def").agg(F.round(F.sum("weight"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT 0 AS step, 'r:' || n_regionkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1 UNION ALL SELECT 1, 'n:' || c_nationkey FROM customer WHERE c_custkey = 1 UNION ALL SELECT 2, 'c:1'")
def shortest_path(spark, d):
    """The way from a region to a customer of its own."""
    c = _engine(spark, d).catalog
    nation = graph.in_edges(c.relations, "c:1").where("relation_type = 2").first().from_id
    region = graph.in_edges(c.relations, nation).where("relation_type = 1").first().from_id
    return graph.shortest_path(c.relations, region, "c:1", 8)


_STEPS = 3


@query(f"SELECT (n_nationkey * {_STEPS} + k)::INTEGER AS step, 'n:' || n_nationkey || '.' || k AS id FROM nation, range({_STEPS}) t(k)")
def shortest_path_long(spark, d):
    """A chain through all nations, some steps each, with edges back: 75 nodes in a row."""
    n = table(spark, d, "nation").select(F.explode(F.sequence(F.lit(0), F.lit(_STEPS - 1))).alias("k"), (F.col("n_nationkey") * _STEPS).alias("b")).select((F.col("b") + F.col("k")).alias("i"))
    name = lambda i: F.concat(F.lit("n:"), F.floor(i / _STEPS).cast("string"), F.lit("."), (i % _STEPS).cast("string"))
    i = F.col("i")
    on = n.select(name(i).alias("from_id"), name(i + 1).alias("to_id"), F.lit(True).alias("directed"), i.cast("long").alias("ord"))
    back = n.where("i % 10 = 9").select(name(i).alias("from_id"), name(F.floor(i / 2).cast("int")).alias("to_id"), F.lit(True).alias("directed"), (i + 1000).cast("long").alias("ord"))
    return graph.shortest_path(on.unionByName(back), "n:0.0", f"n:24.{_STEPS - 1}")


@query("WITH c AS (SELECT min(c_custkey) AS k FROM customer WHERE c_nationkey = 3) SELECT 0 AS step, 'n:3' AS id UNION ALL SELECT 1, 'c:' || k FROM c")
def dsl_shortest_path(spark, d):
    row = table(spark, d, "customer").where("c_nationkey = 3").orderBy("c_custkey").select("c_name").first()
    return _engine(spark, d).execute_dsl(f'analyze {{ shortest_path on NATION_3(to: "{row.c_name}") {{ }} }}').select("step", "id")


_EVERY = 'SELECT id FROM B WHERE "def" IN (\'Region\', \'Nation\', \'Customer\', \'Order\')', "SELECT from_id, to_id FROM R WHERE relation_type IN (1, 2, 3)"


def _pagerank_sql(rounds: int, nodes: str = _EVERY[0], edges: str = _EVERY[1]) -> str:
    out = [
        B, R, f"N AS ({nodes})", f"E AS ({edges})",
        "D AS (SELECT from_id, count(*) AS k FROM E GROUP BY 1)", "C AS (SELECT count(*)::DOUBLE AS n FROM N)", "P0 AS (SELECT id, 1 / n AS rank FROM N, C)",
    ]
    for i in range(rounds):
        out.append(f"S{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM P{i} WHERE id NOT IN (SELECT from_id FROM D))")
        out.append(f"G{i} AS (SELECT E.to_id AS id, sum(p.rank / D.k) AS got FROM P{i} p JOIN E ON E.from_id = p.id JOIN D ON D.from_id = p.id GROUP BY 1)")
        out.append(f"P{i + 1} AS (SELECT N.id, 0.15 / n + 0.85 * (lost / n + coalesce(got, 0)) AS rank FROM N CROSS JOIN C CROSS JOIN S{i} LEFT JOIN G{i} ON G{i}.id = N.id)")
    return "WITH " + ", ".join(out) + f" SELECT id, round(rank, 10) AS rank FROM P{rounds}"


@query(_pagerank_sql(5))
def pagerank_5(spark, d):
    c = _engine(spark, d).catalog
    nodes = c.beings.where(F.col("def").isin("Region", "Nation", "Customer", "Order"))
    return graph.pagerank(nodes, c.relations.where("relation_type in (1, 2, 3)"), 5).select("id", F.round("rank", 10).alias("rank"))


@query(_pagerank_sql(2, "SELECT id FROM B", "SELECT from_id, to_id FROM R"))
def dsl_analyze_pagerank(spark, d):
    return _engine(spark, d).execute_dsl("analyze { pagerank on NATION_3(limit: 2) { id rank } }").select("id", F.round("rank", 10).alias("rank"))


@query(_walk(1, start="n:3") + "SELECT W.depth, b.id, b.name, b.weight, b.priority FROM W JOIN B b ON b.id = W.id")
def dsl_analyze_dfs(spark, d):
    return _engine(spark, d).execute_dsl("analyze { dfs on NATION_3(limit: 1) { anything at all } }")


@query(
    _br(
        ", X AS (SELECT from_id, to_id, ord FROM R WHERE relation_type IN (1, 2)), "
        "W AS (WITH RECURSIVE w(id, depth, way) AS (SELECT 'r:1', 0, []::BIGINT[] UNION ALL SELECT X.to_id, w.depth + 1, list_append(w.way, -X.ord) FROM w JOIN X ON X.from_id = w.id WHERE w.depth < 2) SELECT * FROM w) "
        "SELECT row_number() OVER (ORDER BY way) - 1 AS pos, id, depth FROM W"
    )
)
def dfs_tree(spark, d):
    r = _engine(spark, d).catalog.relations.where("relation_type in (1, 2)")
    return graph.dfs(r, "r:1", 2)


@query()
def dfs_general(spark, d):
    """A depth-first walk of a graph with cycles and parallel edges."""
    return graph.dfs(_engine(spark, d).catalog.relations.where("relation_type <> 7"), "c:1", 3)


@query(
    _br(
        ", U AS (SELECT 'n:' || a.n_nationkey AS from_id, 'n:' || b.n_nationkey AS to_id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey), "
        "X AS (SELECT * FROM U UNION ALL SELECT to_id, from_id FROM U), "
        "W AS (WITH RECURSIVE w(id, depth) AS (SELECT 'n:6', 0 UNION SELECT X.to_id, w.depth + 1 FROM w JOIN X ON X.from_id = w.id WHERE w.depth < 2) SELECT id, min(depth)::INTEGER AS depth FROM w GROUP BY 1) "
        "SELECT id, depth FROM W"
    )
)
def undirected_bfs(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("x"), "n_regionkey"), n.select(F.col("n_nationkey").alias("y"), "n_regionkey")
    e = a.join(b, "n_regionkey").where("x < y")
    e = e.selectExpr("concat('n:', x) as from_id", "concat('n:', y) as to_id", "false as directed", "cast(x as bigint) * 100 + y as ord")
    return graph.bfs(e, spark.createDataFrame([("n:6",)], "id string"), 2).select("id", "depth")


@query(_walk(2, start="n:3") + "SELECT b.id, b.name, W.depth FROM W JOIN B b ON b.id = W.id")
def with_relations_2(spark, d):
    return _engine(spark, d).query().being("n:3").with_relations(2).select("name").execute()


@query(_walk(2, start="n:3") + "SELECT W.depth, b.id, b.name, b.weight, b.priority FROM W JOIN B b ON b.id = W.id")
def dsl_analyze_bfs(spark, d):
    return _engine(spark, d).execute_dsl("analyze { bfs on NATION_3(limit: 2) { } }")


# vectors


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector with the smallest vec_id (one row)."""
    return list(table(spark, d, "embeddings").orderBy("vec_id").limit(1).collect()[0].embedding)


_V = "WITH Q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), V AS (SELECT 'v:' || vec_id AS id, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_DISTANCE = {"cosine": "1 - list_cosine_similarity(v, q)", "l2": "list_distance(v, q)", "dot": "-list_inner_product(v, q)"}


def _knn(metric: str) -> None:
    def run(spark, d):
        rows = fixtures.vectors(spark, d)
        return vectors.knn(rows, _query_vector(spark, d), 10, metric).select("rank", "id", (F.round("distance", 6) + 0.0).alias("distance"))

    QUERIES[f"knn_{metric}"] = run
    SQL[f"knn_{metric}"] = f"{_V}, S AS (SELECT id, round({_DISTANCE[metric]}, 9) AS distance FROM V, Q) SELECT row_number() OVER (ORDER BY distance, id)::INTEGER AS rank, id, round(distance, 6) + 0.0 AS distance FROM S ORDER BY distance, id LIMIT 10"


for _m in _DISTANCE:
    _knn(_m)


@query(f"{_V} SELECT id, round(1 - list_cosine_similarity(v, q), 6) + 0.0 AS cosine, round(list_distance(v, q), 6) AS l2, round(list_inner_product(v, q), 6) AS dot FROM V, Q")
def vector_distances(spark, d):
    """The distance columns over the whole table."""
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    r = lambda c: F.round(c, 6)
    return fixtures.vectors(spark, d).select("id", (r(vectors.cosine_distance("vector", q)) + 0.0).alias("cosine"), r(vectors.l2_distance("vector", q)).alias("l2"), r(vectors.dot("vector", q)).alias("dot"))


@query(f"{_V} SELECT id, round(1 - list_inner_product(v, q), 6) + 0.0 AS cosine FROM V, Q")
def vector_cosine_of_units(spark, d):
    """The shorter form for vectors of length 1, as all are here."""
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    return fixtures.vectors(spark, d).select("id", (F.round(vectors.cosine_distance_of_units("vector", q), 6) + 0.0).alias("cosine"))


@query(f"{_V}, S AS (SELECT id, round(list_distance(v, q), 9) AS distance FROM V, Q ORDER BY distance, id LIMIT 5) SELECT id, round(distance, 6) + 0.0 AS distance FROM S")
def config_metric(spark, d):
    """The metric of an engine whose configuration was saved and loaded."""
    with tempfile.TemporaryDirectory() as at:
        save_config({**DEFAULTS, "engine": {"metric": "l2"}}, f"{at}/engine.toml")
        e = Engine(spark, catalog=fixtures.catalog(spark, d), config=load_config(f"{at}/engine.toml"))
    q = ", ".join(repr(float(x)) for x in _query_vector(spark, d))
    return e.execute_dsl(f"similar {{ Vec(query: [{q}], k: 5) {{ id whatever }} }}").select("id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"{_V}, S AS (SELECT id, round(-list_inner_product(v, q), 9) AS distance FROM V, Q ORDER BY distance, id LIMIT 10) SELECT id, round(distance, 6) + 0.0 AS distance FROM S")
def store_vectors(spark, d):
    """A vector field registered with a metric, all vectors inserted, and a search among them."""
    e = Engine(spark, _scratch(spark))
    e.register_vector_field("own", 64, "dot")
    e.write_batch(_engine(spark, d).query().scan("Vec").execute().drop("tx_begin"))
    e.insert_vectors("own", fixtures.vectors(spark, d).select("id", "vector"))
    return e.query().scan("Vec").similar_to(_query_vector(spark, d), 10, "own").select("id").execute().select("id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"{_V}, S AS (SELECT id, label, round(1 - list_cosine_similarity(v, q), 9) AS distance FROM V, Q ORDER BY distance, id LIMIT 50) SELECT id, round(distance, 6) + 0.0 AS distance FROM S WHERE label = (SELECT label FROM embeddings ORDER BY vec_id LIMIT 1)")
def knn_filtered(spark, d):
    """Conditions apply after the search."""
    label = table(spark, d, "embeddings").orderBy("vec_id").limit(1).collect()[0].label
    out = _engine(spark, d).query().scan("Vec").similar_to(_query_vector(spark, d), 50).filter("priority", "==", int(label)).select("id").execute()
    return out.select("id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(
    "WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), "
    "s AS (SELECT qid, vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 9) AS distance FROM embeddings, q), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM s) SELECT qid AS query_id, rank::INTEGER AS rank, vec_id AS id, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= 10"
)
def knn_batch(spark, d):
    """Every row whose id is divisible by 100 against all rows."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.knn_batch(e, e.where("id % 100 = 0"), 10).select("query_id", "rank", "id", (F.round("distance", 6) + 0.0).alias("distance"))


@query()
def ann_search(spark, d):
    """The same by the coarse index."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.CoarseIndex(e).search(e.where("id % 100 = 0"), 10)


@query()
def ann_recall(spark, d):
    """The share of the true ten nearest that the coarse index finds."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 100 = 0")
    return vectors.recall(vectors.CoarseIndex(e).search(q, 10), vectors.knn_batch(e, q, 10))


@query(f"{_V}, S AS (SELECT id, round(1 - list_cosine_similarity(v, q), 9) AS distance FROM V, Q ORDER BY distance, id LIMIT 5) SELECT id, 'vec-' || substr(id, 3) AS name, 'Vec' AS \"def\", round(distance, 6) + 0.0 AS distance FROM S")
def dsl_similar(spark, d):
    q = ", ".join(repr(float(x)) for x in _query_vector(spark, d))
    out = _engine(spark, d).execute_dsl(f"similar {{ Vec(query: [{q}], k: 5) {{ id }} }}")
    return out.select("id", "name", "def", (F.round("distance", 6) + 0.0).alias("distance"))


@query(
    f"{_V}, {B}, {R}, S AS (SELECT id, round(1 - list_cosine_similarity(v, q), 9) AS distance FROM V, Q ORDER BY distance, id LIMIT 5) "
    "SELECT S.id, string_agg(b.name, ',' ORDER BY r.ord DESC) AS relations, count(*)::INTEGER AS relation_count FROM S JOIN R r ON r.from_id = S.id JOIN B b ON b.id = r.to_id GROUP BY 1"
)
def similar_with_relations(spark, d):
    q = ", ".join(repr(float(x)) for x in _query_vector(spark, d))
    out = _engine(spark, d).execute_dsl(f"similar {{ Vec(query: [{q}], k: 5) {{ id }} }}")
    return out.select("id", F.concat_ws(",", "relations").alias("relations"), "relation_count")


@query(
    f"{_V}, {B}, {R}, S AS (SELECT id, round(1 - list_cosine_similarity(v, q), 9) AS distance FROM V, Q ORDER BY distance, id LIMIT 20), "
    "H AS (SELECT DISTINCT r.to_id AS id FROM S JOIN R r ON r.from_id = S.id) SELECT b.\"def\" AS \"def\", count(*)::BIGINT AS n, round(sum(b.weight), 2) AS total FROM H JOIN B b ON b.id = H.id GROUP BY 1"
)
def vector_graph_column(spark, d):
    """Neighbours of a vector, what they relate to, an aggregate of that."""
    c = _engine(spark, d).catalog
    hits = vectors.knn(c.vectors, _query_vector(spark, d), 20).select("id")
    reached = c.relations.join(hits.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    return c.beings.join(reached, "id", "left_semi").groupBy("def").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 2).alias("total"))


@query(f"{_V} SELECT id, round(list_sum(list_transform(v, lambda x: (x / sqrt(list_inner_product(v, v))) * (x / sqrt(list_inner_product(v, v))))), 6) AS length, round(v[1] / sqrt(list_inner_product(v, v)), 6) + 0.0 AS first FROM V")
def l2_normalize(spark, d):
    u = fixtures.vectors(spark, d).select("id", vectors.l2_normalize("vector").alias("u"))
    return u.select("id", F.round(vectors.dot("u", "u"), 6).alias("length"), (F.round(F.col("u")[0], 6) + 0.0).alias("first"))


_QUANT = "list_transform(v, lambda x: floor(least(greatest((x + 1) / 2, 0), 1) * 255)::INTEGER)"


@query(f"{_V} SELECT id, array_to_string({_QUANT}, ',') AS q FROM V")
def scalar_quantize(spark, d):
    return fixtures.vectors(spark, d).select("id", F.concat_ws(",", vectors.scalar_quantize("vector", -1.0, 1.0).cast("array<string>")).alias("q"))


@query(f"{_V} SELECT id, round(list_max(list_transform(list_zip(v, {_QUANT}), lambda z: abs(z[1] - (-1 + z[2] / 255.0 * 2)))), 6) AS worst FROM V")
def scalar_roundtrip(spark, d):
    v = fixtures.vectors(spark, d)
    back = v.select("id", "vector", vectors.scalar_dequantize(vectors.scalar_quantize("vector", -1.0, 1.0), -1.0, 1.0).alias("b"))
    return back.select("id", F.round(F.array_max(F.zip_with(F.col("vector"), F.col("b"), lambda a, b: F.abs(a.cast("double") - b))), 6).alias("worst"))


_BITS = "list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda i: CASE WHEN v[8 * j + i + 1] > 0 THEN (1 << i) ELSE 0 END)))"


@query(f"{_V} SELECT id, array_to_string({_BITS}, ',') AS bits FROM V")
def binary_quantize(spark, d):
    return fixtures.vectors(spark, d).select("id", F.concat_ws(",", vectors.binary_quantize("vector").cast("array<string>")).alias("bits"))


@query(
    f"{_V}, X AS (SELECT id, vec_id, {_BITS} AS b FROM V), Y AS (SELECT b AS qb FROM X ORDER BY vec_id LIMIT 1), "
    "S AS (SELECT id, list_sum(list_transform(list_zip(b, qb), lambda z: bit_count(xor(z[1]::BIGINT, z[2]::BIGINT))))::INTEGER AS distance FROM X, Y) SELECT id, distance FROM S ORDER BY distance, id LIMIT 10"
)
def hamming_topk(spark, d):
    v = fixtures.vectors(spark, d)
    bits = v.select("id", vectors.binary_quantize("vector").alias("b"))
    own = vectors.binary_quantize(F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)]))
    return bits.select("id", vectors.hamming("b", own).alias("distance")).orderBy("distance", "id").limit(10)


# versions

_ORDER = ["tx_begin", "updated_at", "tx_end"]
_VERSIONS = f"WITH V AS (SELECT DISTINCT {ID.format(c='id')} AS id, tx_begin, tx_end, updated_at FROM beings)"
_NEWEST = "row_number() OVER (PARTITION BY id ORDER BY tx_begin DESC NULLS LAST, updated_at DESC NULLS LAST, tx_end DESC NULLS LAST)"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "beings").select(norm_id("id").alias("id"), "tx_begin", "tx_end", "updated_at").distinct()


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("tx_end", F.coalesce("tx_end", F.lit(-1).cast("long")))


def _history(name: str, mode: str, value: int, sql: str) -> None:
    def run(spark, d):
        return _shown(temporal.apply_history(_versions(spark, d), History(mode, value), _ORDER))

    QUERIES[name] = run
    SQL[name] = f"{_VERSIONS} {sql}"


_history("history_current", "current", 0, f"SELECT id, tx_begin, coalesce(tx_end, -1) AS tx_end, updated_at FROM (SELECT *, {_NEWEST} AS rn FROM V) WHERE rn = 1")
_history("history_all", "all", 0, "SELECT id, tx_begin, coalesce(tx_end, -1) AS tx_end, updated_at FROM V")
_history("history_last_n", "last", 2, f"SELECT id, tx_begin, coalesce(tx_end, -1) AS tx_end, updated_at FROM (SELECT *, {_NEWEST} AS rn FROM V) WHERE rn <= 2")
_history("history_at_tx", "at", 5000, f"SELECT id, tx_begin, coalesce(tx_end, -1) AS tx_end, updated_at FROM (SELECT *, {_NEWEST} AS rn FROM V WHERE tx_begin <= 5000 AND (tx_end IS NULL OR tx_end > 5000)) WHERE rn = 1")
_AS_OF = 1738000000000000000
_history("history_as_of", "as_of", _AS_OF, f"SELECT id, tx_begin, coalesce(tx_end, -1) AS tx_end, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, tx_begin DESC NULLS LAST, tx_end DESC NULLS LAST) AS rn FROM V WHERE updated_at <= {_AS_OF}) WHERE rn = 1")


@query(f"{_VERSIONS} SELECT id, count(*)::BIGINT AS versions, arg_max(tx_begin, (tx_begin, updated_at)) AS head, arg_min(tx_begin, (tx_begin, updated_at)) AS tail FROM V GROUP BY 1")
def version_count(spark, d):
    return temporal.version_chains(_versions(spark, d), _ORDER)


@query(
    f"{_VERSIONS} SELECT id, tx_begin, coalesce(tx_end, -1) AS tx_end, updated_at, CASE WHEN tx_begin = 5000 THEN TRUE WHEN tx_begin IN (1100, 1200) THEN FALSE WHEN tx_end IS NULL OR tx_end = 9223372036854775807 THEN TRUE ELSE tx_end NOT IN (1100, 1200) END AS visible FROM V"
)
def mvcc_visible(spark, d):
    return _shown(_versions(spark, d).withColumn("visible", temporal.is_visible(F.col("tx_begin"), F.col("tx_end"), 5000, [1100, 1200])))


# validation, log, writes


def _events_as_beings(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).catalog.beings.where("def = 'Event'")


@query("SELECT 'e:' || event_id AS id, 'Event' AS \"def\", 'k' AS field, CASE WHEN (props->'$.k') IS NULL THEN 'missing' ELSE 'range' END AS problem FROM events WHERE (props->'$.k') IS NULL OR (props->>'$.k')::DOUBLE NOT BETWEEN 10 AND 60")
def validate_range(spark, d):
    definition = Def("Event", (Field("k", FieldType("Int"), True, min=10, max=60),))
    return validate.violations(_events_as_beings(spark, d), [definition], ["id"])


@query("SELECT 'e:' || event_id AS id, 'Event' AS \"def\", 'k' AS field, 'type' AS problem FROM events WHERE (props->'$.k') IS NOT NULL")
def validate_types(spark, d):
    definition = Def("Event", (Field("k", FieldType("String")),))
    return validate.violations(_events_as_beings(spark, d), [definition], ["id"])


@query("SELECT 'e:' || event_id AS id, 'Event' AS \"def\", 'note' AS field, 'missing' AS problem FROM events")
def validate_required(spark, d):
    definition = Def("Event", (Field("note", FieldType("String"), True), Field("k", FieldType("Float"), True)))
    return validate.violations(_events_as_beings(spark, d), [definition], ["id"])


_INTS, _NUMBERS = "('BIGINT', 'UBIGINT', 'HUGEINT')", "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')"


@query(
    "WITH F AS (SELECT name AS \"def\", unnest(fields) AS f FROM defs), "
    "V AS (SELECT id, updated_at, \"def\", f.name AS field, f.type AS t, f.required AS needed, f.min AS lo, f.max AS hi, json_extract(ext, '$.\"' || f.name || '\"') AS v FROM beings JOIN F USING (\"def\")), "
    "P AS (SELECT id, updated_at, \"def\", field, CASE WHEN v IS NULL THEN CASE WHEN needed THEN 'missing' END "
    f"WHEN NOT CASE t WHEN 'Int' THEN json_type(v) IN {_INTS} WHEN 'Float' THEN json_type(v) IN {_NUMBERS} WHEN 'Bool' THEN json_type(v) = 'BOOLEAN' WHEN 'String' THEN json_type(v) = 'VARCHAR' "
    f"WHEN 'Array<Int>' THEN json_type(v) = 'ARRAY' AND len(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) NOT IN {_INTS})) = 0 "
    f"ELSE json_type(v) = 'OBJECT' AND len(list_filter(json_extract(v, '$.*'), lambda x: json_type(x) NOT IN {_NUMBERS})) = 0 END THEN 'type' "
    "WHEN lo IS NOT NULL AND hi IS NOT NULL AND NOT v::DOUBLE BETWEEN lo AND hi THEN 'range' END AS problem FROM V) SELECT * FROM P WHERE problem IS NOT NULL"
)
def validate_defs(spark, d):
    """The attributes of all beings against the definitions of the table defs."""
    return validate.violations(table(spark, d, "beings"), validate.definitions_of(table(spark, d, "defs")), ["id", "updated_at"])


@query("SELECT 'd:' || doc_id AS id, 'name' AS problem FROM documents WHERE lang IS NULL OR trim(lang) = '' UNION ALL SELECT 'd:' || doc_id, 'def' FROM documents WHERE source IS NULL OR trim(source) = ''")
def invalid_beings(spark, d):
    """Documents as beings that have their language for a name and their source for a def."""
    rows = table(spark, d, "documents").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("name"), F.col("source").alias("def"))
    return validate.invalid_beings(rows)


_CUT = f"WITH {INTACT}, G AS (SELECT * FROM INTACT WHERE rec_no < coalesce((SELECT min(rec_no) FROM wal_records WHERE rec_no NOT IN (SELECT rec_no FROM INTACT)), 9223372036854775807))"


def _recovered(spark: SparkSession, d: str) -> DataFrame:
    """The records before the first one that is broken (its form, length or checksum)."""
    return replayable(table(spark, d, "wal_records"), intact() & F.col("seq").isNotNull(), "rec_no")


@query(f"{_CUT} SELECT rec_no, seq FROM G")
def txlog_corruption_cut(spark, d):
    return _recovered(spark, d).select("rec_no", "seq")


@query(f"{_CUT} SELECT max(seq) AS last_seq FROM G")
def txlog_last_seq(spark, d):
    return _recovered(spark, d).agg(F.max("seq").alias("last_seq"))


@query(f"{_CUT} SELECT row_number() OVER (ORDER BY seq, rec_no)::INTEGER AS pos, seq, (payload->>'$.tx_id')::BIGINT AS tx_id, json_array_length(payload, '$.ops')::INTEGER AS n_ops FROM G WHERE json_valid(payload)")
def txlog_replay(spark, d):
    """The recovered transactions in the order of seq, those that can't be decoded left out."""
    return replay(_recovered(spark, d)).select("pos", "seq", "tx_id", F.size("ops").alias("n_ops"))


def _scratch(spark: SparkSession) -> str:
    return scratch_path(spark, "store")


def _customers(spark: SparkSession, d: str) -> Engine:
    """A store with all customers."""
    e = Engine(spark, _scratch(spark))
    e.write_batch(_engine(spark, d).query().scan("Customer").execute().drop("tx_begin", "updated_at"))
    return e


@query("SELECT 'c:' || c_custkey AS id, CASE WHEN c_custkey = 3 THEN 'Renamed' ELSE c_name END AS name, c_nationkey AS priority FROM customer WHERE c_custkey <> 5")
def soft_delete_current(spark, d):
    """Customers written, one renamed, one deleted; the current versions."""
    e = _customers(spark, d)
    tx = e.begin_tx()
    tx.update_being("c:3", name="Renamed")
    tx.delete_being("c:5")
    tx.commit()
    return e.query().scan("Customer").select("name", "priority").execute()


@query("SELECT 'c:' || c_custkey AS id, CASE WHEN c_custkey = 4 THEN 3 ELSE 1 END AS n FROM customer")
def update_versions(spark, d):
    """Updates are versions: how many each customer has."""
    e = _customers(spark, d)
    for name in ("A", "B"):
        tx = e.begin_tx()
        tx.update_being("c:4", name=name)
        tx.commit()
    return e.query().scan("Customer").history("all").execute().groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"))


def _redefined(spark: SparkSession, d: str) -> Engine:
    """Customers, those with a negative balance then written again as debtors, and one updated to another def."""
    e = _customers(spark, d)
    debtors = _engine(spark, d).query().scan("Customer").filter("weight", "<", 0).execute().drop("tx_begin", "updated_at")
    e.write_batch(debtors.withColumns({"def": F.lit("Debtor"), "weight": -F.col("weight")}))
    tx = e.begin_tx()
    tx.update_being("c:1", **{"def": "First"})
    tx.commit()
    return e


_DEF_NOW = "CASE WHEN c_custkey = 1 THEN 'First' WHEN c_acctbal < 0 THEN 'Debtor' ELSE 'Customer' END"


@query(f"SELECT 'c:' || c_custkey AS id, {_DEF_NOW} AS \"def\", abs(c_acctbal) AS weight FROM customer")
def store_scan_def_changed(spark, d):
    """A scan of a def gives the beings that have it now."""
    q = _redefined(spark, d).query()
    return reduce(DataFrame.unionByName, [q.scan(kind).select("def", "weight").execute() for kind in ("Customer", "Debtor", "First")])


@query(f"WITH c AS (SELECT *, {_DEF_NOW} AS now FROM customer) SELECT now AS \"def\", round(sum(abs(c_acctbal)), 2) AS aggregate, count(*)::BIGINT AS count FROM c WHERE abs(c_acctbal) > 100 GROUP BY 1")
def store_scan_all(spark, d):
    """The newest version of every being, filtered and aggregated per def."""
    q = _redefined(spark, d).query().scan().filter("weight", ">", 100).aggregate("weight", "sum").group_by("def")
    return q.execute().withColumn("aggregate", F.round("aggregate", 2))


@query("SELECT 'c:' || c_custkey AS id, c_acctbal AS weight FROM customer")
def store_history_at(spark, d):
    """Customers as they were at the first transaction."""
    return _redefined(spark, d).query().scan("Customer").history("at", 1).select("weight").execute()


@query("SELECT 'c:' || c_custkey AS id, c_acctbal AS weight FROM customer WHERE c_custkey = 42")
def store_lookup(spark, d):
    """A being by its id in a store that is sorted by id."""
    e = _customers(spark, d)
    e.store.compact("beings", 4, "id")
    return e.query().being("c:42").select("weight").execute()


@query("SELECT a.r_name AS from_name, b.r_name AS to_name, 4 AS relation_type FROM region a JOIN region b ON b.r_regionkey = a.r_regionkey + 1")
def store_relate(spark, d):
    """Regions written one by one, each related to the next; an edge to a being that doesn't exist is refused."""
    e = Engine(spark, _scratch(spark))
    ids = {r.r_regionkey: e.write(**{"def": "Region"}, name=r.r_name) for r in table(spark, d, "region").collect()}
    for k in ids:
        if k + 1 in ids:
            e.relate(ids[k], ids[k + 1], 4)
    with suppress(NotFound):
        e.relate(ids[0], "nobody", 4)
    c = e.catalog
    names = e.query().scan("Region").select("name").execute()
    out = c.relations.join(names.select(F.col("id").alias("from_id"), F.col("name").alias("from_name")), "from_id")
    return out.join(names.select(F.col("id").alias("to_id"), F.col("name").alias("to_name")), "to_id").select("from_name", "to_name", "relation_type")


def _mutated(spark: SparkSession, d: str) -> tuple[Engine, DataFrame]:
    """Regions defined, created, updated and deleted in the query language, and the messages."""
    e = Engine(spark, _scratch(spark))
    got = [e.execute_dsl('define type Place { field size: Int { required, min: 0, max: 99 } field note: String { default: "-" } }')]
    regions = table(spark, d, "region").orderBy("r_regionkey").collect()
    got += [e.execute_dsl(f'mutation {{ create Place(input: {{name: "{r.r_name}", size: {r.r_regionkey}, weight: {r.r_regionkey}.5}}) {{ id }} }}') for r in regions]
    got.append(e.execute_dsl(f'mutation {{ update "{regions[1].r_name}"(input: {{description: "changed", size: 50}}) }}'))
    got.append(e.execute_dsl(f'mutation {{ delete "{regions[2].r_name}" }}'))
    return e, reduce(DataFrame.unionByName, got)


@query("SELECT r_name AS name, CASE WHEN r_regionkey = 1 THEN 50.0 ELSE r_regionkey END::DOUBLE AS size, CASE WHEN r_regionkey = 1 THEN 'changed' ELSE '' END AS description, r_regionkey + 0.5::DOUBLE AS weight FROM region WHERE r_regionkey <> 2")
def dsl_mutations(spark, d):
    """What create, update and delete leave; size is an attribute of ext."""
    e, _ = _mutated(spark, d)
    rows = e.query().scan("Place").execute()
    return rows.select("name", predicates.attribute("size", 0.0).alias("size"), "description", "weight")


@query(
    "SELECT 'Define Place' AS message UNION ALL SELECT 'Create Place' FROM region UNION ALL SELECT 'Update ' || r_name FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'Delete ' || r_name FROM region WHERE r_regionkey = 2"
)
def dsl_messages(spark, d):
    return _mutated(spark, d)[1]


@query("SELECT 'Place' AS name, 1 AS type_code, 'size' AS field, 'Int' AS type, TRUE AS required UNION ALL SELECT 'Place', 1, 'note', 'String', FALSE")
def defs_reopened(spark, d):
    """The definitions that an engine finds when it opens the store again."""
    again = Engine(spark, _mutated(spark, d)[0].store.files.base)
    rows = [(x.name, x.type_code, f.name, str(f.type), f.required) for x in again.defs.all() for f in x.fields]
    return spark.createDataFrame(rows, "name string, type_code int, field string, type string, required boolean")


@query("SELECT 'CreateBeing' AS op, count(*)::BIGINT AS n, TRUE AS intact FROM region UNION ALL VALUES ('Define', 1, TRUE), ('UpdateBeing', 1, TRUE), ('DeleteBeing', 1, TRUE)")
def store_log(spark, d):
    """The log of a store, each record with the checksum of its payload."""
    log = _mutated(spark, d)[0].store.read("txlog")
    good = F.crc32(F.encode("payload", "UTF-8")) == F.col("crc32")
    return replayable(log, good).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.every(good).alias("intact"))


@query("SELECT event_type AS name, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_ingest(spark, d):
    """Events streamed into a store, each micro-batch once."""
    store, at = Store(spark, _scratch(spark)), _scratch(spark)
    schema = table(spark, d, "events").schema
    to_beings = lambda b: b.select(
        F.concat(F.lit("e:"), F.col("event_id").cast("string")).alias("id"), F.lit("Event").alias("def"), F.lit(0).alias("status"), F.col("event_type").alias("name"), F.lit("").alias("code"), F.lit("").alias("description"),
        F.col("value").alias("weight"), F.lit(0).alias("priority"), F.col("event_type").alias("category"), ns(F.col("ts")).alias("created_at"), ns(F.col("ts")).alias("updated_at"), F.lit(0).alias("tx_begin"), F.lit(None).alias("tx_end"), F.col("props").alias("ext"),
    )
    ingest(spark, f"{d}/events*.parquet", schema, store, at, "events", to_beings).awaitTermination()
    return store.read("beings").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 2).alias("total"))


@query(_b("""SELECT id, name FROM B WHERE "def" = 'Customer' AND (category IN ('BUILDING', 'MACHINERY') AND weight > 0 OR weight < -900)"""))
def nested_conditions(spark, d):
    cond = Any((All((Any((Compare("category", "==", "BUILDING"), Compare("category", "==", "MACHINERY"))), Compare("weight", ">", 0))), Compare("weight", "<", -900)))
    return _engine(spark, d).catalog.beings.where("def = 'Customer'").where(predicates.column(cond)).select("id", "name")


def engine_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def engine_sql() -> dict[str, str]:
    return dict(SQL)
