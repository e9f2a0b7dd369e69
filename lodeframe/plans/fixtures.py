"""The star-schema tables seen as beings, relations and vectors; and the same as SQL.

Each branch of the union has a literal def, so a scan of one def reads one table, and of that the columns it needs.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.ids import micros
from lodeframe.model import BEINGS, RELATIONS
from lodeframe.plans.logical import Catalog, Part
from lodeframe.sources.tables import table

#: ord of a row: its kind times this, plus its key.
KIND = 10**13


def ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without zone."""
    return micros(ts) * 1000


def _kind(df: DataFrame, number: int, kind: str, key: str, prefix: str, /, **columns: Column | str) -> DataFrame:
    given = {k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()}
    fixed = {"id": F.concat(F.lit(prefix), F.col(key).cast("string")), "def": F.lit(kind), "ord": F.lit(number * KIND).cast("long") + F.col(key)}
    zero = {"status": F.lit(0), "code": F.lit(""), "description": F.lit(""), "weight": F.lit(0.0), "priority": F.lit(0), "category": F.lit(""), "created_at": F.lit(0), "updated_at": F.lit(0), "tx_begin": F.lit(1), "tx_end": F.lit(None), "ext": F.lit(None)}
    every = {**zero, **given, **fixed}
    if "created_at" in given:
        every["updated_at"] = given["created_at"]
    return df.select(*[every[f.name].cast(f.dataType).alias(f.name) for f in BEINGS])


def _micros(t: int) -> Column:
    """A time in nanoseconds, rounded up to whole microseconds, as a timestamp without zone."""
    return F.lit(datetime(1970, 1, 1) + timedelta(microseconds=-(-t // 1000)))


def _part(df: DataFrame, number: int, kind: str, key: str, prefix: str, /, time: str | None = None, **columns: Column | str) -> Part:
    """The table as one kind of beings; an id becomes a condition on its key, times one on the column ``time``."""

    def rows(being_id: str | None, since: int | None, until: int | None) -> DataFrame:
        own = df
        if being_id is not None:
            digits = being_id.removeprefix(prefix)
            own = own.where(F.col(key) == int(digits)) if digits.isdecimal() and len(digits) < 19 else own.limit(0)
        if time is not None and since is not None:
            own = own.where(F.col(time) >= _micros(since))
        if time is not None and until is not None:
            own = own.where(F.col(time) < _micros(until))
        return _kind(own, number, kind, key, prefix, **columns)

    return Part(kind, prefix, rows)


def parts(spark: SparkSession, d: str) -> tuple[Part, ...]:
    t = lambda n: table(spark, d, n)
    return (
        _part(t("region"), 1, "Region", "r_regionkey", "r:", name="r_name"),
        _part(t("nation"), 2, "Nation", "n_nationkey", "n:", name="n_name", priority="n_nationkey"),
        _part(t("customer"), 3, "Customer", "c_custkey", "c:", name="c_name", weight="c_acctbal", priority="c_nationkey", category="c_mktsegment"),
        _part(t("supplier"), 4, "Supplier", "s_suppkey", "s:", name="s_name", weight="s_acctbal", priority="s_nationkey"),
        _part(t("part"), 5, "Part", "p_partkey", "p:", name="p_name", weight="p_retailprice", priority="p_size", category="p_type", code="p_brand"),
        _part(
            t("orders"), 6, "Order", "o_orderkey", "o:", name="concat('Order-', o_orderkey)", weight="o_totalprice", priority="cast(left(o_orderpriority, 1) as int)", category="o_orderpriority",
            status="case o_orderstatus when 'O' then 1 when 'F' then 2 when 'P' then 3 else 0 end", created_at=ns(F.col("o_orderdate")), time="o_orderdate",
        ),
        _part(t("events"), 7, "Event", "event_id", "e:", name="event_type", weight="value", category="event_type", created_at=ns(F.col("ts")), ext="props", time="ts"),
        _part(t("documents"), 8, "Document", "doc_id", "d:", name="concat('doc-', doc_id)", weight="n_chars", category="lang", code="source", description="text"),
        _part(t("embeddings"), 9, "Vec", "vec_id", "v:", name="concat('vec-', vec_id)", priority="label"),
    )


def beings(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.rows(None, None, None) for p in parts(spark, d)])


def _edges(df: DataFrame, kind: int, a: str, b: str, key: str, weight: str = "1.0") -> DataFrame:
    every = {"from_id": a, "to_id": b, "relation_type": str(kind), "directed": "true", "created_at": "0", "name": "''", "weight": weight, "ord": f"{kind * KIND}L + {key}"}
    return df.select(*[F.expr(every[f.name]).cast(f.dataType).alias(f.name) for f in RELATIONS])


def relations(spark: SparkSession, d: str) -> DataFrame:
    """1 region-nation, 2 nation-customer, 3 customer-order, 4 nation-supplier, 5 order-part, 6 part-supplier, 7 vector-customer, -nation."""
    t = lambda n: table(spark, d, n)
    supplied = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    vec = t("embeddings").select("vec_id")
    kinds = [
        _edges(t("nation"), 1, "concat('r:', n_regionkey)", "concat('n:', n_nationkey)", "n_nationkey"),
        _edges(t("customer"), 2, "concat('n:', c_nationkey)", "concat('c:', c_custkey)", "c_custkey"),
        _edges(t("orders"), 3, "concat('c:', o_custkey)", "concat('o:', o_orderkey)", "o_orderkey"),
        _edges(t("supplier"), 4, "concat('n:', s_nationkey)", "concat('s:', s_suppkey)", "s_suppkey"),
        _edges(t("lineitem"), 5, "concat('o:', l_orderkey)", "concat('p:', l_partkey)", "l_orderkey * 100 + l_linenumber", "l_quantity"),
        _edges(supplied, 6, "concat('p:', l_partkey)", "concat('s:', l_suppkey)", "l_partkey * 1000000 + l_suppkey"),
        _edges(vec, 7, "concat('v:', vec_id)", "concat('c:', vec_id % 100 + 1)", "vec_id * 2"),
        _edges(vec, 7, "concat('v:', vec_id)", "concat('n:', vec_id % 25)", "vec_id * 2 + 1"),
    ]
    return reduce(DataFrame.unionByName, kinds)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("v:"), F.col("vec_id").cast("string")).alias("id"), F.lit("embedding").alias("field"), F.col("embedding").cast("array<float>").alias("vector"), F.col("vec_id").alias("ord"))


_CATALOGS: dict[tuple[str, str], Catalog] = {}


def catalog(spark: SparkSession, d: str) -> Catalog:
    """Every being has one version here, so nothing has to look for the newest.

    The tables don't change, so their footers are read once per session and directory.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _CATALOGS:
        _CATALOGS.clear()
        own = parts(spark, d)
        every = reduce(DataFrame.unionByName, [p.rows(None, None, None) for p in own])
        _CATALOGS[key] = Catalog(every, relations(spark, d), vectors(spark, d), versioned=False, parts=own)
    return _CATALOGS[key]


def _sql_kind(n: int, kind: str, key: str, prefix: str, source: str, /, **c: str) -> str:
    zero = {"status": "0", "name": "''", "code": "''", "description": "''", "weight": "0", "priority": "0", "category": "''", "created_at": "0", "ext": "NULL"} | c
    kinds = {"status": "INTEGER", "name": "VARCHAR", "code": "VARCHAR", "description": "VARCHAR", "weight": "DOUBLE", "priority": "INTEGER", "category": "VARCHAR", "created_at": "BIGINT", "ext": "VARCHAR"}
    rest = ", ".join(f"({zero[k]})::{t} AS {k}" for k, t in kinds.items())
    return f"SELECT '{prefix}' || {key} AS id, '{kind}' AS \"def\", {n * KIND}::BIGINT + {key} AS ord, {rest} FROM {source}"


B = "B AS (" + " UNION ALL ".join(
    [
        _sql_kind(1, "Region", "r_regionkey", "r:", "region", name="r_name"),
        _sql_kind(2, "Nation", "n_nationkey", "n:", "nation", name="n_name", priority="n_nationkey"),
        _sql_kind(3, "Customer", "c_custkey", "c:", "customer", name="c_name", weight="c_acctbal", priority="c_nationkey", category="c_mktsegment"),
        _sql_kind(4, "Supplier", "s_suppkey", "s:", "supplier", name="s_name", weight="s_acctbal", priority="s_nationkey"),
        _sql_kind(5, "Part", "p_partkey", "p:", "part", name="p_name", weight="p_retailprice", priority="p_size", category="p_type", code="p_brand"),
        _sql_kind(6, "Order", "o_orderkey", "o:", "orders", name="'Order-' || o_orderkey", weight="o_totalprice", priority="left(o_orderpriority, 1)::INTEGER", category="o_orderpriority",
                  status="CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 WHEN 'P' THEN 3 ELSE 0 END", created_at="epoch_us(o_orderdate) * 1000"),
        _sql_kind(7, "Event", "event_id", "e:", "events", name="event_type", weight="value", category="event_type", created_at="epoch_us(ts) * 1000", ext="props"),
        _sql_kind(8, "Document", "doc_id", "d:", "documents", name="'doc-' || doc_id", weight="n_chars", category="lang", code="source", description="text"),
        _sql_kind(9, "Vec", "vec_id", "v:", "embeddings", name="'vec-' || vec_id", priority="label"),
    ]
) + ")"

_E = "SELECT {a} AS from_id, {b} AS to_id, {t} AS relation_type, ({w})::DOUBLE AS weight, ({t}::BIGINT * 10000000000000 + {k}) AS ord FROM {s}"
R = "R AS (" + " UNION ALL ".join(
    [
        _E.format(t=1, a="'r:' || n_regionkey", b="'n:' || n_nationkey", w=1, k="n_nationkey", s="nation"),
        _E.format(t=2, a="'n:' || c_nationkey", b="'c:' || c_custkey", w=1, k="c_custkey", s="customer"),
        _E.format(t=3, a="'c:' || o_custkey", b="'o:' || o_orderkey", w=1, k="o_orderkey", s="orders"),
        _E.format(t=4, a="'n:' || s_nationkey", b="'s:' || s_suppkey", w=1, k="s_suppkey", s="supplier"),
        _E.format(t=5, a="'o:' || l_orderkey", b="'p:' || l_partkey", w="l_quantity", k="l_orderkey * 100 + l_linenumber", s="lineitem"),
        _E.format(t=6, a="'p:' || l_partkey", b="'s:' || l_suppkey", w=1, k="l_partkey * 1000000 + l_suppkey", s="(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"),
        _E.format(t=7, a="'v:' || vec_id", b="'c:' || (vec_id % 100 + 1)", w=1, k="vec_id * 2", s="embeddings"),
        _E.format(t=7, a="'v:' || vec_id", b="'n:' || (vec_id % 25)", w=1, k="vec_id * 2 + 1", s="embeddings"),
    ]
) + ")"
