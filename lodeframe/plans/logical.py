"""One logical query for both front ends, and its translation into a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.model import CORE, EngineError
from lodeframe.operators import aggregates, graph, predicates, temporal, vectors
from lodeframe.operators.predicates import Compare, Condition
from lodeframe.operators.temporal import History

#: Columns that a query without a list of fields gives.
DEFAULT_FIELDS = ("id", "name", "def", "status", "weight", "priority", "category")
#: How versions follow each other.
VERSION_ORDER = ["tx_begin", "ord"]


@dataclass(frozen=True)
class Similar:
    field: str
    vector: tuple[float, ...]
    k: int
    metric: str = "cosine"
    relations: bool = False


@dataclass(frozen=True)
class LogicalQuery:
    """source, then history, similarity, conditions, limit, relations, aggregate or fields, in this order."""

    target: str = ""
    being_id: str | None = None
    similar: Similar | None = None
    where: tuple[Condition, ...] = ()
    history: History = History()
    include_deleted: bool = False
    scan_limit: int | None = None
    limit: int | None = None
    order_by: tuple[tuple[str, bool], ...] = ()
    aggregate: tuple[str, str] | None = None
    group_by: tuple[str, ...] = ()
    fields: tuple[str, ...] | None = DEFAULT_FIELDS
    with_relations: int = 0


@dataclass(frozen=True)
class Part:
    """One kind of beings: all rows with the def ``kind`` (and no others), whose ids begin with ``prefix``.

    ``rows`` gives them, narrowed to one id and to a range of created_at [since, until) where it can: a superset of what is
    asked for, read by conditions on the columns of the files.
    """

    kind: str
    prefix: str
    rows: Callable[[str | None, int | None, int | None], DataFrame]


@dataclass
class Catalog:
    """The tables a query reads."""

    beings: DataFrame
    relations: DataFrame
    vectors: DataFrame | None = None
    metrics: dict[str, str] = field(default_factory=dict)
    #: False where every id has one row, so that nothing has to look for the newest.
    versioned: bool = True
    #: The beings by kind, if they are stored so; together they are ``beings``.
    parts: tuple[Part, ...] = ()


def _bounds(q: LogicalQuery) -> tuple[int | None, int | None]:
    """Bounds of created_at, below inclusive and above exclusive, that all rows of the result keep."""
    since, until = None, None
    for c in q.where:
        for x in c.parts if isinstance(c, predicates.All) else (c,):
            if isinstance(x, Compare) and x.field == "created_at" and type(x.value) is int:
                op, v = predicates.OPERATORS.get(x.op), x.value
                if op in ("ge", "gt", "eq"):
                    since = v if since is None else max(since, v)
                if op in ("lt", "le", "eq"):
                    v += op != "lt"
                    until = v if until is None else min(until, v)
    return since, until


def _needed(q: LogicalQuery) -> list[str] | None:
    """The columns of beings that a query looks at; None for all."""
    if q.with_relations or (q.fields is None and q.aggregate is None):
        return None
    names = {"id", "def", "tx_begin", "tx_end", "updated_at", "ord", *(n for n, _ in q.order_by)}
    names |= {q.aggregate[0], *q.group_by} if q.aggregate is not None else set(q.fields)
    if q.similar is not None and q.similar.relations:
        names.add("name")
    for c in q.where:
        own = predicates.fields_of(c)
        if own is None:
            return None
        names |= own
    return sorted({n if n in CORE or n == "ord" else "ext" for n in names})


def source(q: LogicalQuery, catalog: Catalog) -> DataFrame:
    """The rows before conditions.

    A condition on the id reaches the scan. Of a being with versions the def is that of the version that the history mode
    selects, so the version is chosen first.
    """
    plain = not catalog.versioned and q.history.mode == "current"
    if plain and catalog.parts and (q.target or q.being_id is not None):
        since, until = _bounds(q)
        own = [p for p in catalog.parts if (not q.target or p.kind == q.target) and (q.being_id is None or q.being_id.startswith(p.prefix))]
        rows = reduce(DataFrame.unionByName, [p.rows(q.being_id, since, until) for p in own]) if own else catalog.beings.limit(0)
    else:
        rows = catalog.beings
    if q.being_id is not None:
        rows = rows.where(F.col("id") == q.being_id)
    columns = _needed(q)
    if columns is not None:
        rows = rows.select(*columns)
    kind = F.col("def") == q.target if q.target else None
    if plain:
        rows = rows if kind is None else rows.where(kind)
    else:
        rows = temporal.apply_history(rows, q.history, VERSION_ORDER, kind)
    if q.history.mode == "current" and not q.include_deleted:
        rows = rows.where("tx_end is null or tx_end = 9223372036854775807")
    return rows


def current(catalog: Catalog, ids: DataFrame) -> DataFrame:
    """The present beings among ``ids`` (column id), one row each."""
    if not catalog.versioned:
        return catalog.beings.join(ids.select("id"), "id", "left_semi")
    return source(LogicalQuery(fields=None), replace(catalog, beings=catalog.beings.join(ids.select("id"), "id", "left_semi"), parts=()))


def compile_query(q: LogicalQuery, catalog: Catalog) -> DataFrame:
    """The lazy DataFrame of a query (a similarity search checks its dimension first)."""
    rows = source(q, catalog)
    if q.scan_limit is not None:
        rows = rows.orderBy("ord").limit(q.scan_limit)
    if q.similar is not None:
        rows = _similar(q, rows, catalog)
    for c in q.where:
        rows = rows.where(predicates.column(c))
    if q.aggregate is not None:
        name, op = q.aggregate
        value = predicates.attribute(name, 0.0)
        if q.group_by:
            keyed = rows.withColumns({k: predicates.attribute(k, "") for k in q.group_by if k not in CORE})
            out = aggregates.grouped_aggregate(keyed, list(q.group_by), value, op)
            return _ordered(out, q, list(q.group_by))
        return aggregates.global_aggregate(rows, value, op)
    extra = ["distance"] if q.similar is not None else []
    if q.with_relations:
        reach = graph.bfs(catalog.relations, rows.select("id"), q.with_relations)
        rows = current(catalog, reach).join(reach.select("id", "depth"), "id")
        extra = ["depth"]
    elif q.similar is not None and q.similar.relations:
        rows = graph.neighbour_names(rows, catalog.relations, lambda ids: current(catalog, ids))
        extra = ["distance", "relation_count", "relations"]
    rows = _ordered(rows, q, ["distance", "id"] if q.similar is not None else ["ord"])
    if q.fields is None:
        return rows.drop("ord")
    chosen = ["id", *[f for f in q.fields if f != "id"]]
    return rows.select(*[predicates.attribute(f, "").alias(f) if f not in rows.columns else F.col(f) for f in chosen], *[e for e in extra if e not in chosen])


def _ordered(rows: DataFrame, q: LogicalQuery, default: list[str]) -> DataFrame:
    """Sorted only where an order or a limit is asked for: a top-k, never a sort of everything for its own sake."""
    if q.order_by:
        # an attribute of ext sorts as a number, then as a text
        of = lambda c: [F.col(c)] if c in rows.columns else [predicates.attribute(c, 0.0), predicates.attribute(c, "")]
        keys = [x.desc_nulls_last() if down else x.asc_nulls_last() for c, down in q.order_by for x in of(c)] + [F.col(c) for c in default]
        rows = rows.orderBy(*keys)
    elif q.limit is not None:
        rows = rows.orderBy(*default)
    return rows if q.limit is None else rows.limit(max(0, q.limit))


def _similar(q: LogicalQuery, rows: DataFrame, catalog: Catalog) -> DataFrame:
    """The k beings nearest to a vector, of the target's only; k rows, so that the join with them is a broadcast."""
    s = q.similar
    if catalog.vectors is None:
        raise EngineError("there are no vectors")
    own = catalog.vectors.where(F.col("field") == s.field).select("id", "vector")
    if q.target or q.being_id:
        own = own.join(rows.select("id"), "id", "left_semi")
    hits = vectors.knn(own, list(s.vector), s.k, catalog.metrics.get(s.field, s.metric))
    return rows.join(F.broadcast(hits.select("id", "distance")), "id")


@dataclass(frozen=True)
class PlanStep:
    """Scan(target), Filter(conditions), Project(fields), Aggregate(column, op, keys to group by), Limit(n), Sort(column, descending)."""

    kind: str
    args: tuple = ()


def run_plan(steps: list[PlanStep], catalog: Catalog) -> DataFrame:
    """Steps as a logical query; the first must be a scan."""
    if not steps or steps[0].kind != "Scan":
        raise EngineError("a plan begins with a scan")
    q = LogicalQuery(target=steps[0].args[0] if steps[0].args else "", fields=None)
    for s in steps[1:]:
        if s.kind == "Filter":
            q = replace(q, where=(*q.where, *s.args))
        elif s.kind == "Project":
            q = replace(q, fields=tuple(s.args))
        elif s.kind == "Aggregate":
            q = replace(q, aggregate=(s.args[0], s.args[1]), group_by=tuple(s.args[2:]))
        elif s.kind == "Limit":
            q = replace(q, limit=s.args[0] if q.limit is None else min(q.limit, s.args[0]))
        elif s.kind == "Sort":
            q = replace(q, order_by=(*q.order_by, (s.args[0], bool(s.args[1:] and s.args[1]))))
        else:
            raise EngineError(f"unknown step {s.kind!r}")
    return compile_query(q, catalog)


def route(kind: str) -> str:
    """Which of the stores a kind of request concerns."""
    return {"point": "graph", "traversal": "graph", "scan": "column", "aggregate": "column", "similar": "vector"}.get(kind, "multi")
