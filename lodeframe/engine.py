"""The engine: a fluent builder, the query language, writes and transactions over one store."""

from __future__ import annotations

import json
import time
import tomllib
import uuid
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.model import BEINGS, CORE, CORE_DEFAULTS, RELATIONS, WIDTHS, Def, DefRegistry, DimensionMismatch, EngineError, Field, FieldType, NotFound, RelationTypes
from lodeframe.functions.ids import cut_bytes
from lodeframe.operators import graph
from lodeframe.operators.predicates import Compare, Condition, Where, condition_of
from lodeframe.operators.temporal import History
from lodeframe.plans import dsl
from lodeframe.plans.logical import DEFAULT_FIELDS, Catalog, LogicalQuery, Similar, compile_query, current, source
from lodeframe.sources.ship import ship
from lodeframe.sources.store import Store

DEFAULTS = {"spark": {}, "engine": {"truncate": False, "metric": "cosine"}}
DAMPING = 0.85
#: Core fields that an update may set (ids and the times of versions aren't the caller's); others are attributes of ext.
UPDATABLE = frozenset(CORE) - {"id", "ext", "tx_begin", "tx_end"}


def load_config(path: str) -> dict:
    """A TOML file over the defaults."""
    with open(path, "rb") as f:
        own = tomllib.load(f)
    return {k: {**DEFAULTS.get(k, {}), **own.get(k, {})} for k in {*DEFAULTS, *own}}


def save_config(config: dict, path: str) -> None:
    with open(path, "w") as f:
        for section, values in config.items():
            f.write(f"[{section}]\n" + "".join(f"{json.dumps(k)} = {json.dumps(v)}\n" for k, v in values.items()) + "\n")


def new_id() -> str:
    """36 hexadecimal digits: four of the shard, then a uuid whose first 48 bits are the time in milliseconds."""
    ms = time.time_ns() // 1_000_000
    tail = uuid.uuid4().int & ((1 << 80) - 1)
    tail = tail & ~(0xF << 76) | (7 << 76)
    return "0000" + f"{(ms << 80) | tail:032x}"


class QueryBuilder:
    """Collects a query; nothing runs before the resulting DataFrame does."""

    def __init__(self, catalog: Catalog, q: LogicalQuery | None = None):
        self._catalog, self._q = catalog, q or LogicalQuery(fields=None)

    def _with(self, **changes) -> QueryBuilder:
        return QueryBuilder(self._catalog, replace(self._q, **changes))

    def being(self, being_id: str) -> QueryBuilder:
        return self._with(being_id=being_id, target="", similar=None)

    def scan(self, target: str = "") -> QueryBuilder:
        return self._with(target=target, being_id=None, similar=None)

    def similar_to(self, vector: list[float], k: int, field: str = "embedding") -> QueryBuilder:
        return self._with(similar=Similar(field, tuple(vector), k), being_id=None)

    def filter(self, name: str, op: str, value: object = None) -> QueryBuilder:
        """op: a comparison, in, between, like (each after not as well), is null or is not null."""
        return self._with(where=(*self._q.where, condition_of(name, op, value)))

    def where(self, test: Condition | Column | Callable) -> QueryBuilder:
        """A condition of one's own: a tree of conditions, a column, or a function that gets ``attribute`` and gives a column."""
        cond = Where(test) if isinstance(test, Column) or not isinstance(test, Condition) else test
        return self._with(where=(*self._q.where, cond))

    def limit(self, n: int) -> QueryBuilder:
        """After the filters."""
        return self._with(limit=n)

    def scan_limit(self, n: int) -> QueryBuilder:
        """Before the filters: only the first n rows are looked at."""
        return self._with(scan_limit=n)

    def with_relations(self, depth: int) -> QueryBuilder:
        return self._with(with_relations=depth)

    def history(self, mode: str, value: int = 0) -> QueryBuilder:
        return self._with(history=History(mode, value))

    def include_deleted(self) -> QueryBuilder:
        return self._with(include_deleted=True)

    def aggregate(self, column: str, op: str) -> QueryBuilder:
        return self._with(aggregate=(column, op))

    def group_by(self, *names: str) -> QueryBuilder:
        return self._with(group_by=names)

    def order_by(self, name: str, descending: bool = False) -> QueryBuilder:
        return self._with(order_by=(*self._q.order_by, (name, descending)))

    def select(self, *fields: str) -> QueryBuilder:
        return self._with(fields=fields)

    def execute(self) -> DataFrame:
        return compile_query(self._q, self._catalog)

    def fetch_one(self):
        """The first row, or None."""
        rows = compile_query(replace(self._q, limit=1 if self._q.limit is None else min(1, self._q.limit)), self._catalog).take(1)
        return rows[0] if rows else None

    def fetch_all(self) -> list:
        return self.execute().collect()


class Transaction:
    """Buffered operations that are committed together; without commit nothing happens."""

    def __init__(self, engine: Engine):
        self._engine, self._ops = engine, []

    def create_being(self, **values) -> str:
        row = {**CORE_DEFAULTS, "id": values.get("id") or new_id(), **values}
        self._ops.append(("CreateBeing", row))
        return row["id"]

    def create_relation(self, from_id: str, to_id: str, relation_type: int = 0, directed: bool = True, name: str = "", weight: float = 1.0) -> None:
        now = time.time_ns()
        self._ops.append(("CreateRelation", {"from_id": from_id, "to_id": to_id, "relation_type": relation_type, "directed": directed, "created_at": now, "name": name, "weight": weight}))

    def update_being(self, being_id: str, **values) -> None:
        """A new version with these values: core fields (def as well), others as attributes of ext."""
        self._ops.append(("UpdateBeing", {"id": being_id, "updates": values}))

    def delete_being(self, being_id: str) -> None:
        self._ops.append(("DeleteBeing", {"id": being_id}))

    def commit(self) -> int | None:
        ops, self._ops = self._ops, []
        return self._engine._apply(ops) if ops else None


class Engine:
    """Beings, relations and vectors in the folder ``path``, or over given tables (read only) if there is none."""

    def __init__(self, spark: SparkSession, path: str | None = None, catalog: Catalog | None = None, config: dict | None = None):
        self.spark, self.config = spark, config or DEFAULTS
        ship(spark)
        for k, v in self.config.get("spark", {}).items():
            spark.conf.set(k, v)
        self.store = Store(spark, path) if path else None
        self._given = catalog
        self.defs, self.relation_types = DefRegistry(), RelationTypes()
        self.vector_fields: dict[str, tuple[int, str]] = {}
        if self.store:
            for d in self.store.defs():
                self.defs.register(Def(d["name"], tuple(Field(f["name"], FieldType.parse(f["type"]), f["required"], f["default"], f["min"], f["max"]) for f in d["fields"])))

    @property
    def catalog(self) -> Catalog:
        if self._given is not None:
            return self._given
        return Catalog(self.store.read("beings"), self.store.read("relations"), self.store.read("vectors"), {f: m for f, (_, m) in self.vector_fields.items()})

    def query(self) -> QueryBuilder:
        return QueryBuilder(self.catalog)

    # writes

    def _saved_defs(self) -> list:
        return [{"name": d.name, "fields": [{**asdict(f), "type": str(f.type)} for f in d.fields]} for d in self.defs.all()]

    def _writable(self) -> Store:
        if self.store is None:
            raise EngineError("the engine has no folder to write to")
        return self.store

    def define(self, definition: Def) -> Def:
        out = self.defs.register(definition)
        self._writable().commit({}, [("Define", definition.name)], self._saved_defs())
        return out

    def write_batch(self, beings: DataFrame) -> int:
        """Appends many beings; columns that are missing get the values of a new being."""
        rows = beings
        for f in BEINGS:
            if f.name not in rows.columns and f.name != "ord":
                rows = rows.withColumn(f.name, F.lit(CORE_DEFAULTS.get(f.name)).cast(f.dataType))
        if self.config.get("engine", {}).get("truncate"):
            rows = rows.withColumns({c: cut_bytes(c, w) for c, w in WIDTHS.items()})
        return self._writable().commit({"beings": rows})

    def write(self, **values) -> str:
        tx = self.begin_tx()
        being_id = tx.create_being(**values)
        tx.commit()
        return being_id

    def begin_tx(self) -> Transaction:
        return Transaction(self)

    def relate(self, from_id: str, to_id: str, relation_type: int = 0, name: str = "") -> int:
        tx = self.begin_tx()
        tx.create_relation(from_id, to_id, relation_type, name=name)
        return tx.commit()

    def register_vector_field(self, name: str, dim: int, metric: str = "cosine") -> None:
        self.vector_fields[name] = (dim, metric)

    def insert_vectors(self, field: str, rows: DataFrame) -> int:
        """rows (id, vector); a vector of another dimension than the field's raises and nothing is written."""
        dim = self.vector_fields.get(field, (None, ""))[0]
        if dim is not None:
            wrong = rows.where(F.size("vector") != dim).select(F.size("vector").alias("n")).take(1)
            if wrong:
                raise DimensionMismatch(f"expected {dim} numbers, found {wrong[0].n}")
        return self._writable().commit({"vectors": rows.select("id", F.lit(field).alias("field"), "vector")})

    def _apply(self, ops: list[tuple[str, dict]]) -> int:
        """All ops as one commit: an update or delete is a new version of the being."""
        store, now = self._writable(), time.time_ns()
        created = {o["id"]: {**o, "created_at": o["created_at"] or now, "updated_at": o["updated_at"] or now} for k, o in ops if k == "CreateBeing"}
        touched = {o["id"] for k, o in ops if k in ("UpdateBeing", "DeleteBeing")} - set(created)
        ends = {x for k, o in ops if k == "CreateRelation" for x in (o["from_id"], o["to_id"])} - set(created)
        needed = sorted(touched | ends)
        current: dict[str, dict] = {}
        if needed:
            rows = LogicalQuery(fields=None, where=())
            there = compile_query(rows, Catalog(store.read("beings").where(F.col("id").isin(needed)), store.read("relations"))).collect()
            current = {r.id: r.asDict() for r in there}
            missing = [x for x in needed if x not in current]
            if missing:
                raise NotFound(f"no being {missing[0]!r}")
        versions: dict[str, dict] = dict(created)
        relations = []
        for kind, o in ops:
            if kind == "UpdateBeing":
                base = versions.get(o["id"]) or {**current[o["id"]], "tx_begin": 0}
                core = {k: v for k, v in o["updates"].items() if k in UPDATABLE}
                more = {k: v for k, v in o["updates"].items() if k not in CORE}
                ext = json.dumps({**json.loads(base["ext"] or "{}"), **more}) if more else base["ext"]
                versions[o["id"]] = {**base, **core, "ext": ext, "updated_at": now}
            elif kind == "DeleteBeing":
                base = versions.get(o["id"]) or {**current[o["id"]], "tx_begin": 0}
                versions[o["id"]] = {**base, "status": 0, "tx_end": store._manifest()["version"] + 1, "updated_at": now}
            elif kind == "CreateRelation":
                relations.append(o)
        parts = {}
        for v in versions.values():
            self.defs.get_or_register(v["def"])
        if versions:
            names = [f.name for f in BEINGS if f.name != "ord"]
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in BEINGS if f.name != "ord")
            floats = {"weight"}
            parts["beings"] = self.spark.createDataFrame([tuple(float(v[n]) if n in floats and v[n] is not None else v[n] for n in names) for v in versions.values()], schema).coalesce(1)
        if relations:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RELATIONS if f.name != "ord")
            parts["relations"] = self.spark.createDataFrame([tuple(o[f.name] if f.name != "weight" else float(o["weight"]) for f in RELATIONS if f.name != "ord") for o in relations], schema).coalesce(1)
        return store.commit(parts, [(k, json.dumps(o)) for k, o in ops], self._saved_defs())

    # the query language

    def _first_named(self, name: str):
        rows = compile_query(LogicalQuery(where=(Compare("name", "==", name),), limit=1, fields=("id",)), self.catalog).take(1)
        return rows[0].id if rows else None

    def _message(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "message string")

    def execute_dsl(self, text: str) -> DataFrame:
        """The rows of a statement; a mutation or definition gives one row with a message."""
        s = dsl.parse(text)
        if isinstance(s, dsl.Query):
            return self._run_query(s)
        if isinstance(s, dsl.SimilarTo):
            field = s.field or next(iter(self.vector_fields), "embedding")
            similar = Similar(field, s.vector, s.k, s.metric or self.config["engine"].get("metric", "cosine"), relations=True)
            q = LogicalQuery(target=s.target, similar=similar, fields=("id", "name", "def", "weight", "priority"), limit=s.k)
            return compile_query(q, self.catalog)
        if isinstance(s, dsl.Analyze):
            return self._analyze(s)
        if isinstance(s, dsl.Define):
            self.define(s.definition)
            return self._message(f"Define {s.definition.name}")
        return self._mutate(s)

    def _run_query(self, s: dsl.Query) -> DataFrame:
        names = tuple(a for _, a in s.fields) or DEFAULT_FIELDS
        q = LogicalQuery(
            target=s.target, being_id=s.being_id, where=(s.where,) if s.where else (), history=s.history, limit=s.limit, order_by=s.order_by, aggregate=s.aggregate, group_by=s.group_by, fields=names
        )
        out = compile_query(q, self.catalog)
        if s.aggregate or not s.fields:
            return out
        return out.select("id", *[F.col(a).alias(n) for n, a in s.fields if n != "id" or a != "id"])

    def _analyze(self, s: dsl.Analyze) -> DataFrame:
        c, n = self.catalog, 10 if s.limit is None else s.limit
        facts = lambda found: found.join(current(c, found).select("id", "name", "weight", "priority"), "id")
        if s.algorithm == "pagerank":
            return graph.pagerank(source(LogicalQuery(fields=("id",)), c), c.relations, n, DAMPING).orderBy(F.desc("rank"), "id")
        start = self._first_named(s.start)
        if start is None:
            return self.spark.createDataFrame([], "depth int, id string, name string, weight double, priority int")
        if s.algorithm == "bfs":
            found = graph.bfs(c.relations, self.spark.createDataFrame([(start,)], "id string"), n)
            return facts(found).orderBy("depth", "way").select("depth", "id", "name", "weight", "priority")
        if s.algorithm == "dfs":
            found = graph.dfs(c.relations, start, n)
            return facts(found).orderBy("pos").select("depth", "id", "name", "weight", "priority")
        goal = self._first_named(s.to) if s.to else None
        if goal is None:
            raise NotFound(f"no being named {s.to!r}")
        return facts(graph.shortest_path(c.relations, start, goal)).orderBy("step")

    def _mutate(self, s: dsl.Mutation) -> DataFrame:
        tx = self.begin_tx()
        if s.action == "create":
            core = {k: v for k, v in s.values.items() if k in CORE_DEFAULTS}
            more = {k: v for k, v in s.values.items() if k not in CORE_DEFAULTS}
            tx.create_being(**{"name": s.target, **core, "def": s.target, "ext": json.dumps(more) if more else None})
        else:
            being = self._first_named(s.target)
            if being is not None and s.action == "update":
                tx.update_being(being, **s.values)
            elif being is not None:
                tx.delete_being(being)
        tx.commit()
        return self._message(f"{s.action.capitalize()} {s.target}")
