"""Scenarios of the engine: writes, queries in both front ends, graph walks, vectors, versions."""

import pytest

from lodeframe.engine import DEFAULTS, Engine, load_config, new_id, save_config
from lodeframe.model import Def, DefRegistry, DimensionMismatch, DslSyntaxError, EngineError, Field, FieldType, InvalidState, NotFound, RelationType, RelationTypes
from lodeframe.operators import aggregates, graph, predicates, temporal, validate, vectors
from lodeframe.operators.predicates import All, Any, Compare
from lodeframe.operators.temporal import History
from lodeframe.plans import dsl
from lodeframe.plans.logical import PlanStep, route, run_plan
from lodeframe.sources.store import DocumentLog, replayable
from pyspark.sql import functions as F

VA, VB, VC = [0.9, 0.8, 0.7, 0.6, 0.1, 0.1, 0.1, 0.1], [0.85, 0.75, 0.65, 0.55, 0.15, 0.15, 0.15, 0.15], [0.1, 0.1, 0.1, 0.1, 0.9, 0.8, 0.7, 0.6]


def names(df):
    return sorted(r["name"] for r in df.collect())


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("shop")))
    tx = e.begin_tx()
    ids = {}
    for d, rows in {
        "Product": [("iPhone", 999, 1, 0), ("AirPods", 199, 1, 0), ("iPad", 2999, 0, 0), ("Watch", 399, 1, 0)],
        "Employee": [("Alice", 8000, 0, 5), ("Bob", 12000, 0, 7), ("Carol", 15000, 0, 9), ("Dave", 5000, 0, 3)],
        "Sale": [("s1", 100, 0, 0), ("s2", 200, 0, 0), ("s3", 300, 0, 0)],
        "User": [("Ann", 0, 0, 0), ("Ben", 0, 0, 80), ("Cid", 0, 0, 95), ("Dot", 0, 0, 60)],
    }.items():
        for name, w, s, p in rows:
            ids[name] = tx.create_being(**{"def": d}, name=name, weight=float(w), status=s, priority=p)
    for a, b in (("Ann", "Ben"), ("Ann", "Cid"), ("Ben", "Dot"), ("iPhone", "AirPods"), ("iPhone", "iPad")):
        tx.create_relation(ids[a], ids[b], 1)
    tx.commit()
    e.register_vector_field("embedding", 8)
    e.insert_vectors("embedding", spark.createDataFrame([(ids["iPhone"], VA), (ids["AirPods"], VB), (ids["iPad"], VC)], "id string, vector array<float>"))
    e.ids = ids
    return e


def test_filters_in_the_language(shop):
    ask = lambda t: names(shop.execute_dsl(t))
    assert ask("query { Product(filter: {weight > 500}) { id, name } }") == ["iPad", "iPhone"]
    assert len(ask("query { Product(filter: {status: 1}) { name } }")) == 3
    assert len(ask("query { Product(limit: 2) { name } }")) == 2
    assert ask("query { Product(limit: 0) { name } }") == []
    assert ask("query { Employee(filter: {weight > 10000}) { name } }") == ["Bob", "Carol"]
    assert ask("query { Employee(filter: {weight < 6000}) { name } }") == ["Dave"]
    assert ask("query { Employee(filter: {weight > 99999}) { name } }") == []
    assert len(ask("query { Employee(filter: {priority >= 5}) { name } }")) == 3
    assert ask('query {\n Employee(\n filter: {name: "Bob"} or {priority > 2.5} and {weight < -1.5e0} ) { name }\n}') == ["Bob"]
    assert ask("query { Employee(filter: {absent > 3}) { name } }") == []
    assert ask("query { Employee(filter: {name > 3}) { name } }") == []


def test_projection(shop):
    assert shop.execute_dsl("query { Product }").columns == ["id", "name", "def", "status", "weight", "priority", "category"]
    assert shop.execute_dsl("query { Product { title: name, code } }").columns == ["id", "title", "code"]


def test_aggregates(shop):
    one = lambda t: tuple(shop.execute_dsl(t).first())
    assert one("query { Sale(aggregate: {weight: sum}) }") == (600.0, 3, "sum")
    assert one("query { Sale(filter: {weight > 150}, aggregate: {weight: SUM}) }") == (500.0, 2, "sum")
    assert one("query { Sale(aggregate: {weight: median}) }")[0] == 200.0
    assert one("query { Sale(filter: {weight > 999}, aggregate: {weight: min}) }") == (None, 0, "min")
    assert one("query { Sale(aggregate: {weight: percentile(50)}) }")[0] == 200.0
    with pytest.raises(EngineError):
        shop.execute_dsl("query { Sale(aggregate: {weight: mode}) }")
    got = shop.execute_dsl("query { Employee(aggregate: {weight: avg}, groupBy: status) }").collect()
    assert [(r.status, r.aggregate) for r in got] == [(0, 10000.0)]


def test_fluent(shop):
    q = shop.query()
    assert q.scan("Employee").filter("name", "!=", "Carol").aggregate("weight", "sum").execute().first().aggregate == 25000.0
    assert names(q.scan("Employee").filter("name", "==", "Alice").execute()) == ["Alice"]
    assert q.being(shop.ids["Dave"]).fetch_one().name == "Dave"
    assert q.being("nobody").fetch_one() is None
    assert len(q.scan("Product").limit(2).fetch_all()) == 2
    assert [r.name for r in q.scan("Employee").order_by("weight", True).limit(2).select("name", "weight").fetch_all()] == ["Carol", "Bob"]
    assert names(q.being(shop.ids["Ann"]).with_relations(1).select("name").execute()) == ["Ann", "Ben", "Cid"]
    with pytest.raises(EngineError):
        q.scan("Product").filter("weight", "~", 1).execute()


def test_walks_from_the_language(shop):
    got = shop.execute_dsl("analyze { bfs on Ann(limit: 10) { } }").collect()
    assert sum(r.priority for r in got) == 235 and len(got) == 4
    # newest edge first
    assert [r.name for r in got] == ["Ann", "Cid", "Ben", "Dot"]
    assert [r.name for r in shop.execute_dsl('analyze { dfs on "Ann"(limit: 10) {} }').collect()] == ["Ann", "Cid", "Ben", "Dot"]
    assert [r.name for r in shop.execute_dsl("analyze { shortest_path on Ann(to: Dot) {} }").collect()] == ["Ann", "Ben", "Dot"]
    assert shop.execute_dsl("analyze { bfs on Nobody {} }").count() == 0
    ranks = shop.execute_dsl("analyze { pagerank on User {} }").collect()
    assert abs(sum(r["rank"] for r in ranks) - 1) < 1e-9
    with pytest.raises(DslSyntaxError):
        shop.execute_dsl("analyze { magic on Ann {} }")


def test_similar(shop):
    text = ", ".join(map(str, VA))
    first = shop.execute_dsl(f"similar {{ Product(query: [{text}], k: 3) {{ name }} }}").orderBy("distance").first()
    assert first.name == "iPhone" and first.relation_count == 2 and first.relations == ["iPad", "AirPods"] and first.weight == 999
    got = shop.query().scan("Product").similar_to(VA, 2).execute().orderBy("distance").collect()
    assert [r.name for r in got] == ["iPhone", "AirPods"]
    with pytest.raises(DimensionMismatch):
        shop.query().scan("Product").similar_to([1.0], 2).execute()
    with pytest.raises(DimensionMismatch):
        shop.insert_vectors("embedding", shop.spark.createDataFrame([("x", [1.0])], "id string, vector array<float>"))


def test_plans(shop):
    steps = [PlanStep("Scan", ("Employee",)), PlanStep("Filter", (Compare("weight", ">", 6000),)), PlanStep("Sort", ("weight", True)), PlanStep("Project", ("name",)), PlanStep("Limit", (2,))]
    assert [r.name for r in run_plan(steps, shop.catalog).collect()] == ["Carol", "Bob"]
    assert run_plan([PlanStep("Scan", ("Sale",)), PlanStep("Aggregate", ("weight", "max"))], shop.catalog).first().aggregate == 300
    with pytest.raises(EngineError):
        run_plan([PlanStep("Limit", (1,))], shop.catalog)
    assert route("point") == "graph" and route("similar") == "vector" and route("?") == "multi"


def test_mutations_and_versions(engine):
    engine.execute_dsl('mutation { create Note(input: {name: "one", weight: 2.5, color: "red"}) { id } }')
    assert names(engine.execute_dsl('query { Note(filter: {color: "red"}) { name } }')) == ["one"]
    assert engine.execute_dsl('mutation { update one(input: {description: "d"}) }').first().message == "Update one"
    assert engine.execute_dsl("query { Note { description } }").first().description == "d"
    assert engine.query().scan("Note").history("all").execute().count() == 2
    assert engine.query().scan("Note").history("last", 1).execute().count() == 1
    assert engine.execute_dsl("query { Note(history: at(1)) { description } }").first().description == ""
    engine.execute_dsl("mutation { delete one }")
    assert engine.query().scan("Note").execute().count() == 0
    assert engine.query().scan("Note").include_deleted().execute().first().status == 0
    log = engine.store.read("txlog").orderBy("seq").collect()
    assert [r.op for r in log] == ["CreateBeing", "UpdateBeing", "DeleteBeing"]
    assert engine.execute_dsl("mutation { delete nobody }").first().message == "Delete nobody"


def test_transactions(engine, spark):
    tx = engine.begin_tx()
    tx.create_being(**{"def": "T"}, name="x")
    assert engine.query().scan("T").execute().count() == 0  # nothing before the commit
    tx.create_relation("nobody", "nothing")
    with pytest.raises(NotFound):
        tx.commit()
    assert engine.query().scan("T").execute().count() == 0 and engine.store._manifest()["version"] == 0
    a = engine.write(**{"def": "T"}, name="a")
    b = engine.write(**{"def": "T"}, name="b")
    engine.relate(a, b, 4)
    assert graph.out_edges(engine.catalog.relations, a).first().to_id == b
    assert graph.in_edges(engine.catalog.relations, b).count() == 1
    again = Engine(spark, engine.store.files.base)
    assert again.query().scan("T").execute().count() == 2
    again.store.compact("beings", 2, "id")
    assert again.query().being(a).fetch_one().name == "a"
    assert not again.store.files.write("manifests/000000000001.json", "{}")


def test_definitions(engine):
    engine.execute_dsl("define type Course { field grade: Int { required, min: 0, max: 9 } field tags: Array<String> field m: Map<String,Float> { default: 1 } }")
    again = Engine(engine.spark, engine.store.files.base)
    d = again.defs.by_name("Course")
    assert [str(f.type) for f in d.fields] == ["Int", "Array<String>", "Map<String,Float>"] and d.fields[0].required and d.fields[0].max == 9 and d.fields[2].default == 1
    reg = DefRegistry()
    reg.register(Def("A", (Field("x", FieldType("Int")),)))
    assert reg.register(Def("A")).fields and reg.get_or_register("B").type_code == 2 and reg.by_code(2).name == "B" and len(reg.all()) == 2
    types = RelationTypes()
    types.register(RelationType(1, "owns"))
    assert types.register(RelationType(1, "other")).name == "owns" and types.by_name("owns").code == 1


def test_syntax_trees():
    assert dsl.parse("query { Person }") == dsl.Query("Person")
    q = dsl.parse("query { P(filter: {a: 1} and {b < 2} or {c >= 3}, limit: 5, history: last(2), other: 7) { x } }")
    assert q.where == Any((All((Compare("a", "==", 1), Compare("b", "<", 2))), Compare("c", ">=", 3)))
    assert q.limit == 5 and q.history == History("last", 2) and q.fields == (("x", "x"),)
    assert dsl.parse('mutation { create P(input: {name: "A", n: -2}) }') == dsl.Mutation("create", "P", {"name": "A", "n": -2})
    assert dsl.parse("similar { P(query: [1, 2.5], k: 3) { id } }") == dsl.SimilarTo("P", (1.0, 2.5), 3)
    assert dsl.parse("define type P { field a: Weird }").definition.fields[0].type == FieldType("String")
    for bad in ("", "select 1", "query { P", "query { P(filter: {a ! 1}) }", "query { P } trailing", "query { P(limit: 1.5) }", "query { and }", "similar { P(k: 1) }"):
        with pytest.raises(DslSyntaxError):
            dsl.parse(bad)


def test_config(tmp_path):
    save_config({**DEFAULTS, "engine": {"truncate": True}}, str(tmp_path / "c.toml"))
    assert load_config(str(tmp_path / "c.toml"))["engine"] == {"truncate": True, "metric": "cosine"}
    assert len(new_id()) == 36 and new_id() != new_id()


def test_truncation_is_an_option(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), config={**DEFAULTS, "engine": {"truncate": True}})
    e.write_batch(spark.createDataFrame([("i", "T", "a" * 100)], "id string, def string, name string"))
    assert len(e.query().fetch_one().name) == 63


# operators


@pytest.fixture(scope="module")
def graph5(spark):
    e = [("A", "B", 1, True, 1.0, 1), ("B", "C", 1, True, 1.0, 2), ("C", "D", 1, True, 5.0, 3), ("A", "E", 2, True, 1.0, 4)]
    return spark.createDataFrame(e, "from_id string, to_id string, relation_type int, directed boolean, weight double, ord long")


def start(spark, x):
    return spark.createDataFrame([(x,)], "id string")


def test_walks(spark, graph5):
    got = {r.id: r.depth for r in graph.bfs(graph5, start(spark, "A"), 2).collect()}
    assert got == {"A": 0, "B": 1, "E": 1, "C": 2}
    assert graph.dfs(graph5, "A", 3).orderBy("pos").first().id == "A"
    assert [r.id for r in graph.dfs(graph5, "A", 9).orderBy("pos").collect()] == ["A", "E", "B", "C", "D"]
    assert [r.id for r in graph.shortest_path(graph5, "A", "D").orderBy("step").collect()] == ["A", "B", "C", "D"]
    assert graph.shortest_path(graph5, "A", "A").count() == 1
    with pytest.raises(InvalidState):
        graph.shortest_path(graph5, "D", "A")
    assert {r.id for r in graph.bfs(graph5, start(spark, "A"), 5, graph.EdgeFilter(1, True, 2.0)).collect()} == {"A", "B", "C"}
    assert graph.EdgeFilter.by_type(2).apply(graph5).count() == 1 and graph.EdgeFilter.all().apply(graph5).count() == 4
    assert graph.bfs(graph5.limit(0), start(spark, "Z"), 3).count() == 1


def test_depth_first_depth_is_that_of_the_first_visit(spark):
    e = spark.createDataFrame([("A", "C", None, 1), ("A", "B", None, 2), ("B", "C", True, 3)], "from_id string, to_id string, directed boolean, ord long")
    assert [(r.id, r.depth) for r in graph.dfs(e, "A", 5).orderBy("pos").collect()] == [("A", 0), ("B", 1), ("C", 2)]


def test_undirected_edges_go_both_ways(spark):
    e = spark.createDataFrame([("A", "B", False, 1), ("C", "B", True, 2)], "from_id string, to_id string, directed boolean, ord long")
    assert {r.id for r in graph.bfs(e, start(spark, "B"), 3).collect()} == {"A", "B"}
    assert {(r.id, r.out_degree, r.in_degree) for r in graph.degrees(e).collect()} == {("A", 1, 1), ("B", 1, 2), ("C", 1, 0)}


def test_pagerank(spark, graph5):
    nodes = spark.createDataFrame([(x,) for x in "ABCDE"], "id string")
    got = {r.id: r["rank"] for r in graph.pagerank(nodes, graph5.unionByName(graph5.limit(1)), 10).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["B"] > got["E"]
    assert graph.pagerank(nodes.limit(0), graph5, 3).count() == 0


def test_aggregate_values(spark):
    df = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)] + [(None,)], "v double")
    got = {op: df.agg(aggregates.aggregate(op, F.col("v"))).first()[0] for op in ("count", "sum", "avg", "min", "max", "median", "stddev", "variance", "count_distinct")}
    assert got == {"count": 8, "sum": 40, "avg": 5, "min": 2, "max": 9, "median": 4.5, "stddev": 2, "variance": 4, "count_distinct": 5}
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert nan.agg(aggregates.aggregate("max", F.col("v"))).first()[0] == 1.0


def test_granules(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 20.0), (3, 30.0), (4, 5.0), (5, 25.0)], "ord long, v double")
    s = aggregates.granule_stats(df, "ord", "v", 2)
    assert sorted(r.granule for r in aggregates.prune_granules(s, 15, 22).collect()) == [1, 2]


def test_distances(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    got = one.select(
        vectors.cosine_distance(arr(1, 0, 0), arr(0, 1, 0)), vectors.cosine_distance(arr(0, 0), arr(1, 1)), vectors.l2_distance(arr(0, 0), arr(3, 4)), vectors.dot(arr(1, 2, 3), arr(4, 5, 6)),
        vectors.dot_distance(arr(1, 2, 3), arr(4, 5, 6)), vectors.hamming(F.array(F.lit(170)), F.array(F.lit(240))), vectors.binary_quantize(arr(-1, 0.5, -0.3, 0.8))[0],
        vectors.scalar_dequantize(vectors.scalar_quantize(arr(-0.5, 0, 0.5, 1), -1, 1), -1, 1), vectors.scalar_quantize(arr(1, 2), 3, 3), vectors.l2_normalize(arr(3, 4)), vectors.l2_normalize(arr(0, 0)),
    ).first()
    assert got[0] == 1 and got[1] == 1 and got[2] == 5 and got[3] == 32 and got[4] == -32 and got[5] == 4 and got[6] == 0b1010
    assert all(abs(a - b) < 0.01 for a, b in zip(got[7], (-0.5, 0, 0.5, 1)))
    assert got[8] == [0, 0] and got[9] == [0.6, 0.8] and got[10] == [0, 0]


def test_search_against_brute_force_and_the_index(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((600, 16)).astype(np.float32)
    x[5] = x[4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 16)], "id long, vector array<float>").repartition(5)
    q = df.where("id % 100 = 0 and id < 600")
    got = {(r.query_id, r["rank"]): r.id for r in vectors.knn_batch(df, q, 5).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for i in range(0, 600, 100):
        order = np.lexsort((np.arange(600), np.round(1 - u @ u[i], 9)))[:5]
        assert [got[(i, k + 1)] for k in range(5)] == order.tolist()
    assert [r.id for r in vectors.knn(df, x[4].tolist(), 2).collect()] == [4, 5]
    index = vectors.CoarseIndex(df, cells=12)
    assert index.rows.where("id < 600").count() == 600
    assert vectors.recall(index.search(q, 5, probes=12), vectors.knn_batch(df, q, 5)).first().recall == 1.0
    one = index.search(df.where("id = 7"), 3, probes=1)
    assert one.first().id == 7 and one.count() <= 3 and index.search(q.limit(0), 3).count() == 0
    with pytest.raises(EngineError):
        vectors.knn(df, [0.0] * 16, 1, "unknown")
    assert vectors.knn_batch(df, q.limit(0), 5).count() == 0 and vectors.knn(df.limit(0), [0.0] * 16, 3).count() == 0


def test_visibility(spark):
    def seen(begin, end, reader, active):
        df = spark.createDataFrame([(begin, end)], "b long, e long")
        return df.select(temporal.is_visible(F.col("b"), F.col("e"), reader, active)).first()[0]

    assert seen(10, None, 20, []) and seen(10, None, 10, [10]) and not seen(10, None, 20, [10])
    assert seen(10, 15, 20, []) and not seen(10, 15, 20, [15]) and seen(10, temporal.OPEN_TX, 20, [15])


def test_history_modes_with_a_hot_id(spark):
    data = [("hot", i, i + 1 if i < 499 else None, i * 10, i) for i in range(500)] + [("x", 3, 8, 30, 3), ("x", 8, None, 80, 8), (None, 1, None, 1, 1)]
    df = spark.createDataFrame(data, "id string, tx_begin long, tx_end long, updated_at long, ord long")
    get = lambda m, v=0: sorted((r.id, r.tx_begin) for r in temporal.apply_history(df, History(m, v), ["tx_begin", "ord"]).collect())
    assert get("current") == [("hot", 499), ("x", 8)]
    assert get("last", 2) == [("hot", 498), ("hot", 499), ("x", 3), ("x", 8)] and get("last", 0) == []
    assert get("at", 5) == [("hot", 5), ("x", 3)] and get("as_of", 35) == [("hot", 3), ("x", 3)]
    assert {(r.id, r.versions, r.head, r.tail) for r in temporal.version_chains(df, ["tx_begin", "ord"]).collect()} == {("hot", 500, 499, 0), ("x", 2, 8, 3)}


@pytest.mark.parametrize(
    "kind,good,bad",
    [
        ("Int", ["25", "-3"], ['"hello"', "1.0", "true"]), ("Float", ["1", "2.5"], ['"x"']), ("String", ['"a"'], ["1"]), ("Bool", ["true"], ["0"]), ("Array<Int>", ["[1,2]", "[]"], ['[1,"two"]', "3"]),
        ("Map<String,Float>", ['{"a":1,"b":2.5}', "{}"], ['{"a":"x"}', "[]"]), ("Array<Array<Int>>", ["[[1],[2]]"], ["[1]"]),
    ],
)
def test_types(spark, kind, good, bad):
    d = Def("T", (Field("f", FieldType.parse(kind)),))
    rows = [(v, "T", '{"f": %s}' % v) for v in good + bad] + [("none", "T", "{}"), ("null", "T", None), ("other", "U", '{"f": 1}')]
    df = spark.createDataFrame(rows, "id string, def string, ext string")
    assert {r.id for r in validate.violations(df, [d], ["id"]).collect()} == set(bad)


def test_ranges_and_required(spark):
    d = Def("T", (Field("age", FieldType("Int"), True, min=0, max=150), Field("open", FieldType("Int"), min=0)))
    rows = [("ok", "T", '{"age": 25, "open": -5}'), ("low", "T", '{"age": -1}'), ("high", "T", '{"age": 200}'), ("text", "T", '{"age": "hello"}'), ("none", "T", "{}"), ("junk", "T", "{")]
    got = {(r.id, r.problem) for r in validate.violations(spark.createDataFrame(rows, "id string, def string, ext string"), [d], ["id"]).collect()}
    assert got == {("low", "range"), ("high", "range"), ("text", "type"), ("none", "missing"), ("junk", "missing")}
    b = spark.createDataFrame([("a", "n", "d"), ("b", " ", "d"), ("c", None, None)], "id string, name string, def string")
    v = spark.createDataFrame([("a", "f", [1.0]), ("b", "f", []), ("c", "f", None), ("d", "g", [1.0, 2.0])], "id string, field string, vector array<float>")
    assert {(r.id, r.problem) for r in validate.invalid_vectors(v, {"f": 1, "g": 3}).collect()} == {("b", "empty"), ("c", "empty"), ("d", "dimension")}
    assert {(r.id, r.problem) for r in validate.invalid_beings(b).collect()} == {("b", "name"), ("c", "name"), ("c", "def")}


def test_log_is_cut_at_the_first_bad_record(spark):
    df = spark.createDataFrame([(i, None if i == 7 else i) for i in range(10)], "seq long, v long")
    assert replayable(df, F.col("v") >= 0).count() == 7
    assert replayable(df.where("v is not null"), F.col("v") >= 0).count() == 9
    assert replayable(df.limit(0), F.col("v") >= 0).count() == 0


def test_document_log(spark, tmp_path):
    log = DocumentLog(spark, str(tmp_path / "docs"))
    rows = spark.createDataFrame([("a", "D", 1, "{}", None, "more")], "being_id string, def string, stamp long, core string, ext string, other string")
    log.append(rows)
    log.append(rows)
    assert log.count() == 2 and log.find("a").count() == 2 and log.find("b").count() == 0 and log.scan().columns == ["being_id", "def", "stamp", "core", "ext"]


def test_conditions_push_down(spark, small):
    from lodeframe.plans import fixtures

    e = Engine(spark, catalog=fixtures.catalog(spark, small))
    plan = e.query().scan("Order").filter("weight", ">", 100000).select("name").execute()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "GreaterThan(o_totalprice,100000.0)" in plan
    assert predicates.column(Any((Compare("weight", ">", 1), Compare("weight", "<", 0)))) is not None


def test_more_conditions(shop):
    ask = lambda t: names(shop.execute_dsl(f"query {{ Employee(filter: {t}) {{ name }} }}"))
    assert ask("not {weight > 9000}") == ["Alice", "Dave"] and ask("not ({priority: 5} or {priority: 3})") == ["Bob", "Carol"]
    assert ask('{name in ["Bob", "Eve", null]}') == ["Bob"] and ask('{name not in ["Bob"]}') == ["Alice", "Carol", "Dave"] and ask("{weight in []}") == []
    assert ask("{weight between [5000, 8000]}") == ["Alice", "Dave"] and ask('{name like "%o%"}') == ["Bob", "Carol"] and ask("{weight like \"8%\"}") == []
    assert len(ask("{absent is null}")) == 4 and ask("{absent is not null}") == [] and len(ask("not {absent: 3}")) == 4
    assert ask("{priority < weight} and {weight > priority}") == ["Alice", "Bob", "Carol", "Dave"] and ask("{name == weight}") == [] and ask("{a > b}") == []
    for bad in ("{weight between [1]}", "{name like 3}", "{name is}", "{name near 3}", "not"):
        with pytest.raises(DslSyntaxError):
            ask(bad)
    q = shop.query().scan("Employee")
    assert names(q.where(F.col("weight") > 9000).execute()) == names(q.where(lambda attribute: attribute("weight") > 9000).execute()) == names(q.where(Compare("weight", ">", 9000)).execute()) == ["Bob", "Carol"]
    assert names(q.filter("name", "NOT  in", ["Bob"]).filter("weight", "between", (6000, 20000)).execute()) == ["Alice", "Carol"]
    assert names(q.where(Any(())).execute()) == [] and len(names(q.where(All(())).execute())) == 4


def test_a_def_is_that_of_the_newest_version(engine, spark):
    row = lambda kind, w: spark.createDataFrame([("x", kind, "n", w, '{"size": 3}')], "id string, def string, name string, weight double, ext string")
    engine.write_batch(row("Old", 1.0))
    engine.write_batch(row("New", 2.0))
    q = engine.query()
    assert q.scan("Old").execute().count() == 0 and [r.weight for r in q.scan("New").execute().collect()] == [2.0] and q.scan("").execute().count() == 1
    assert q.scan("Old").history("at", 1).execute().count() == 1 and q.scan("Old").history("at", 2).execute().count() == 0 and q.scan("Old").history("all").execute().count() == 1
    assert q.scan("Old").history("last", 1).execute().count() == 0 and q.scan("Old").history("last", 2).execute().count() == 1
    tx = engine.begin_tx()
    tx.update_being("x", **{"def": "Third", "color": "red"})
    tx.commit()
    got = q.__class__(engine.catalog).scan("Third").fetch_one()
    assert got["def"] == "Third" and '"color": "red"' in got.ext and "def" not in got.ext and '"size": 3' in got.ext
    assert engine.query().scan("New").execute().count() == 0 and engine.query().being("x").scan_limit(5).execute().count() == 1
    assert [r.name for r in engine.query().scan("Third").order_by("size", True).select("name").fetch_all()] == ["n"]


def test_equally_new_versions_are_one(spark):
    df = spark.createDataFrame([("a", "K", 1, 7, 1.0), ("a", "K", 1, 7, 2.0), ("b", "K", 1, 1, 1.0), ("b", "L", 2, 2, 1.0), ("c", None, 1, 1, 1.0)], "id string, def string, tx_begin long, ord long, weight double")
    order = ["tx_begin", "ord"]
    assert [r.id for r in temporal.newest(df, order, F.col("def") == "K").collect()] == ["a"]
    assert [r.id for r in temporal.newest(df, order, F.col("def") == "L").collect()] == ["b"] and temporal.newest(df, order).count() == 3


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_reach_the_scan(spark, small):
    from lodeframe.plans import fixtures

    q = Engine(spark, catalog=fixtures.catalog(spark, small)).query()
    plan = scans(q.being("c:42").select("name").execute())
    assert plan.count("FileScan") == 1 and "EqualTo(c_custkey,42)" in plan
    plan = scans(q.scan("Event").filter("created_at", ">=", 1704672000000000000).filter("created_at", "<", 1705276800000000001).select("name").execute())
    assert plan.count("FileScan") == 1 and "GreaterThanOrEqual(ts,2024-01-08T00:00)" in plan and "LessThan(ts,2024-01-15T00:00:00.000001)" in plan
    assert q.being("c:x").execute().count() == 0 and q.being("?:1").execute().count() == 0 and q.being("c:" + "9" * 30).execute().count() == 0 and q.scan("None").execute().count() == 0
    assert q.scan("Order").being("c:1").execute().count() == 1


def test_a_sorted_store_is_read_in_part(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.write_batch(spark.range(4000).select(F.format_string("%036d", "id").alias("id"), F.lit("T").alias("def"), F.lit("n").alias("name")))
    e.store.compact("beings", 8, "id")
    df = e.store.read("beings").where(F.col("id") == f"{1234:036d}")
    assert "EqualTo(id," in scans(df) and df.count() == 1
    rows = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    read = [int(m) for m in [rows.collectLeaves().apply(0).metrics().apply("numOutputRows").value()]]
    assert 0 < read[0] <= 600  # one file of eight


def test_exact_percentiles_of_groups(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"n": rng.standard_normal(2000), "ties": rng.integers(-2, 3, 999).astype(float), "wide": rng.standard_normal(500) * 10.0 ** rng.uniform(-200, 200, 500), "one": np.array([7.0]), None: np.array([3.0, 9.0]), "none": None}
    rows = [(k, None if x is None else float(x)) for k, v in groups.items() for x in ([None] if v is None else v)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for p in (0, 37, 50, 99.9, 100):
        got = {r.k: r.aggregate for r in aggregates.grouped_aggregate(df, ["k"], F.col("v"), f"percentile:{p}").collect()}
        for k, v in groups.items():
            assert got[k] is None if v is None else np.isclose(got[k], np.percentile(v, p), rtol=1e-9)
    odd = spark.createDataFrame([(float(x),) for x in ("nan", "inf", "-inf", "0", "-0.0", "5e-324")], "v double")
    assert aggregates.global_aggregate(odd, F.col("v"), "percentile:0").first().aggregate == float("-inf") and np.isnan(aggregates.global_aggregate(odd, F.col("v"), "percentile:100").first().aggregate)
    assert tuple(aggregates.global_aggregate(odd.limit(0), F.col("v"), "median").first()) == (None, 0, "median")
    assert abs(df.where("k = 'n'").agg(aggregates.aggregate("approx_median", F.col("v"))).first()[0] - np.median(groups["n"])) < 0.01
    with pytest.raises(EngineError):
        aggregates.grouping_sets(df, ["k"], F.col("v"), "sum", "every")


def test_paths_have_no_longest_length(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", True, i) for i in range(12)], "from_id string, to_id string, directed boolean, ord long")
    assert graph.shortest_path(chain, "n0", "n12").count() == 13 and graph.shortest_path(chain, "n0", "n3", 3).count() == 4
    with pytest.raises(InvalidState, match="at most 3 hops"):
        graph.shortest_path(chain, "n0", "n12", 3)
    with pytest.raises(InvalidState, match="does not exist"):
        graph.shortest_path(chain, "n3", "n0")


def test_a_hot_source_is_walked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(graph, "SLICE_EDGES", 7)
    star = [("hub", f"s{i}", True, 1.0, i) for i in range(300)] + [(f"s{i}", f"t{i % 5}", True, 1.0, 1000 + i) for i in range(300)] + [("t1", "hub", False, 1.0, 5000)]
    e = spark.createDataFrame(star, "from_id string, to_id string, directed boolean, weight double, ord long")
    rows, hot, name = graph._sliced(e)
    assert {r.from_id for r in hot.collect()} >= {"hub"} and rows.where("from_id = 'hub'").select("piece").distinct().count() > 20
    graph.drop(spark, name)
    got = {r.id: r.depth for r in graph.bfs(e, start(spark, "hub"), 3).collect()}
    assert got == {"hub": 0, **{f"s{i}": 1 for i in range(300)}, **{f"t{i}": 1 if i == 1 else 2 for i in range(5)}}
    nodes = spark.createDataFrame([(x,) for x in got], "id string")
    split = {r.id: r["rank"] for r in graph.pagerank(nodes, e, 4).collect()}
    monkeypatch.setattr(graph, "SLICE_EDGES", 10**6)
    whole = {r.id: r["rank"] for r in graph.pagerank(nodes, e, 4).collect()}
    assert abs(sum(split.values()) - 1) < 1e-9 and all(abs(split[i] - whole[i]) < 1e-12 for i in whole)
    assert abs(sum(r["rank"] for r in graph.pagerank(nodes, e, 0).collect()) - 1) < 1e-9


def test_scratch_tables_can_be_deleted(spark):
    import os

    from lodeframe.sources import tables

    df = tables.materialise(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    tables.discard(df)
    assert not os.path.exists(os.path.dirname(path))


def test_walks_and_names_see_the_present_versions(engine):
    for name in ("a", "b", "c"):
        engine.execute_dsl(f'mutation {{ create T(input: {{name: "{name}"}}) }}')
    ids = {r.name: r.id for r in engine.query().execute().collect()}
    engine.relate(ids["a"], ids["b"])
    engine.relate(ids["a"], ids["c"])
    engine.execute_dsl('mutation { update b(input: {name: "bb", weight: 2}) }')
    engine.execute_dsl("mutation { delete c }")
    assert names(engine.execute_dsl("analyze { bfs on a(limit: 3) {} }")) == ["a", "bb"] == names(engine.execute_dsl("analyze { dfs on a(limit: 3) {} }"))
    assert names(engine.query().being(ids["a"]).with_relations(2).select("name").execute()) == ["a", "bb"]
    assert engine.execute_dsl("analyze { bfs on b {} }").count() == 0  # nothing has that name now
    assert engine.execute_dsl("analyze { pagerank on a {} }").count() == 2
    engine.insert_vectors("embedding", engine.spark.createDataFrame([(ids["a"], [1.0, 0.0])], "id string, vector array<float>"))
    assert engine.execute_dsl("similar { T(query: [1, 0], k: 1) {} }").first().relations == ["bb"]
