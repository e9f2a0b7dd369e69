"""Graph operators on a table of relations.

Traversals go one hop per round: the frontier joins the relations, what was visited before is taken out, and the new
frontier is written to the shared folder, so that plans stay short and a lost executor costs one round. The order in which a
queue-based traversal would discover nodes is kept without any global numbering: each node carries the list of
(negative) edge orders on its way, and such lists, of equal length within a round, compare as discovery does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodeframe.model import InvalidState
from lodeframe.operators.skew import heavy_candidates
from lodeframe.sources.tables import bucketed, discard, drop, materialise, scratch_path

#: A depth-first order can't be computed in parallel; a subgraph with more edges than this is refused.
DFS_EDGES = 5_000_000
#: A walk spreads the edges of a source that has more than HOT_SHARE of all over SLICES slices.
HOT_SHARE, SLICES = 0.005, 32
#: Edges (to different nodes) of one source in a slice, in PageRank.
SLICE_EDGES = 1_000_000


@dataclass(frozen=True)
class EdgeFilter:
    """Conditions on edges, all of which must hold; None stands for any."""

    relation_type: int | None = None
    directed: bool | None = None
    max_weight: float | None = None

    @staticmethod
    def all() -> EdgeFilter:
        return EdgeFilter()

    @staticmethod
    def by_type(code: int) -> EdgeFilter:
        return EdgeFilter(relation_type=code)

    def apply(self, relations: DataFrame) -> DataFrame:
        out = relations
        if self.relation_type is not None:
            out = out.where(F.col("relation_type") == self.relation_type)
        if self.directed is not None:
            out = out.where(F.col("directed") == self.directed)
        if self.max_weight is not None:
            out = out.where(F.col("weight") <= self.max_weight)
        return out


def reversed_edges(relations: DataFrame) -> DataFrame:
    """The relations with their ends exchanged."""
    return relations.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id")})


def symmetrised(relations: DataFrame) -> DataFrame:
    """Undirected relations in both directions, directed ones as they are. A null ``directed`` is directed."""
    return relations.unionByName(reversed_edges(relations.where(~F.col("directed") & (F.col("from_id") != F.col("to_id")))))


def out_edges(relations: DataFrame, node: str) -> DataFrame:
    """Edges from a node, newest first."""
    return symmetrised(relations.where((F.col("from_id") == node) | (F.col("to_id") == node))).where(F.col("from_id") == node).orderBy(F.desc("ord"))


def in_edges(relations: DataFrame, node: str) -> DataFrame:
    """Edges to a node, newest first."""
    return symmetrised(relations.where((F.col("from_id") == node) | (F.col("to_id") == node))).where(F.col("to_id") == node).orderBy(F.desc("ord"))


def degrees(relations: DataFrame) -> DataFrame:
    """id, out_degree, in_degree; parallel edges count each."""
    e = symmetrised(relations)
    ends = e.select(F.inline(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.where("id is not null").groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _sliced(edges: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(the edges in buckets of their source and slice, the hot sources, the name of the table).

    Edges of a source with more than HOT_SHARE of all are spread over SLICES slices by their target; of other sources
    the slice is 0. Hot sources are at most 2 / HOT_SHARE, whatever the graph.
    """
    hot = heavy_candidates(edges, "from_id", HOT_SHARE).select("from_id", F.lit(True).alias("hot"))
    rows = edges.join(F.broadcast(hot), "from_id", "left")
    piece = F.when(F.col("hot"), F.pmod(F.xxhash64("to_id"), F.lit(SLICES)).cast("int")).otherwise(F.lit(0))
    out, name = bucketed(rows.withColumn("piece", piece).drop("hot"), ["from_id", "piece"], "edges")
    return out, hot, name


def _in_slices(nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """nodes (id) with a row for each slice that their edges may be in."""
    rows = nodes.join(F.broadcast(hot.withColumnRenamed("from_id", "id")), "id", "left")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("piece", F.explode(every)).drop("hot")


def _rounds(relations: DataFrame, starts: DataFrame, depth: int | None, keep_path: bool = False, target: str | None = None) -> tuple[DataFrame, int, bool | None]:
    """All visited nodes (id, way in the order of discovery, with keep_path path, depth); the last depth that has any; and
    whether ``target`` was reached (None: not yet when ``depth`` ended the walk).

    Each round is a folder of one table, so what was visited is one scan of ids. With more than one round the edges are
    put into buckets once, and a round moves its frontier only.
    """
    spark = relations.sparkSession
    edges = symmetrised(relations).where("from_id is not null and to_id is not null").select("from_id", "to_id", F.coalesce("ord", F.lit(0)).cast("long").alias("ord"))
    base = scratch_path(spark, "walk")
    schema = "id string, way array<bigint>" + (", path array<string>" if keep_path else "")

    def save(nodes: DataFrame, d: int) -> tuple[int, bool]:
        seen = Observation()
        hit = F.max((F.col("id") == F.lit(target)).cast("int")) if target is not None else F.lit(0)
        nodes.observe(seen, F.count(F.lit(1)).alias("n"), hit.alias("hit")).write.parquet(f"{base}/depth={d}")
        return seen.get.get("n") or 0, bool(seen.get.get("hit"))

    first = starts.select("id").where("id is not null").distinct().select("id", F.array().cast("array<bigint>").alias("way"))
    n, hit = save(first.withColumn("path", F.array("id")) if keep_path else first, 0)
    visited = lambda: spark.read.schema(f"{schema}, depth int").option("basePath", base).parquet(base)
    hot = name = None
    if depth is None or depth > 1:
        edges, hot, name = _sliced(edges)
    d = 0
    while n and not hit and (depth is None or d < depth):
        d += 1
        last = spark.read.schema(schema).parquet(f"{base}/depth={d - 1}")
        joined = last.join(edges.withColumnRenamed("from_id", "id"), "id") if hot is None else _in_slices(last, hot).join(edges.withColumnRenamed("from_id", "id"), ["id", "piece"])
        kept = [F.concat("path", F.array("to_id")).alias("path")] if keep_path else []
        step = joined.select(F.col("to_id").alias("id"), F.concat("way", F.array(-F.col("ord"))).alias("way"), *kept)
        best = step.groupBy("id").agg(F.min(F.struct("way", *["path"] * keep_path)).alias("b"))
        new = best.join(visited().select("id"), "id", "left_anti").select("id", "b.way", *["b.path"] * keep_path)
        n, hit = save(new, d)
    if name:
        drop(spark, name)
    return visited(), d, True if hit else None if n and target is not None else False


def bfs(relations: DataFrame, starts: DataFrame, depth: int, edge_filter: EdgeFilter | None = None) -> DataFrame:
    """id, depth, way of the nodes within ``depth`` hops of ``starts`` (column id), which have depth 0.

    (depth, way) is the order of discovery: parents in their order, edges newest first. Starts that no relation
    mentions are in the result; null ids aren't.
    """
    seen, _, _ = _rounds((edge_filter or EdgeFilter()).apply(relations), starts, depth)
    return seen.select("id", "depth", "way")


def shortest_path(relations: DataFrame, start: str, goal: str, max_depth: int | None = None, edge_filter: EdgeFilter | None = None) -> DataFrame:
    """step, id of a path with the fewest hops, of several the one discovered first.

    Goes on until nothing new is reached, unless the caller gives a ``max_depth``. Raises InvalidState without a path, and
    with other words where max_depth ended the search.
    """
    starts = relations.sparkSession.createDataFrame([(start,)], "id string")
    seen, d, hit = _rounds((edge_filter or EdgeFilter()).apply(relations), starts, max_depth, True, goal)
    if not hit:
        raise InvalidState("path does not exist" if hit is False else f"no path of at most {max_depth} hops")
    return seen.where((F.col("depth") == d) & (F.col("id") == goal)).select(F.posexplode("path").alias("step", "id"))


def dfs(relations: DataFrame, start: str, depth: int, edge_filter: EdgeFilter | None = None) -> DataFrame:
    """pos, id, depth of a depth-first walk in pre-order, children newest edge first.

    A node's depth is that of its first visit, not the shortest; nodes beyond ``depth`` aren't visited. Only the edges within
    reach enter the walk, which is one sequential task; more than DFS_EDGES of them raise InvalidState.
    """
    chosen = (edge_filter or EdgeFilter()).apply(relations)
    spark = relations.sparkSession
    near = bfs(chosen, spark.createDataFrame([(start,)], "id string"), depth).select("id")
    edges = symmetrised(chosen).where("to_id is not null").join(near.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select("from_id", "to_id", F.coalesce("ord", F.lit(0)).alias("ord"))
    edges = materialise(edges, "dfs")
    if edges.count() > DFS_EDGES:
        raise InvalidState(f"the subgraph has more than {DFS_EDGES} edges")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        children: dict[str, list] = {}
        for pdf in batches:
            for a, b, o in zip(pdf["from_id"], pdf["to_id"], pdf["ord"]):
                children.setdefault(a, []).append((o, b))
        seen, out, stack = set(), [], [(start, 0)]
        while stack:
            node, d = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((len(out), node, d))
            if d < depth:
                # the newest edge is taken first, so it goes on the stack last
                stack.extend((b, d + 1) for _, b in sorted(children.get(node, ())) if b not in seen)
        yield pd.DataFrame(out, columns=["pos", "id", "depth"])

    return edges.coalesce(1).mapInPandas(walk, "pos bigint, id string, depth int")


def pagerank(nodes: DataFrame, relations: DataFrame, iterations: int, damping: float = 0.85) -> DataFrame:
    """id, rank after exactly ``iterations`` rounds; the ranks sum to 1.

    Every node starts with 1/N. What nodes without out-edges hold is spread over all. Parallel edges count each; undirected ones
    both ways; edges from or to unknown nodes don't count.
    """
    spark = relations.sparkSession
    ids = materialise(nodes.select("id").where("id is not null").distinct(), "nodes")
    n = ids.count()
    if n == 0:
        return ids.withColumn("rank", F.lit(0.0))
    known = ids.select(F.col("id").alias("from_id"))
    e = symmetrised(relations).groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("k"))
    e = materialise(e.join(known, "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi"), "edges")
    out = materialise(e.groupBy("from_id").agg(F.sum("k").alias("out"), F.ceil(F.count(F.lit(1)) / SLICE_EDGES).cast("int").alias("pieces")), "degrees")
    # the edges are shuffled once, those of a source with very many in slices; each round moves only ranks and sums
    piece = F.pmod(F.xxhash64("to_id"), F.col("pieces")).cast("int")
    share, t1 = bucketed(e.join(out, "from_id").select("from_id", piece.alias("piece"), "to_id", (F.col("k") / F.col("out")).alias("share")), ["from_id", "piece"], "shares")
    base, t2 = bucketed(ids.join(out.select(F.col("from_id").alias("id"), "pieces"), "id", "left").select("id", F.coalesce("pieces", F.lit(0)).alias("pieces")), ["id"], "nodes")
    discard(e, out)
    ranks, lost = None, base.where("pieces = 0").count() / n
    for _ in range(max(iterations, 1)):
        if not iterations:
            ranks = materialise(base.select("id", F.lit(1.0 / n).alias("rank")), "ranks")
            break
        held = base.withColumn("rank", F.lit(1.0 / n)) if ranks is None else ranks
        sent = held.where("pieces > 0").select(F.col("id").alias("from_id"), "rank", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        got = sent.join(share, ["from_id", "piece"]).groupBy(F.col("to_id").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))
        new = base.join(got, "id", "left").select("id", "pieces", rank.alias("rank"))
        # what nodes without out-edges hold is summed while the ranks are written
        sinks = Observation()
        written = materialise(new.observe(sinks, F.sum(F.when(F.col("pieces") == 0, F.col("rank"))).alias("lost")), "ranks")
        lost = sinks.get.get("lost") or 0.0
        if ranks is not None:
            discard(ranks)
        ranks = written
    drop(spark, t1, t2)
    discard(ids)
    return ranks.select("id", "rank")


def connected(nodes: DataFrame, relations: DataFrame, present: bool = True) -> DataFrame:
    """The nodes that have (or lack) an edge out of them."""
    e = symmetrised(relations).select(F.col("from_id").alias("id"))
    return nodes.join(e, "id", "left_semi" if present else "left_anti")


def neighbour_names(hits: DataFrame, relations: DataFrame, beings: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """hits (with id) and relations (names of the out-neighbours, newest edge first) and relation_count; null without any.

    beings: a row for each id, or a function that gives the rows of some ids.
    """
    e = symmetrised(relations).join(hits.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    if callable(beings):
        beings = beings(e.select(F.col("to_id").alias("id")))
    names = e.join(beings.select(F.col("id").alias("to_id"), "name", "ord").withColumnsRenamed({"name": "_name", "ord": "_o"}), "to_id")
    lists = names.groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("ord")).alias("o"), F.col("_name").alias("name")))).alias("r"))
    return hits.join(lists.select("id", F.col("r.name").alias("relations"), F.size("r").alias("relation_count")), "id", "left")
