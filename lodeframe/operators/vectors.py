"""Vector operators: distances, exact and approximate nearest neighbours, quantisation.

Distances of a few columns are Catalyst expressions. Searches multiply matrices in Arrow batches: each task keeps the best k of its
rows for each query, and only those meet, so that k rows per query and task are shuffled, whatever the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.model import DimensionMismatch, EngineError
from lodeframe.sources.tables import materialise

METRICS = ("cosine", "l2", "dot")
#: Queries that are broadcast together; larger sets of queries are answered in blocks of this many.
QUERY_BLOCK = 4096
#: Vectors that the coarse centres of an approximate index are fitted on, at most.
FIT_SAMPLE = 20_000
#: Rows in a file of such an index, at most about.
FILE_ROWS = 1_000_000


def _double(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; 1 if either vector has length 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.try_divide(dot(a, b), n))


def cosine_distance_of_units(a: Column | str, b: Column | str) -> Column:
    """1 - dot, for vectors already at length 1."""
    return F.lit(1.0) - dot(a, b)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot_distance(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b)


def l2_normalize(a: Column | str) -> Column:
    """The vector at length 1; one of (almost) no length stays as it is."""
    n = norm(a)
    return F.when(n > 1e-10, F.transform(_double(a), lambda x: x / n)).otherwise(_double(a))


def scalar_quantize(a: Column | str, lo: float, hi: float) -> Column:
    """Each number as 0..255 of the range [lo, hi]; all 0 if the range is empty."""
    if hi - lo == 0:
        return F.transform(_double(a), lambda x: F.lit(0))
    return F.transform(_double(a), lambda x: F.floor(F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def scalar_dequantize(q: Column | str, lo: float, hi: float) -> Column:
    return F.transform(_double(q), lambda x: F.lit(lo) + x / 255.0 * (hi - lo))


def binary_quantize(a: Column | str) -> Column:
    """A bit per number, set where it is positive, in bytes with the first number in the lowest bit."""
    v = _double(a)
    n = F.size(v)

    def byte(at: Column) -> Column:
        part = F.slice(v, at * 8 + 1, 8)
        return F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.pow(F.lit(2), i)).otherwise(F.lit(0.0)).cast("int")), F.lit(0), lambda s, b: s + b)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 8).cast("int")), byte)).otherwise(F.array().cast("array<int>"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Bits in which two arrays of bytes differ."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(rows, queries)."""
    s = x @ q.T
    if metric == "dot":
        return -s
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        return 1.0 - np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    if len(q) == 1:
        return np.linalg.norm(x - q[0], axis=1)[:, None]
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * s, 0))


def _matrix(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have ``dim`` finite numbers, and which they are."""
    ok = np.fromiter((v is not None and len(v) == dim for v in vectors), dtype=bool, count=len(vectors))
    x = np.stack(vectors[ok].to_numpy()).astype(np.float64) if ok.any() else np.zeros((0, dim))
    finite = np.isfinite(x).all(axis=1)
    return x[finite], np.flatnonzero(ok)[finite]


class _Best:
    """The k nearest of each query so far, by (distance, id)."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.edge = np.full(queries, np.inf)  # distance of the k-th
        self.query, self.distance, self.id = np.zeros(0, dtype=np.int64), np.zeros(0), None

    def offer(self, d: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> None:
        """d: (rows, queries). Only what may be among the k nearest is kept and sorted."""
        edge = self.edge[queries]
        if len(d) > self.k:
            edge = np.minimum(edge, np.partition(d, self.k - 1, axis=0)[self.k - 1])
        row, col = np.nonzero(d <= edge)
        if not len(row):
            return
        query, distance = np.concatenate([self.query, queries[col]]), np.concatenate([self.distance, d[row, col]])
        own = ids[row] if self.id is None else np.concatenate([self.id, ids[row]])
        order = np.lexsort((own, distance, query))
        query = query[order]
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(begin, append=len(query)))
        keep = order[rank < self.k]
        self.query, self.distance, self.id = query[rank < self.k], distance[order][rank < self.k], own[keep]
        last = np.flatnonzero(rank == self.k - 1)
        self.edge[query[last]] = distance[order][last]


def _search(rows: DataFrame, queries: list[tuple[object, list[float]]], k: int, metric: str, id_type: str, lists: tuple | None = None) -> DataFrame:
    """query_id, id, distance: the best k per task for each query of one block."""
    spark = rows.sparkSession
    names = [q for q, _ in queries]
    matrix = np.array([v for _, v in queries], dtype=np.float64)
    shared = spark.sparkContext.broadcast((names, matrix, lists))
    dim = matrix.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q, lists = shared.value
        best = _Best(len(q), k)
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096].reset_index(drop=True)
                x, where = _matrix(part["vector"], dim)
                if not len(x):
                    continue
                ids = np.array(part["id"].to_numpy()[where].tolist())
                if lists is None:
                    best.offer(np.round(_distances(x, q, metric), 9), ids, np.arange(len(q)))
                    continue
                cells = part["cell"].to_numpy()[where]
                for c in np.unique(cells):
                    if c in lists:
                        own = np.flatnonzero(cells == c)
                        best.offer(np.round(_distances(x[own], q[lists[c]], metric), 9), ids[own], lists[c])
        if len(best.query):
            yield pd.DataFrame({"query_id": [names[i] for i in best.query], "id": best.id, "distance": best.distance})

    cols = ["id", "vector"] + (["cell"] if lists is not None else [])
    return rows.select(*cols).mapInPandas(run, f"query_id {id_type}, id {id_type}, distance double")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _blocks(queries: DataFrame) -> Iterator[list[tuple[object, list[float]]]]:
    """The queries in blocks of at most about QUERY_BLOCK; each block is small, and only one is held at a time. Vectors that are null or
    have null, NaN or infinite numbers ask nothing."""
    n = queries.count()
    parts = max(1, math.ceil(n / QUERY_BLOCK))
    for p in range(parts):
        block = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
        rows = [(r.id, r.vector) for r in block.select("id", "vector").collect() if r.vector is not None and all(x is not None and math.isfinite(x) for x in r.vector)]
        if rows:
            yield rows


def knn(rows: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """rank, id, distance of the k nearest rows (id, vector) to one vector; ties by id.

    Vectors of another length raise, if there is any (a wrong length is no data but a mistake); null vectors and vectors with
    null, NaN or infinite numbers are left out. k beyond the table gives all rows; an empty table none.
    """
    if metric not in METRICS:
        raise EngineError(f"unknown metric {metric!r}")
    id_type = rows.schema["id"].dataType.simpleString()
    found = _search(_checked(rows, len(query)), [(None, query)], max(k, 1), metric, id_type)
    return _top(found, k).drop("query_id")


def _checked(rows: DataFrame, dim: int) -> DataFrame:
    wrong = rows.where(F.col("vector").isNotNull() & (F.size("vector") != dim)).select(F.size("vector").alias("n")).take(1)
    if wrong:
        raise DimensionMismatch(f"expected {dim} numbers, found {wrong[0].n}")
    return rows


def knn_batch(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, rank, id, distance of the k nearest rows of every query (id, vector), the row itself included."""
    id_type = rows.schema["id"].dataType.simpleString()
    out = None
    for block in _blocks(queries):
        found = _search(rows, block, k, metric, id_type)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], f"query_id {id_type}, id {id_type}, distance double")
    return _top(out, k)


class CoarseIndex:
    """An inverted index of cells around coarse centres (cosine).

    The centres are fitted on at most FIT_SAMPLE rows (those with the smallest hash of their id, so the same rows each
    time); every row is then put into the cell of its nearest centre, once, in files sorted by cell, of which a search reads those that
    may hold the ``probes`` cells nearest to its queries. A large cell lies in several files.
    """

    def __init__(self, rows: DataFrame, cells: int | None = None, rounds: int = 10):
        n = rows.count()
        usable = rows.where("vector is not null")
        sample = usable if n <= FIT_SAMPLE else usable.orderBy(F.xxhash64("id")).limit(FIT_SAMPLE)
        vectors = sample.select("id", "vector").orderBy(F.xxhash64("id")).toPandas()["vector"]
        dim = max((len(v) for v in vectors), default=1)
        x, _ = _matrix(vectors, dim)
        x = x if len(x) else np.zeros((1, dim))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        cells = max(1, min(cells or int(math.sqrt(max(n, 1))), len(x), 4096))
        c = x[np.linspace(0, len(x) - 1, cells).astype(int)]
        for _ in range(rounds):
            home = (x @ c.T).argmax(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, home, x)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
        self.centres = c
        self.id_type = rows.schema["id"].dataType.simpleString()
        shared = rows.sparkSession.sparkContext.broadcast(c)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = shared.value
            for pdf in batches:
                x, where = _matrix(pdf["vector"], c.shape[1])
                yield pdf.iloc[where].assign(cell=(x @ c.T).argmax(axis=1).astype(np.int32))

        assigned = rows.select("id", "vector").mapInPandas(assign, f"id {self.id_type}, vector array<float>, cell int")
        files = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // FILE_ROWS)
        self.rows = materialise(materialise(assigned, "cells").repartitionByRange(files, "cell", F.xxhash64("id")).sortWithinPartitions("cell"), "index")

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """query_id, rank, id, distance."""
        out = None
        for block in _blocks(queries):
            q = np.array([v for _, v in block], dtype=np.float64)
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            near = np.argsort(-(q @ self.centres.T), axis=1)[:, :probes]
            lists: dict[int, list[int]] = {}
            for i, cells in enumerate(near):
                for c in cells:
                    lists.setdefault(int(c), []).append(i)
            rows = self.rows.where(F.col("cell").isin(sorted(lists)))  # reaches the scan, which skips files and row groups
            found = _search(rows, block, k, "cosine", self.id_type, {c: np.array(v) for c, v in lists.items()})
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.rows.sparkSession.createDataFrame([], f"query_id {self.id_type}, id {self.id_type}, distance double")
        return _top(out, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row, recall: the share of the exact neighbours that were found."""
    hit = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
