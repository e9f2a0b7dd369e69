"""Clusters of mutually similar vectors.

Each partition builds a cluster-feature tree (entries: count, sum of unit vectors) in one pass over its rows. The
leaf summaries with two or more members are merged in a tree of reductions, never all at once; Ward's criterion then
agglomerates what is left, joining only summaries whose means are similar enough. A full pass gives every node its
cluster. Nodes without one (about as many as there are nodes like no other, and the members of clusters so small that no
partition saw two of them) are compared with each other, block by block, so none of their pairs is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.ids import ref_id
from lodeframe.sources.tables import materialise

DIM = 64
#: Least cosine similarity of two nodes of a cluster.
LIMIT = 0.8
#: A tree may ask more of a leaf: this cosine to the leaf's mean. The clusters' trees don't.
LEAF = 0.9
#: Leaves per inner node of the tree.
BRANCH = 32
#: Leaves at which a tree is full, and summaries that the driver takes at a time.
MAX_LEAVES = 20_000
FAN_IN = 8
#: The pass over what is left: nodes that all others are compared with at a time, and nodes per task aimed at.
COMPARED, PER_TASK = 131_072, 4096
#: Members of a cluster in a slice, when it is described.
SLICE = 100_000
SUMMARY = "n bigint, total array<double>"


def usable_nodes(nodes: DataFrame, dim: int = DIM) -> DataFrame:
    """id, unit (the vector at length 1) of each usable node, an id once.

    Usable: ``dim`` finite numbers, not all 0, none null. Of different vectors under one id the smallest (as an array, at length 1) counts.
    Rows whose id refers to nothing are no nodes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            right = np.fromiter((v is not None and len(v) == dim for v in pdf["vector"]), dtype=bool, count=len(pdf))
            pdf = pdf[right]
            if not len(pdf):
                continue
            x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)  # a null number comes as NaN
            big = np.abs(x).max(axis=1)
            ok = np.isfinite(x).all(axis=1) & (big > 0)
            # scaled by the largest number first, so that neither large nor tiny numbers leave the range of doubles
            x = _units(x[ok] / big[ok, None]).astype(np.float32)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[ok], "unit": list(x)})

    rows = nodes.select(ref_id("id").alias("id"), "vector").where("id is not null and vector is not null")
    return rows.mapInPandas(run, "id string, unit array<float>").groupBy("id").agg(F.min("unit").alias("unit"))


class FeatureTree:
    """A cluster-feature tree of two levels above its leaves' summaries.

    ``add`` inserts summaries (count, sum of unit vectors) as a block: each descends to the inner node with the nearest
    mean, then to the nearest leaf there, which takes it if the average cosine between the members of both (the product of
    their means) reaches LIMIT and the cosine of the means reaches ``similar``; what fits no leaf makes new ones. As nodes of a
    cluster have LIMIT with each other and with no other node, the average reaches it just when both are of one cluster. An inner node with too many leaves splits. With more than MAX_LEAVES leaves the threshold falls, to
    LIMIT at most, and the tree is built anew of its own leaves.
    """

    def __init__(self, dim: int, similar: float = LEAF):
        self.dim, self.similar = dim, similar
        self.n = np.zeros(0)
        self.total = np.zeros((0, dim))
        self.inner = np.zeros((0, dim))  # sums over the leaves of an inner node
        self.parent = np.zeros(0, dtype=np.int64)

    def add(self, n: np.ndarray, total: np.ndarray) -> None:
        for at in range(0, len(n), 512):
            self._add(n[at : at + 512], total[at : at + 512])
        if len(self.n) > MAX_LEAVES and self.similar > LIMIT:
            old_n, old_total = self.n, self.total
            smaller = FeatureTree(self.dim, max(LIMIT, self.similar * 0.95))
            smaller.add(old_n, old_total)
            self.__dict__.update(smaller.__dict__)

    def _add(self, n: np.ndarray, total: np.ndarray) -> None:
        unit, mean = _units(total), total / n[:, None]
        if len(self.n):
            means, leaf_units = self.total / self.n[:, None], _units(self.total)
            home = (unit @ _units(self.inner).T).argmax(axis=1)
            leaf = np.full(len(n), -1)
            for h in np.unique(home):
                rows, own = np.flatnonzero(home == h), np.flatnonzero(self.parent == h)
                s = mean[rows] @ means[own].T
                best = s.argmax(axis=1)
                fits = (s[np.arange(len(rows)), best] >= LIMIT) & ((unit[rows] * leaf_units[own[best]]).sum(axis=1) >= self.similar)
                leaf[rows[fits]] = own[best[fits]]
            got = leaf >= 0
            np.add.at(self.n, leaf[got], n[got])
            np.add.at(self.total, leaf[got], total[got])
            np.add.at(self.inner, home[got], total[got])
            n, total, unit, mean = n[~got], total[~got], unit[~got], mean[~got]
        if not len(n):
            return
        # the rest of the block: leaders among themselves, in the order of the rows
        close = (mean @ mean.T >= LIMIT) & (unit @ unit.T >= self.similar)
        np.fill_diagonal(close, True)
        leader = np.full(len(n), -1)
        for i in range(len(n)):
            if leader[i] < 0:
                leader[close[i] & (leader < 0)] = i
        heads, inverse = np.unique(leader, return_inverse=True)
        new_n, new_total = np.zeros(len(heads)), np.zeros((len(heads), self.dim))
        np.add.at(new_n, inverse, n)
        np.add.at(new_total, inverse, total)
        home = (_units(new_total) @ _units(self.inner).T).argmax(axis=1) if len(self.inner) else np.zeros(len(heads), dtype=np.int64)
        if not len(self.inner):
            self.inner = np.zeros((1, self.dim))
        np.add.at(self.inner, home, new_total)
        self.n, self.total, self.parent = np.concatenate([self.n, new_n]), np.concatenate([self.total, new_total]), np.concatenate([self.parent, home])
        size = np.bincount(self.parent, minlength=len(self.inner))
        for h in np.flatnonzero(size > BRANCH):
            self._split(int(h))

    def _split(self, h: int) -> None:
        """Two inner nodes of one, around its two most different leaves, until none is too large."""
        own = np.flatnonzero(self.parent == h)
        u = _units(self.total[own])
        a = int((u @ u[0]).argmin())
        b = int((u @ u[a]).argmin())
        second = u @ u[b] > u @ u[a]
        if not second.any() or second.all():
            return
        self.parent[own[second]] = len(self.inner)
        self.inner = np.concatenate([self.inner, self.total[own[second]].sum(axis=0, keepdims=True)])
        self.inner[h] = self.total[own[~second]].sum(axis=0)
        for k in (h, len(self.inner) - 1):
            if (self.parent == k).sum() > BRANCH:
                self._split(k)

    def summaries(self, least: int = 2) -> pd.DataFrame:
        keep = self.n >= least
        return pd.DataFrame({"n": self.n[keep].astype(np.int64), "total": pd.Series(list(self.total[keep]), dtype=object)})


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _trees(vectors: DataFrame, dim: int) -> DataFrame:
    """n, total of the leaves with two or more members of each partition's trees.

    vectors: n, total. A tree that is full gives its leaves and another begins, so memory is bounded and no leaf is mixed. What
    that leaves apart meets when the summaries are merged, or in the pass over what is left.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = FeatureTree(dim, LIMIT)
        for pdf in batches:
            if len(pdf):
                tree.add(pdf["n"].to_numpy(dtype=np.float64), np.stack(pdf["total"].to_numpy()).astype(np.float64))
            if len(tree.n) > MAX_LEAVES:
                yield tree.summaries()
                tree = FeatureTree(dim, LIMIT)
        yield tree.summaries()

    return vectors.mapInPandas(run, SUMMARY)


def partition_summaries(nodes: DataFrame, dim: int = DIM) -> DataFrame:
    """n, total of the leaves with two or more members of each partition's trees."""
    return _trees(nodes.select(F.lit(1).cast("long").alias("n"), F.col("unit").alias("total")), dim)


def reduce_summaries(summaries: DataFrame, sources: int, dim: int = DIM) -> DataFrame:
    """The leaves of ``sources`` partitions' trees merged FAN_IN partitions at a time."""
    left = max(1, sources)
    out = summaries
    while left > FAN_IN:
        left = math.ceil(left / FAN_IN)
        out = _trees(out.repartition(left, F.xxhash64("total", F.lit(left))), dim)
    return out


def ward(n: np.ndarray, total: np.ndarray, limit: float = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Agglomeration of summaries: the pair that adds least to the sum of squares first, as long as the average cosine
    between the members of two summaries (the product of their means) reaches ``limit``. Returns (n, total) of the clusters.

    Summaries that no chain of such pairs connects never merge, so each connected set is agglomerated by itself.
    """
    if not len(n):
        return n, total
    mean = total / n[:, None]
    left = np.ones(len(n), dtype=bool)
    for at in range(0, len(n), 512):  # those that nothing is near, at once
        near = mean[at : at + 512] @ mean.T >= limit
        near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        left[at : at + 512] = near.any(axis=1)
    out_n, out_total = [n[~left].astype(np.float64)], [total[~left].astype(np.float64)]
    for i in range(len(n)):
        if not left[i]:
            continue
        left[i] = False
        members, at = [i], 0
        while at < len(members):
            rest = np.flatnonzero(left)
            near = rest[mean[rest] @ mean[members[at]] >= limit]
            left[near] = False
            members.extend(near.tolist())
            at += 1
        a, b = _ward(n[members], total[members], limit)
        out_n.append(a)
        out_total.append(b)
    return np.concatenate(out_n), np.concatenate(out_total)


def _ward(n: np.ndarray, total: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Agglomeration by chains of nearest neighbours: for Ward's criterion they merge the pairs that the cheapest first would, and need the costs
    of one summary at a time, not of all pairs."""
    n, total = n.astype(np.float64).copy(), total.astype(np.float64).copy()
    alive = np.ones(len(n), dtype=bool)
    mean = total / n[:, None]
    square = (mean * mean).sum(axis=1)
    chain: list[int] = []
    first = 0
    while first < len(n):
        if not alive[first]:
            first += 1
            continue
        i = chain[-1] if chain else first
        s = mean @ mean[i]
        cost = np.where(alive & (s >= limit), n * n[i] / (n + n[i]) * (square + square[i] - 2 * s), np.inf)
        cost[i] = np.inf
        j = int(cost.argmin())
        if not np.isfinite(cost[j]):  # only where a chain begins, as nearness is mutual; no merger brings others nearer, so it is done
            chain = []
            first += 1
        elif len(chain) > 1 and cost[chain[-2]] <= cost[j]:
            j = chain[-2]
            chain = chain[:-2]
            n[i] += n[j]
            total[i] += total[j]
            alive[j] = False
            mean[i] = total[i] / n[i]
            square[i] = mean[i] @ mean[i]
        else:
            chain = [*chain, j] if chain else [i, j]
    return n[alive], total[alive]


def _centres(summaries: DataFrame, dim: int = DIM) -> Iterator[np.ndarray]:
    """Means of the clusters, at most MAX_LEAVES at a time.

    So many summaries come to the driver, those that belong to their clusters are left out, and the next are taken.
    """
    left = materialise(summaries.withColumn("no", F.monotonically_increasing_id()), "summaries")
    while True:
        rows = left.orderBy("no").limit(MAX_LEAVES).toPandas()
        if not len(rows):
            return
        last, full = int(rows["no"].max()), len(rows) == MAX_LEAVES
        rows = rows.sort_values("n", ascending=False, kind="stable")
        tree = FeatureTree(dim, LIMIT)
        tree.add(rows["n"].to_numpy(dtype=np.float64), np.stack(rows["total"].to_numpy()))
        n, total = ward(tree.n, tree.total)
        means = total / n[:, None]
        yield means
        if not full:
            return
        left = materialise(_apart(left.where(F.col("no") > last), means), "summaries")


def _nearest(x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and product of the row of m with the largest product, for each row of x."""
    best, top = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ m.T
        best[at : at + 1024] = b = s.argmax(axis=1)
        top[at : at + 1024] = s[np.arange(len(s)), b]
    return best, top


def _apart(summaries: DataFrame, means: np.ndarray) -> DataFrame:
    """The summaries that belong to none of the clusters."""
    shared = summaries.sparkSession.sparkContext.broadcast(means.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["total"].to_numpy()) / pdf["n"].to_numpy()[:, None]
                yield pdf[_nearest(x.astype(np.float32), shared.value)[1] < LIMIT - 1e-6]

    return summaries.mapInPandas(run, summaries.schema)


def assign(nodes: DataFrame, means: np.ndarray, first: int = 0) -> DataFrame:
    """nodes with cluster (null: none), the summary to whose members the average cosine is largest.

    A node of a cluster has at least LIMIT on average; a node that has it is similar enough to some member.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(means.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["unit"].to_numpy())
            best, top = _nearest(x, m)
            ok = top >= LIMIT - 1e-6
            cluster = pd.array(np.where(ok, best + first, 0), dtype="Int64")
            cluster[~ok] = pd.NA
            yield pd.DataFrame({"id": pdf["id"], "unit": pdf["unit"], "cluster": cluster})

    return nodes.select("id", "unit").mapInPandas(run, "id string, unit array<float>, cluster bigint")


def _assigned(nodes: DataFrame, summaries: DataFrame, dim: int = DIM) -> tuple[list[DataFrame], DataFrame]:
    """(nodes with their cluster, in parts; id and unit of the others).

    As no node belongs to two clusters, one that a cluster took needn't be compared with later ones.
    """
    parts, rest, first = [], nodes.select("id", "unit"), 0
    for means in _centres(summaries, dim):
        once = materialise(assign(rest, means, first), "assigned")
        parts.append(once.where("cluster is not null"))
        rest, first = once.where("cluster is null").select("id", "unit"), first + len(means)
    return parts, rest


def least_similar(rest: DataFrame, size: int, dim: int = DIM) -> DataFrame:
    """id, cluster_id (the smallest id, its own included, at LIMIT) of each of ``size`` nodes that no summary took.

    All pairs are compared once: COMPARED nodes at a time are sent to the tasks of the nodes not sent before, and both nodes of a pair
    learn of each other. Work grows with the square of ``size``, memory doesn't grow.
    """
    steps = math.ceil(size / COMPARED)
    rows = rest.select("id", "unit", F.pmod(F.xxhash64("id"), F.lit(steps)).alias("step"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"ids": [pdf["id"].tolist()], "units": [np.stack(pdf["unit"].to_numpy()).astype(np.float32).tobytes()]})

    def step(k: int) -> DataFrame:
        packed = rows.where(F.col("step") == k).select("id", "unit").mapInPandas(pack, "ids array<string>, units binary").collect()
        ids = np.array([i for p in packed for i in p.ids], dtype=object)
        units = np.concatenate([np.zeros(0, dtype=np.float32), *(np.frombuffer(p.units, dtype=np.float32) for p in packed)]).reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        shared = rest.sparkSession.sparkContext.broadcast((ids[order], units[order]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            theirs, y = shared.value
            back = np.full(len(y), None, dtype=object)  # the smallest id of a later step, for the nodes of this one
            for pdf in batches:
                if not len(pdf):
                    continue
                x, mine_id, later = np.stack(pdf["unit"].to_numpy()), pdf["id"].to_numpy(), pdf["step"].to_numpy() != k
                least = np.full(len(x), -1)
                for i in range(0, len(x), 1024):
                    mine = least[i : i + 1024]
                    for j in range(0, len(y), 8192):  # ids ascend, so the first hit is the smallest
                        hit = x[i : i + 1024] @ y[j : j + 8192].T >= LIMIT - 1e-6
                        some = hit.any(axis=1)
                        new = (mine < 0) & some
                        mine[new] = j + hit[new].argmax(axis=1)
                        for r in np.flatnonzero(some & later[i : i + 1024]):
                            own = mine_id[i + r]
                            for c in j + np.flatnonzero(hit[r]):
                                if back[c] is None or own < back[c]:
                                    back[c] = own
                got = least >= 0
                yield pd.DataFrame({"id": mine_id[got], "cluster_id": theirs[least[got]]})
            got = np.flatnonzero([b is not None for b in back])
            yield pd.DataFrame({"id": theirs[got], "cluster_id": back[got]})

        todo = rows.where(F.col("step") >= k)
        out = materialise(todo.repartition(math.ceil(size * (steps - k) / steps / PER_TASK), "id").mapInPandas(run, "id string, cluster_id string"), "similar")
        shared.unpersist()
        return out

    return reduce(DataFrame.union, map(step, range(steps))).groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))


def clusters(nodes: DataFrame, dim: int = DIM) -> DataFrame:
    """id, unit, cluster_id (the smallest id of the cluster), size of every usable node.

    A node alone is a cluster of size 1 under its own id. Ties of closeness to two clusters go to the larger summary.
    """
    units = materialise(usable_nodes(nodes, dim), "units")
    first = partition_summaries(units, dim)
    parts, rest = _assigned(units, reduce_summaries(first, units.rdd.getNumPartitions(), dim), dim)
    out = reduce(DataFrame.unionByName, parts) if parts else None
    if out is not None:
        groups = out.groupBy("cluster").agg(F.min("id").alias("cluster_id"), F.count(F.lit(1)).alias("size"))
        out = out.join(groups, "cluster").select("id", "unit", "cluster_id", "size")
    size = rest.count()
    if size or out is None:
        kin = materialise(rest.join(least_similar(rest, max(1, size), dim), "id"), "kin")
        single = kin.join(kin.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")), "cluster_id").select("id", "unit", "cluster_id", "size")
        out = single if out is None else out.unionByName(single)
    return out


def found(nodes: DataFrame) -> DataFrame:
    """id, cluster_id of the nodes of clusters of two or more."""
    return clusters(nodes).where("size >= 2").select("id", "cluster_id")


def described(nodes: DataFrame, typical: int = 5, dim: int = DIM) -> DataFrame:
    """cluster_id, size, rank, id, closeness: each cluster of two or more with its ``typical`` members nearest its centre.

    closeness is the cosine to the mean of all members, rounded to four digits; ties go to the smaller id. A cluster meets its
    centre, and is cut down to its best, in slices of SLICE members, so one with most of the nodes is no burden.
    """
    rows = materialise(clusters(nodes, dim).where("size >= 2"), "clusters")
    total = F.array(*(F.sum(F.col("unit")[k].cast("double")) for k in range(dim)))
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    centres = rows.groupBy("cluster_id").agg(total.alias("total"), F.first("size").alias("_n"))
    centres = centres.select("cluster_id", "total", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / SLICE).cast("int") - 1)).alias("_s"))

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)

    near = rows.withColumn("_s", F.pmod(F.xxhash64("id"), slices).cast("int")).join(centres, ["cluster_id", "_s"])
    length = F.sqrt(dot("total", "total") * dot("unit", "unit"))
    near = near.select("cluster_id", "size", "_s", "id", F.round(F.when(length > 0, dot("unit", "total") / length).otherwise(F.lit(0.0)), 4).alias("closeness"))
    order = [F.col("closeness").desc(), F.col("id")]
    part = near.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id", "_s").orderBy(*order))).where(F.col("_r") <= typical)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).where(F.col("rank") <= typical)
    return ranked.select("cluster_id", "size", "rank", "id", "closeness")
