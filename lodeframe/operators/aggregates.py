"""Aggregates over one column, grouped or not, and the min-max summaries of granules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.model import EngineError


def aggregate(op: str, c: Column) -> Column:
    """count, sum, avg, min, max, median, stddev, variance (both of the population), count_distinct, percentile:P.

    approx_count_distinct has an error of 1 % (standard deviation), approx_median and approx_percentile:P one of 1/10,000 of the
    ranks; they keep little per group, however many values it has. Null is not a value; NaN counts, but min and max leave it out. Without values: count 0, sum and avg 0.0, others null.
    """
    name, _, arg = op.lower().partition(":")
    c = c.cast("double")
    number = F.when(~F.isnan(c), c)
    ops = {
        "count": lambda: F.count(c).cast("double"),
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0.0)),
        "avg": lambda: F.coalesce(F.avg(c), F.lit(0.0)),
        "min": lambda: F.min(number),
        "max": lambda: F.max(number),
        "median": lambda: F.median(c),
        "stddev": lambda: F.stddev_pop(c),
        "variance": lambda: F.var_pop(c),
        "count_distinct": lambda: F.count_distinct(c).cast("double"),
        "percentile": lambda: F.percentile(c, F.lit(float(arg or 50) / 100)),
        "approx_median": lambda: F.percentile_approx(c, 0.5, 10_000),
        "approx_percentile": lambda: F.percentile_approx(c, float(arg or 50) / 100, 10_000),
        "approx_count_distinct": lambda: F.approx_count_distinct(c, 0.01).cast("double"),
    }
    if name not in ops:
        raise EngineError(f"unknown aggregate {op!r}")
    return ops[name]()


def _share(op: str) -> float | None:
    """The share of an exact median or percentile, None for other aggregates."""
    name, _, arg = op.lower().partition(":")
    return 0.5 if name == "median" else float(arg or 50) / 100 if name == "percentile" else None


def _octave(x: Column) -> Column:
    """A whole number that rises with x, the same for numbers within 1/256 of an octave; NaN is above all."""
    size = F.abs(x)
    e = F.floor(F.log2(size))
    cell = (e + 1100) * 256 + F.floor((size / F.pow(F.lit(2.0), e) - 1) * 256) + 1
    cell = F.when(size == 0, F.lit(0)).when(F.isnan(x), F.lit(2_000_000)).when(size == float("inf"), F.lit(1_000_000)).when(size < 1e-300, F.lit(1)).otherwise(cell)
    return (F.when(x < 0, -cell).otherwise(cell)).cast("long")


def percentile_by_rank(df: DataFrame, keys: list[str], c: Column, share: float) -> DataFrame:
    """keys, aggregate, count: the exact percentile (interpolated between two ranks) of each group, nulls being no values.

    No group is sorted or kept in one task: counts per octave cell tell the cell of a rank, counts in 65,536 parts of
    that cell its part, and only the distinct values of one part are ranked. Each count is partial before its shuffle.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], c.cast("double").alias("_x")).where("_x is not null").withColumn("_c", _octave(F.col("_x")))
    all_one = not names
    if all_one:
        names, rows = ["_k"], rows.withColumn("_k", F.lit(0))

    def places(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
        """The cells with how many values of their group are before them."""
        w = Window.partitionBy(*by).orderBy(cell)
        return counts.withColumn("_b", F.sum("_n").over(w) - F.col("_n"))

    cells = places(rows.groupBy(*names, "_c").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")), names, "_c")
    cells = cells.withColumn("_t", F.sum("_n").over(Window.partitionBy(*names)))
    at = F.lit(share) * (F.col("_t") - 1)
    ranks = F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    wanted = cells.withColumn("_r", F.filter(ranks, lambda r: (r >= F.col("_b")) & (r < F.col("_b") + F.col("_n")))).where(F.size("_r") > 0)
    wanted = wanted.withColumn("_r", F.transform("_r", lambda r: r - F.col("_b"))).select(*names, "_c", "_lo", "_hi", "_b", "_r", "_t")

    other = wanted.select(*[F.col(n).alias(f"w{n}") for n in (*names, "_c", "_lo", "_hi")])
    own = reduce(Column.__and__, [rows[n].eqNullSafe(other[f"w{n}"]) for n in names]) & (rows["_c"] == other["w_c"])
    part = F.when(F.col("w_hi") == F.col("w_lo"), F.lit(0)).otherwise(F.floor((F.col("_x") - F.col("w_lo")) / (F.col("w_hi") - F.col("w_lo")) * 65536)).cast("long")
    near = rows.join(other, own).select(*names, "_c", "_x", part.alias("_p"))
    by = [*names, "_c"]
    fine = places(near.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n")), by, "_p")
    fine = fine.join(wanted.select(*[F.col(n).alias(f"w{n}") for n in (*by, "_r", "_b", "_t")]), reduce(Column.__and__, [fine[n].eqNullSafe(F.col(f"w{n}")) for n in by]))
    fine = fine.withColumn("_q", F.filter("w_r", lambda r: (r >= F.col("_b")) & (r < F.col("_b") + F.col("_n")))).where(F.size("_q") > 0)
    fine = fine.select(*[F.col(n).alias(f"f{n}") for n in (*by, "_p")], F.transform("_q", lambda r: r - F.col("_b")).alias("_q"), (F.col("w_b") + F.col("_b")).alias("_before"), F.col("w_t").alias("_t"))
    by = [*by, "_p"]
    last = near.join(fine, reduce(Column.__and__, [near[n].eqNullSafe(fine[f"f{n}"]) for n in by]))
    last = places(last.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"), F.first("_q").alias("_q"), F.first("_before").alias("_before"), F.first("_t").alias("_t")), by, "_x")
    hits = last.select(*names, "_x", "_t", F.explode(F.filter("_q", lambda r: (r >= F.col("_b")) & (r < F.col("_b") + F.col("_n")))).alias("_r"), "_before")
    hits = hits.withColumn("_r", F.col("_r") + F.col("_before"))
    value = F.min(F.struct("_r", "_x")), F.max(F.struct("_r", "_x"))
    out = hits.groupBy(*names).agg(value[0].alias("_u"), value[1].alias("_v"), F.first("_t").alias("_t"))
    step = F.lit(share) * (F.col("_t") - 1) - F.col("_u._r")
    got = F.when(F.col("_u._x") == F.col("_v._x"), F.col("_u._x")).otherwise(F.col("_u._x") * (1 - step) + F.col("_v._x") * step)
    return out.select(*([] if all_one else [F.col(n).alias(k) for n, k in zip(names, keys)]), got.alias("aggregate"), F.col("_t").alias("count"))


def global_aggregate(df: DataFrame, c: Column, op: str) -> DataFrame:
    """One row: aggregate, count (of values), op."""
    share = _share(op)
    if share is not None:
        out = percentile_by_rank(df, [], c, share).agg(F.first("aggregate").alias("aggregate"), F.coalesce(F.first("count"), F.lit(0)).alias("count"))
    else:
        out = df.agg(aggregate(op, c).alias("aggregate"), F.count(c).alias("count"))
    return out.withColumn("op", F.lit(op.lower()))


def grouped_aggregate(df: DataFrame, keys: list[str], c: Column, op: str) -> DataFrame:
    """keys, aggregate, count: a row per group; null is a group of its own. Partial sums precede the shuffle."""
    share = _share(op)
    if share is None:
        return df.groupBy(*keys).agg(aggregate(op, c).alias("aggregate"), F.count(c).alias("count"))
    some = percentile_by_rank(df, keys, c, share).withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(keys)})
    every = df.select(*keys).distinct()  # groups without values too
    out = every.join(some, reduce(Column.__and__, [every[k].eqNullSafe(some[f"_g{i}"]) for i, k in enumerate(keys)]), "left")
    return out.select(*keys, "aggregate", F.coalesce("count", F.lit(0)).alias("count"))


def grouping_sets(df: DataFrame, keys: list[str], c: Column, op: str, kind: str = "cube") -> DataFrame:
    """keys, level, aggregate, count for all subsets of the keys (cube) or their beginnings (rollup).

    level has a bit for each key that a row sums over, the first key's the highest; such a key is null.
    """
    if kind not in ("cube", "rollup"):
        raise EngineError(f"unknown grouping sets {kind!r}")
    by = df.cube(*keys) if kind == "cube" else df.rollup(*keys)
    return by.agg(F.grouping_id().alias("level"), aggregate(op, c).alias("aggregate"), F.count(c).alias("count"))


def first_written(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys, value: the value of the first row in ``order`` (nulls first) of each key; a minimum, so partial before the shuffle."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order, value)).alias("_f")).select(*keys, F.col("_f")[value].alias(value))


def granule_stats(df: DataFrame, order: str, value: str, size: int) -> DataFrame:
    """granule, lo, hi, n: the range of ``value`` in each run of ``size`` numbers of ``order``; nulls have no part in it."""
    g = F.floor(F.col(order) / size).cast("long")
    return df.groupBy(g.alias("granule")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))


def prune_granules(stats: DataFrame, lo: float, hi: float) -> DataFrame:
    """The granules that may hold a value of [lo, hi]."""
    return stats.where((F.col("hi") >= lo) & (F.col("lo") <= hi))
