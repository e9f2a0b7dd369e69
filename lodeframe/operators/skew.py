"""Aggregates per key where a few keys hold most rows.

Heavy keys are found with a mergeable top-k sketch, their rows meet the (bounded) list of heavy keys in a broadcast
join and are summed under a salt; the other keys take the ordinary shuffle; the two results are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.ids import referred_id, refers

#: A key of the sketch is tracked for each 1/SLOTS share of the rows; its error stays far below any share used here.
SLOTS = 8192
SALTS = 16


def heavy_candidates(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that may hold at least ``share`` of the rows: a superset with at most 2 / share keys, as a local table.

    One pass with the frequent-items sketch (partial sketches merge, nothing is sampled). Its error is below
    3.5 / SLOTS of the rows, so that every key of that share is among the first 2 / share of the sketch.
    Null keys are not keys. An empty table gives no row.
    """
    k = max(1, int(2 / share))
    top = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k({key}, {k}, {max(SLOTS, k)})").alias("top")).first()[0] or []
    return df.sparkSession.createDataFrame([(r["item"],) for r in top], df.select(key).schema)


def aggregate_skewed(df: DataFrame, key: str, partial: dict[str, Column], final: dict[str, Column], share: float = 0.005) -> DataFrame:
    """One row per non-null key with the aggregates of ``final``, which combine those of ``partial``.

    Rows of heavy keys are grouped by (key, salt) first, so no task gets more than its part of one key.
    """
    known = df.where(F.col(key).isNotNull())
    heavy = heavy_candidates(df, key, share)
    # at most 2 / share keys, whatever the size of the table
    marked = known.join(F.broadcast(heavy.select(key, F.lit(True).alias("__heavy"))), key, "left")
    hot = marked.where(F.col("__heavy")).withColumn("__salt", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(SALTS)))
    hot = hot.groupBy(key, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    rest = marked.where(F.col("__heavy").isNull()).groupBy(key).agg(*[c.alias(n) for n, c in partial.items()])
    done = hot.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])
    return rest.select(key, *final).unionByName(done.select(key, *final))


def from_id_totals(df: DataFrame) -> DataFrame:
    """from_id, n_rows, sum_weight, last_created_at of a table of edges.

    References to nothing (null, empty, blank, nil ids) are left out; null weights count as rows but add nothing
    (sum_weight is null where all are null); NaN weights are left out of the sum. Repeated rows count.
    """
    weight = F.when(~F.isnan("weight"), F.col("weight")).cast("decimal(28,6)")
    rows = df.where(refers("from_id")).select(referred_id("from_id").alias("from_id"), weight.alias("_w"), F.col("created_at").alias("_t"))
    partial = {"n_rows": F.count(F.lit(1)), "sum_weight": F.sum("_w").cast("decimal(38,6)"), "last_created_at": F.max("_t")}
    final = {"n_rows": F.sum("n_rows"), "sum_weight": F.sum("sum_weight").cast("decimal(38,6)"), "last_created_at": F.max("last_created_at")}
    out = aggregate_skewed(rows, "from_id", partial, final)
    return out.select("from_id", "n_rows", F.round(F.col("sum_weight").cast("double"), 4).alias("sum_weight"), "last_created_at")


def heavy_from_ids(df: DataFrame, table_name: str, share: float = 0.02) -> DataFrame:
    """table_name, from_id of the ids that hold at least ``share`` of all rows of the table.

    The sketch names the candidates; one exact count of only these decides. Rows that refer to nothing count in the
    whole but are no key. An empty table has none.
    """
    rows = df.where(refers("from_id")).select(referred_id("from_id").alias("from_id"))
    candidates = heavy_candidates(rows, "from_id", share)
    counts = rows.join(F.broadcast(candidates), "from_id").groupBy("from_id").agg(F.count(F.lit(1)).alias("n"))
    total = df.count()  # of parquet files from their footers
    return counts.where(F.col("n") >= F.lit(share) * total).select(F.lit(table_name).alias("table_name"), "from_id")
