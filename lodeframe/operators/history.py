"""The history of entity attributes: which state held in which period.

Captures come repeated, late and corrected. Of captures with the same begin the one recorded last supersedes the
others (nothing is overwritten: ``ledger`` keeps them with the time until which they were believed); a sweep over the
begins of the ledger's believed captures cuts overlaps, and touching periods with equal attributes become one.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.ids import norm_id

#: Fixed value: the end of a period that is open.
OPEN = 9223372036854775807
#: A being with more captures than this share of all, and HOT_ROWS, is swept in pieces.
HOT_SHARE = 0.005
HOT_ROWS = 10_000
PIECES = 64


def captures(nodes: DataFrame) -> DataFrame:
    """being_id, tx_begin, tx_end, recorded_at, attrs of the captures that were ever valid.

    A missing tx_end is open. Captures without being or begin, and those that end at or before their begin,
    are ignored. A null core is a state whose attributes are all null.
    """
    core = F.col("core")
    attrs = F.struct(
        core["status"].alias("status"), core["name"].alias("name"), F.coalesce(core["code"], F.lit("")).alias("code"), core["weight"].alias("weight"), core["priority"].alias("priority"), F.coalesce(core["category"], F.lit("")).alias("category")
    )
    rows = nodes.select(norm_id("being_id").alias("being_id"), "tx_begin", F.coalesce("tx_end", F.lit(OPEN)).alias("tx_end"), F.col("created_at").alias("recorded_at"), "node_no", attrs.alias("attrs"))
    return rows.where("being_id <> '' and tx_begin is not null and tx_end > tx_begin")


def ledger(nodes: DataFrame) -> DataFrame:
    """All captures with both times: valid from tx_begin to tx_end, believed from recorded_at to superseded_at.

    superseded_at is the recorded time of the next capture with the same begin (of equal times the one with the larger node_no
    comes later; a null time is the earliest). ``believed`` marks the captures that none superseded, one for each being and begin.
    """
    known = captures(nodes)
    return _ledger(known, _hot_bounds(known)[1])


def _ledger(known: DataFrame, pairs: dict[tuple[str, int], list[int]]) -> DataFrame:
    rows = known.withColumn("_r", F.coalesce("recorded_at", F.lit(-(2**63))))
    rows = _in_pieces(rows, F.concat_ws("\0", "being_id", "tx_begin"), {f"{b}\0{t}": v for (b, t), v in pairs.items()}, "_r")
    hot = reduce(Column.__or__, [(F.col("being_id") == b) & (F.col("tx_begin") == t) for b, t in pairs]) if pairs else None
    rows = _neighbour(rows, ["being_id", "tx_begin"], ["_r", "node_no"], F.struct("recorded_at"), True, "_next", hot)
    return rows.select(*known.columns, F.col("_next.recorded_at").alias("superseded_at"), F.col("_next").isNull().alias("believed"))


def _hot_bounds(rows: DataFrame) -> tuple[dict[str, list[int]], dict[tuple[str, int], list[int]]]:
    """Of the beings with very many captures, begins that split them into pieces; of such a being and a begin with very many
    captures, recorded times that split these.

    At most 1 / HOT_SHARE beings are hot and some 2 / HOT_SHARE begins, each with PIECES bounds, which is all that reaches the driver.
    """
    n = rows.count()
    hot_ids = rows.groupBy("being_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max(HOT_ROWS, n * HOT_SHARE)).select("being_id")
    at = [i / PIECES for i in range(1, PIECES)]
    hot = rows.join(F.broadcast(hot_ids), "being_id").groupBy("being_id").agg(F.count(F.lit(1)).alias("k"), F.percentile_approx("tx_begin", at, 10000).alias("b")).collect()
    bounds = {r.being_id: sorted(set(r.b)) for r in hot}
    again = [(r.being_id, t) for r in hot for t, k in Counter(r.b).items() if k > 1 and k / PIECES * r.k * 2 >= n * HOT_SHARE]
    if not again:
        return bounds, {}
    named = rows.sparkSession.createDataFrame(again, "being_id string, tx_begin long")
    times = rows.join(F.broadcast(named), ["being_id", "tx_begin"]).groupBy("being_id", "tx_begin").agg(F.percentile_approx("recorded_at", at, 10000).alias("b")).collect()
    return bounds, {(r.being_id, r.tx_begin): sorted(set(r.b or [])) for r in times}


def _in_pieces(rows: DataFrame, key: Column, bounds: dict, by: str) -> DataFrame:
    """rows with a column piece: 0, but for hot keys the number of the range in which ``by`` lies."""
    if not bounds:
        return rows.withColumn("piece", F.lit(0))
    b = F.create_map(*[x for k, v in bounds.items() for x in (F.lit(k), F.array(*[F.lit(t).cast("long") for t in v]).cast("array<bigint>"))])
    below = F.size(F.filter(F.try_element_at(b, key), lambda t: t <= F.col(by)))
    return rows.withColumn("piece", F.greatest(F.coalesce(below, F.lit(0)), F.lit(0)))


def _neighbour(rows: DataFrame, keys: list[str], order: list[str], value: Column, after: bool, name: str, hot: Column | None) -> DataFrame:
    """rows (keys, piece, order, ...) with ``value`` of the next (or previous) row of the keys.

    Within a piece by a window; the row at the edge of a piece takes it from the summary of the pieces, of which only
    hot keys have more than one.
    """
    w = Window.partitionBy(*keys, "piece").orderBy(*order)
    rows = rows.withColumn("_v", F.struct(value.alias("v")))
    rows = rows.withColumn(name, (F.lead("_v") if after else F.lag("_v")).over(w))
    if hot is not None:
        edge = rows.where(hot).groupBy(*keys, "piece").agg((F.min_by if after else F.max_by)(F.col("_v"), F.struct(*order)).alias("_e"))
        by = Window.partitionBy(*keys).orderBy("piece")
        edge = edge.withColumn("_e", (F.lead("_e") if after else F.lag("_e")).over(by))
        rows = rows.join(F.broadcast(edge), [*keys, "piece"], "left")  # at most PIECES rows for each hot key
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.col("_e"))).drop("_e")
    return rows.withColumn(name, F.col(name)["v"]).drop("_v")


def periods(nodes: DataFrame) -> DataFrame:
    """being_id, tx_begin, tx_end (-1 while open), attrs: one row per period in which the attributes stayed the same.

    From the ledger's captures that are still believed.
    """
    known = captures(nodes)
    bounds, pairs = _hot_bounds(known)
    hot = F.col("being_id").isin(list(bounds)) if bounds else None
    near = lambda df, value, after, name: _neighbour(df, ["being_id"], ["tx_begin"], value, after, name, hot)
    rows = _ledger(known, pairs).where("believed").select("being_id", "tx_begin", "tx_end", "attrs")
    rows = _in_pieces(rows, F.col("being_id"), bounds, "tx_begin")
    rows = near(rows, F.col("tx_begin"), True, "next_begin")
    rows = rows.withColumn("valid_to", F.least("tx_end", F.coalesce("next_begin", F.lit(OPEN)))).withColumn("is_last", F.col("next_begin").isNull()).drop("next_begin")
    rows = near(rows, F.struct("valid_to", "attrs"), False, "before")
    # a period starts where there is nothing before, a gap, or another state
    starts = F.col("before").isNull() | (F.col("before.valid_to") < F.col("tx_begin")) | ~F.col("before.attrs").eqNullSafe(F.col("attrs"))
    rows = rows.select("being_id", "piece", "tx_begin", "attrs", F.col("before.valid_to").alias("before_end"), "valid_to", "is_last", starts.alias("starts"))
    # it ends where the row before the next start did, and the being's last period with the being's last row
    ends = near(rows.where("starts or is_last"), F.when(F.col("starts"), F.col("before_end")).otherwise(F.col("valid_to")), True, "until").where("starts")
    end = F.coalesce("until", "valid_to")
    return ends.select("being_id", "tx_begin", F.when(end == OPEN, F.lit(-1).cast("long")).otherwise(end).alias("tx_end"), "attrs")
