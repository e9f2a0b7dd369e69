"""Versions of beings: visibility, snapshots and history modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.model import OPEN_TX, EngineError

SLICES = 32


@dataclass(frozen=True)
class History:
    """current, all, last (value: how many), at (value: a transaction) or as_of (value: a time in ns)."""

    mode: str = "current"
    value: int = 0


def is_visible(begin: Column, end: Column, reader: int, active: list[int]) -> Column:
    """Whether a version is visible to a reading transaction while others are active.

    Its own versions are; those begun by an active transaction aren't; ended ones are, unless an active one ended them.
    A null end is open.
    """
    running = F.array(*[F.lit(t).cast("long") for t in active]) if active else F.array().cast("array<bigint>")
    is_open = end.isNull() | (end == OPEN_TX)
    return F.when(begin == reader, F.lit(True)).when(F.array_contains(running, begin), F.lit(False)).when(is_open, F.lit(True)).otherwise(~F.array_contains(running, end))


def newest(versions: DataFrame, order: list[str], only: Column | None = None) -> DataFrame:
    """The newest version of each id, of several equally new ones the one with the largest values.

    A maximum, so an id with most of the rows is reduced before the shuffle. With ``only`` a condition that the newest must
    meet: ids and orders alone tell which ids those are, and only rows that meet it are read whole.
    """
    known, top = versions.where("id is not null"), F.struct(*order)
    if only is not None:
        met = F.struct(*order, F.coalesce(only, F.lit(False)).alias("_met"))
        ids = known.groupBy("id").agg(F.max(met).alias("_t")).where("_t._met").select("id", F.struct(*[F.col("_t")[c].alias(c) for c in order]).alias("_t"))
        # nothing is newer, so no less means as new; as a comparison it leaves the join partitioned by id, as the maximum needs it
        known = known.where(only).join(ids, "id").where(top >= F.col("_t")).drop("_t")
    row = F.struct(*[F.col(c) for c in versions.columns])
    return known.groupBy("id").agg(F.max_by(row, top).alias("_r")).select("_r.*")


def last_n(versions: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n versions of each id, cut down in slices first, so that a hot id meets n rows of each slice only."""
    if n <= 0:
        return versions.limit(0)
    by = [F.col(c).desc_nulls_last() for c in order]
    rows = versions.where("id is not null").withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)))
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("id", "__slice").orderBy(*by))).where(F.col("__rank") <= n)
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("id").orderBy(*by))).where(F.col("__rank") <= n)
    return rows.drop("__slice", "__rank")


def apply_history(versions: DataFrame, history: History, order: list[str], only: Column | None = None) -> DataFrame:
    """The versions that a history mode selects, and of these the ones that meet ``only``.

    at: begun at or before the transaction and not ended then, the newest of each id; as_of: the newest whose updated_at
    is not later.
    """
    if history.mode == "all":
        return versions if only is None else versions.where(only)
    if history.mode == "current":
        return newest(versions, order, only)
    if history.mode == "last":
        rows = last_n(versions, history.value, order)
        return rows if only is None else rows.where(only)
    if history.mode == "at":
        live = (F.col("tx_begin") <= history.value) & (F.col("tx_end").isNull() | (F.col("tx_end") > history.value))
        return newest(versions.where(live), order, only)
    if history.mode == "as_of":
        return newest(versions.where(F.col("updated_at") <= history.value), ["updated_at", *order], only)
    raise EngineError(f"unknown history mode {history.mode!r}")


def version_chains(versions: DataFrame, order: list[str]) -> DataFrame:
    """id, versions (how many rows), head (tx_begin of the newest), tail (of the oldest)."""
    by = F.struct(*order)
    return versions.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("versions"), F.max_by("tx_begin", by).alias("head"), F.min_by("tx_begin", by).alias("tail"))
