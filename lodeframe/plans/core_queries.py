"""Queries of the general problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators import changefeed, history, incremental, orphans, skew
from lodeframe.sources.tables import scratch_path, table

EDGES = ("relations", "edge_records")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """table_name, from_id that hold at least 2 % of all rows of their table."""
    a, b = (skew.heavy_from_ids(table(spark, d, t), t) for t in EDGES)
    return a.unionByName(b)


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, sum of weight and latest created_at of every from_id of both tables."""
    a, b = (skew.from_id_totals(table(spark, d, t)).select(F.lit(t).alias("table_name"), "*") for t in EDGES)
    return a.unionByName(b)


def _sources(spark: SparkSession, d: str, *names: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    of = {"beings": incremental.records_of_beings, "wal_records": incremental.records_of_wal}
    return {n: (table(spark, d, n), of[n](table(spark, d, n))) for n in names}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Which run has to process which record, for beings and wal_records, by way of a ledger."""
    return incremental.runs_of_records(table(spark, d, "run_log"), _sources(spark, d, "beings", "wal_records"), scratch_path(spark, "ledger"))


def p3_beings(spark: SparkSession, d: str) -> DataFrame:
    """The same for beings alone."""
    return incremental.runs_of_records(table(spark, d, "run_log"), _sources(spark, d, "beings"), scratch_path(spark, "ledger"))


def p3_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The batch of a ledger that took each record of both tables; the first batch fails halfway and is replayed."""
    return incremental.replayed(table(spark, d, "run_log"), _sources(spark, d, "beings", "wal_records"), scratch_path(spark, "ledger"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The periods of each being."""
    return history.periods(table(spark, d, "version_nodes")).drop("attrs")


def p4_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every capture with valid and recorded times; superseded_at is -1 while it is believed."""
    believed = F.coalesce("superseded_at", F.lit(-1).cast("long")).alias("superseded_at")
    return history.ledger(table(spark, d, "version_nodes")).select("being_id", "tx_begin", "tx_end", "recorded_at", believed, "node_no", "attrs.name", "attrs.code", "attrs.weight", "attrs.category")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*(table(spark, d, t) for t in ("relations", "beings", "defs")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references with side and reason."""
    return _orphans(spark, d).drop("month")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per side, reason and month."""
    return orphans.orphan_report(_orphans(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The record that set the present value of each field of each being."""
    return changefeed.field_origins(table(spark, d, "wal_records"))


def p6_beings(spark: SparkSession, d: str) -> DataFrame:
    """The present table of beings after the whole log (whole numbers as doubles, as they may be null)."""
    state = changefeed.present_beings(table(spark, d, "wal_records"))
    return state.withColumns({c: F.col(c).cast("double") for c in ("status", "priority")})


def p6_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same from a base and increments, folded apart and merged, the base last."""
    tx = changefeed.transactions(table(spark, d, "wal_records"))
    last, *rest = [changefeed.fold(changefeed.events(tx.where(F.pmod("seq", F.lit(3)) == k))) for k in range(3)]
    for part in rest:
        last = changefeed.merge(last, part)
    state = changefeed.typed(changefeed.present(last))
    return state.withColumns({c: F.col(c).cast("double") for c in ("status", "priority")})


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p1_found, p1_totals, p3_found, p3_beings, p3_replayed, p4_found, p4_ledger, p5_found, p5_report, p6_found, p6_beings, p6_merged)
    return {f.__name__: f for f in fs}
