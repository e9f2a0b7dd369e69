"""Runs that take only what no earlier successful run took.

``BatchLedger``: the plan of a batch (offsets from and to, per source partition) is written ahead, replayed as written
after a failure, and the sink keeps one row per partition, key and offset. ``run_windows`` folds a run log into the
offsets each successful run committed, and ``runs_of_records`` puts whole tables through a ledger that is cut there.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.ids import micros, norm_id
from lodeframe.model import InvalidState
from lodeframe.operators.changefeed import intact
from lodeframe.sources.store import Files


def run_windows(run_log: DataFrame, source_table: str) -> tuple[list[tuple[int, object]], int]:
    """([(run_no, read_upto)], next run) of one source: its successful runs that read further than all before.

    How a run ended is what its event with the latest logged_at says (ties: the larger log_no), case and blanks
    aside. Runs that end otherwise, or without an end, took nothing. A successful run with a null read_upto took
    nothing. The log holds one row per event of a run; its size doesn't depend on the data, and only
    one row per run reaches the driver. Without any run the next is run 1.
    """
    own = run_log.where(F.lower(F.trim("source_table")) == source_table)
    last = own.groupBy("run_no").agg(
        F.max_by(F.struct(F.lower(F.btrim("event", F.lit(" \t\r\n"))).alias("event"), F.col("read_upto")), F.struct("logged_at", "log_no")).alias("e")
    )
    rows = last.where("run_no is not null").select("run_no", "e.event", "e.read_upto").collect()
    best, out = None, []
    for r in sorted(rows, key=lambda r: r.run_no):
        if r.event == "succeeded" and r.read_upto is not None and (best is None or r.read_upto > best):
            best = r.read_upto
            out.append((r.run_no, best))
    return out, max([r.run_no for r in rows], default=0) + 1


def records_of_beings(beings: DataFrame) -> DataFrame:
    """A record is a distinct (id, updated_at); rows without an id are no record."""
    return beings.select(norm_id("id").alias("rec_id"), F.col("updated_at").cast("long").alias("rec_version"), "arrived_at").where("rec_id <> ''")


def records_of_wal(wal: DataFrame) -> DataFrame:
    """A record is a distinct seq of an intact row."""
    ok = wal.where(intact()).where("seq is not null")
    return ok.select(F.col("seq").cast("string").alias("rec_id"), F.col("seq").cast("long").alias("rec_version"), "arrived_at")


class BatchLedger:
    """Batches over an append-only source with an offset per partition.

    plan() writes the offsets of the next batch ahead of any work and returns the unfinished plan if there is one, so
    a batch that failed is repeated over exactly the same offsets. commit() marks it done. sink() leaves one row per
    partition, key and offset, so a repeated batch adds nothing. The ledger's files are small JSON files in a
    folder all nodes share, on any file system Spark can write to; a file is put in place by an exclusive rename, so a driver
    that starts elsewhere finds the plan.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def _read(self, batch: int) -> dict:
        return json.loads(self.files.read(f"{batch:010d}.plan.json"))

    def plan(self, latest: dict[str, int], cuts: dict[str, list[tuple[int, int]]] | None = None) -> dict:
        """The batch to run now: {"batch", "from", "to", "cuts"}; offsets are exclusive below and inclusive above.

        cuts divides a partition's offsets into parts, [(label, last offset)] in rising order.
        """
        names = self.files.names(".")
        last = max([int(x.split(".")[0]) for x in names if x.endswith(".plan.json")], default=-1)
        if last >= 0 and f"{last:010d}.done.json" not in names:
            return self._read(last)
        start = self._read(last)["to"] if last >= 0 else {}
        plan = {"batch": last + 1, "from": start, "to": {**start, **{k: max(v, start.get(k, v)) for k, v in latest.items()}}, "cuts": cuts or {}}
        if not self.files.write(f"{last + 1:010d}.plan.json", json.dumps(plan)):
            raise InvalidState(f"batch {last + 1} was planned by another run")
        return self._read(last + 1)

    def commit(self, plan: dict) -> None:
        self.files.write(f"{plan['batch']:010d}.done.json", json.dumps({"batch": plan["batch"]}))

    def read(self, source: DataFrame, plan: dict, partition: str, offset: str) -> DataFrame:
        """The rows of the plan, with ``part``, the label of their cut (null without any); rows with a null offset or partition
        are in no batch.

        A broadcast join with the plan's spans of offsets, of which there is one per partition and cut. Spans are listed by
        cell, a 256th of all offsets, so that a row meets few of them.
        """
        spans = []
        for p, upto in plan["to"].items():
            after = plan["from"].get(p)
            for label, last in [*plan["cuts"].get(p, []), (None, upto)]:
                last = min(last, upto)
                if after is None or last > after:
                    spans.append((p, label, after, last))
                    after = last
        ends = [s[3] for s in spans] or [0]
        low, high = min(ends), max(ends)
        width = max(1, -(-(high - low) // 256))
        cell = lambda x: 0 if x is None or x < low else (min(x, high) - low) // width
        listed = [(*s, k) for s in spans for k in range(cell(s[2]), cell(s[3]) + 1)]
        spans = F.broadcast(self.spark.createDataFrame(listed, "_p string, part long, _after long, _upto long, _cell long"))
        x = F.col(offset)
        own = F.call_function("div", F.greatest(F.least(x, F.lit(high)), F.lit(low)) - F.lit(low), F.lit(width))
        same = (F.col(partition) == F.col("_p")) & (own == F.col("_cell")) & (x <= F.col("_upto")) & (F.col("_after").isNull() | (x > F.col("_after")))
        return source.join(spans, same).drop("_p", "_after", "_upto", "_cell")

    @staticmethod
    def sink(rows: DataFrame, key: str | list[str], offset: str, written: DataFrame | None, partition: str | None = None) -> DataFrame:
        """rows that aren't in ``written`` yet, each (partition, key, offset) once; nulls are alike.

        Without ``partition``, offsets of all partitions are one sequence.
        """
        own = [*([key] if isinstance(key, str) else key), *([partition] if partition else []), offset]
        rows = rows.dropDuplicates(own)
        if written is None:
            return rows
        there = written.select(*(F.col(c).alias(f"_written_{c}") for c in own))
        same = [F.col(c).eqNullSafe(F.col(f"_written_{c}")) for c in own]
        return rows.join(there, reduce(Column.__and__, same), "left_anti")


KEY = ["rec_id", "rec_version"]
#: A later sink's files hold these columns.
SUNK = "rec_id string, rec_version bigint, source_table string, at bigint, part bigint, batch bigint"


def first_arrivals(records: DataFrame, name: str, last: int) -> DataFrame:
    """source_table, rec_id, rec_version, at: each record with its first arrival in microseconds, the offset in the log.

    Records that never say when they arrived come last, at offset ``last``.
    """
    first = records.groupBy(*KEY).agg(F.min("arrived_at").alias("_t"))
    return first.select(*KEY, F.lit(name).alias("source_table"), F.coalesce(micros(F.col("_t")), F.lit(last)).alias("at"))


def _micros(t: datetime) -> int:
    return (t.replace(tzinfo=None) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def _batch(ledger: BatchLedger, log: DataFrame, plan: dict, path: str, only: Column | None = None) -> None:
    """The rows of a plan into the sink at ``path``, without those that are there; ``only`` some of them, as if it failed midway."""
    there = ledger.spark.read.schema(SUNK).parquet(path) if Files(ledger.spark, path).names(".") else None
    rows = ledger.read(log, plan, "source_table", "at").withColumn("batch", F.lit(plan["batch"]).cast("long"))
    rows = ledger.sink(rows, KEY, "at", there, "source_table")
    (rows if only is None else rows.where(only)).write.mode("append").parquet(path)


def runs_of_records(run_log: DataFrame, sources: dict[str, tuple[DataFrame, DataFrame]], path: str) -> DataFrame:
    """source_table, run_no, rec_id, rec_version: which run takes which record, put through a ledger at ``path``.

    sources: a table and its records (rec_id, rec_version, arrived_at) by name. A source is a partition of the log, and the time
    of arrival its offset, so late records are new ones. What each successful run took is a cut of the plan, and the rest
    is the next run's; so the plan, written ahead, covers all runs, and the log is read once. Called again at the same path after a
    failure, it replays the plan and adds what is missing.
    """
    spark = run_log.sparkSession
    for name, (table, records) in sources.items():
        windows, following = run_windows(run_log, name)
        cuts = [(run, _micros(t)) for run, t in windows]
        newest = table.agg(F.max(micros(F.col("arrived_at")))).first()[0]
        last = max([t for _, t in cuts] + ([newest] if newest is not None else []), default=0) + 1
        ledger = BatchLedger(spark, f"{path}/{name}")
        plan = ledger.plan({name: last}, {name: [*cuts, (following, last)]})
        _batch(ledger, first_arrivals(records, name, plan["to"][name]), plan, f"{path}/{name}/rows")
        ledger.commit(plan)
    rows = [spark.read.schema(SUNK).parquet(f"{path}/{name}/rows") for name in sources]
    return reduce(DataFrame.unionByName, rows).select("source_table", F.col("part").alias("run_no"), *KEY)


def replayed(run_log: DataFrame, sources: dict[str, tuple[DataFrame, DataFrame]], path: str) -> DataFrame:
    """source_table, batch, rec_id, rec_version of all records, put through a ledger at ``path`` in two batches.

    Batch 0 ends where the last successful run did; it fails when half of its records are written, and its plan is replayed.
    Batch 1 takes what is left.
    """
    spark = run_log.sparkSession
    for name, (table, records) in sources.items():
        windows, _ = run_windows(run_log, name)
        ends = {name: _micros(windows[-1][1])} if windows else {}
        newest = table.agg(F.max(micros(F.col("arrived_at")))).first()[0]
        last = max([*ends.values()] + ([newest] if newest is not None else []), default=0) + 1
        log, rows, place = first_arrivals(records, name, last), f"{path}/{name}/rows", f"{path}/{name}"
        ledger = BatchLedger(spark, place)
        _batch(ledger, log, ledger.plan(ends), rows, F.pmod(F.xxhash64(*KEY), F.lit(2)) == 0)  # and here it fails
        for _ in range(2):
            ledger = BatchLedger(spark, place)
            plan = ledger.plan({name: last})
            _batch(ledger, log, plan, rows)
            ledger.commit(plan)
    rows = [spark.read.schema(SUNK).parquet(f"{path}/{name}/rows") for name in sources]
    return reduce(DataFrame.unionByName, rows).select("source_table", "batch", *KEY)
