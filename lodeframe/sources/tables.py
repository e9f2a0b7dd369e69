"""Reading the tables of a directory, and scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

from lodeframe.model import EngineError

#: Folders written for each session, by its application id, and the session itself.
_WRITTEN: dict[str, tuple[SparkSession, set[str]]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only in local mode, where that is unset, a temporary one."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not there:
        if not sc.master.startswith("local"):
            raise EngineError("spark.checkpoint.dir must name a folder that all executors share")
        there = os.path.join(tempfile.gettempdir(), "lodeframe-shared")
        os.makedirs(there, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by ``discard`` or at the end of the driver's process."""
    path = f"{shared_dir(spark)}/lodeframe-{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, (spark, set()))[1].add(path)
    return path


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """df written once to the shared folder and read again, which cuts its lineage.

    Every executor can read the files, so the loss of an executor doesn't lose them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, columns: list[str], label: str) -> tuple[DataFrame, str]:
    """df written once in as many buckets of some columns as a shuffle has partitions, and the name of the (temporary) table.

    Joins and groupings on the columns then shuffle the other side only. ``drop`` removes the table.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lodeframe_{label}_{uuid.uuid4().hex}"
    rows = df.repartition(n, *columns)  # one file per bucket
    rows.write.format("parquet").bucketBy(n, *columns).option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name), name


def drop(spark: SparkSession, *names: str) -> None:
    """Drops tables that ``bucketed`` made, with their files."""
    for name in names:
        paths = spark.table(name).inputFiles()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for p in {os.path.dirname(p) for p in paths}:
            _remove(spark, p)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialise`` gave and that nothing reads any more."""
    for df in tables:
        for p in {os.path.dirname(p) for p in df.inputFiles()}:
            _remove(df.sparkSession, p)


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)
    written = _WRITTEN.get(spark.sparkContext.applicationId, (spark, set()))[1]
    written.difference_update({w for w in written if path.endswith(w.removeprefix("file:"))})


@atexit.register
def _remove_all() -> None:
    for spark, paths in _WRITTEN.values():
        for p in list(paths):
            with suppress(Exception):
                _remove(spark, p)
