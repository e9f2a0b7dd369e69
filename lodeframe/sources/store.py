"""A store of parquet files with atomic commits and a transaction log.

A commit writes its files to places of their own and then puts a new manifest beside the old ones by one rename; a
reader sees the files of the latest manifest and nothing else, so a commit that fails half-way leaves no trace. There is
one writer at a time: a second one loses the rename and raises. All paths go through Hadoop's file system, so the
store may lie anywhere Spark can write to.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.model import BEINGS, RELATIONS, TXLOG, VECTORS, InvalidState
from lodeframe.operators.changefeed import PAYLOAD
from lodeframe.sources.tables import materialise

TABLES = {"beings": BEINGS, "relations": RELATIONS, "vectors": VECTORS, "txlog": TXLOG}


#: Folders of a level that become one.
FAN = 16


class Files:
    """The few file operations needed, on any file system."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark._jvm
        self.base = base.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.base).getFileSystem(self.conf)
        self.none = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self._path(name), True))

    def write(self, name: str, text: str) -> bool:
        """Puts a file in place by rename; False if there is one already."""
        tmp, to = self._path(f"{name}.{uuid.uuid4().hex}.tmp"), self._path(name)
        out = self.fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:  # this rename fails if there is a file already
            context.rename(tmp, to, self.none)
        except Py4JJavaError as e:
            self.fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True


class Store:
    """Tables beings, relations, vectors and txlog under one folder; each commit adds a folder of files to some of them.

    A folder has a level; FAN folders of a level become one of the next in the commit that completes them, so a table of n
    commits has some FAN * log(n) folders, a manifest stays small, and a row is rewritten log(n) times at most.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def _manifest(self) -> dict:
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        return json.loads(self.files.read(f"manifests/{names[-1]}")) if names else {"version": 0, "seq": 0, "files": {t: [] for t in TABLES}, "defs": [], "streams": {}}

    def _save(self, new: dict) -> None:
        if not self.files.write(f"manifests/{new['version']:012d}.json", json.dumps(new)):
            raise InvalidState(f"transaction {new['version']} was committed by another writer")

    def commit(self, parts: dict[str, DataFrame], ops: list[tuple[str, str]] = (), defs: list | None = None, streams: dict | None = None) -> int:
        """Writes the rows of ``parts`` and the ops (kind, payload) as one transaction; its number is the result.

        Beings get the transaction's number as tx_begin unless they have one, and an ord after those before. The log row
        carries the CRC-32 of its payload. ``streams`` notes how far streams are, by name.
        """
        old = self._manifest()
        tx = old["version"] + 1
        new = {"version": tx, "seq": old["seq"], "files": {t: list(v) for t, v in old["files"].items()}, "defs": old["defs"] if defs is None else defs, "streams": {**old["streams"], **(streams or {})}}
        for t, df in parts.items():
            schema = TABLES[t]
            rows = df
            if t == "beings":
                rows = rows.withColumn("tx_begin", F.when(F.coalesce("tx_begin", F.lit(0)) > 0, F.col("tx_begin")).otherwise(F.lit(tx)))
            if "ord" in schema.names and "ord" not in rows.columns:
                # unique and rising with each commit; rows of one commit in the order of their partitions
                rows = rows.withColumn("ord", F.lit(tx) * F.lit(1 << 43) + F.monotonically_increasing_id())
            self._add(new, t, rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))
        if ops:
            log = [(old["seq"] + i + 1, tx, kind, payload) for i, (kind, payload) in enumerate(ops)]
            df = self.spark.createDataFrame(log, "seq long, tx_id long, op string, payload string").withColumn("crc32", F.crc32(F.encode("payload", "UTF-8")))
            self._add(new, "txlog", df.coalesce(1))
            new["seq"] += len(log)
        self._save(new)
        return tx

    def _add(self, new: dict, t: str, rows: DataFrame, level: int = 0) -> None:
        name = f"{t}/tx{new['version']:012d}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.files.base}/{name}")
        new["files"][t].append([name, level])
        own = [f for f in new["files"][t] if f[1] == level]
        if len(own) >= FAN:
            new["files"][t] = [f for f in new["files"][t] if f[1] != level]
            self._add(new, t, self._read(t, own), level + 1)

    def _read(self, t: str, files: list) -> DataFrame:
        paths = [f"{self.files.base}/{p}" for p, _ in files]
        return self.spark.read.schema(TABLES[t]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[t])

    def read(self, table: str) -> DataFrame:
        return self._read(table, self._manifest()["files"][table])

    def defs(self) -> list:
        return self._manifest()["defs"]

    def stream(self, name: str) -> dict:
        """What a stream noted with its last commit; empty for one that is new."""
        return self._manifest()["streams"].get(name, {})

    def compact(self, table: str, partitions: int, by: str) -> None:
        """Rewrites a table in one go, sorted by a column within its files, so that lookups skip most files and row groups."""
        old = self._manifest()
        files = old["files"][table]
        if files:
            new = {**old, "version": old["version"] + 1, "files": {**old["files"], table: []}}
            rows = self._read(table, files).repartitionByRange(partitions, by).sortWithinPartitions(by)
            self._add(new, table, rows, max(level for _, level in files) + 1)
            self._save(new)

    def vacuum(self) -> int:
        """Deletes folders and manifests that the latest manifest no longer needs; how many. No reader may be at older ones."""
        m, n = self._manifest(), 0
        for t in TABLES:
            kept = {p.split("/")[1] for p, _ in m["files"][t]}
            for name in self.files.names(t):
                if name not in kept:
                    n += self.files.delete(f"{t}/{name}")
        for name in self.files.names("manifests"):
            if name.endswith(".json") and int(name.split(".")[0]) < m["version"]:
                n += self.files.delete(f"manifests/{name}")
        return n


class DocumentLog:
    """An append-only store of raw documents: being_id, def, stamp, core, ext; find and scan see all that was appended."""

    SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("being_id", T.StringType()), ("def", T.StringType()), ("stamp", T.LongType()), ("core", T.StringType()), ("ext", T.StringType()))])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        """Sorted by being within each file and with a Bloom filter of the beings, so that find skips row groups."""
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.SCHEMA]).sortWithinPartitions("being_id").write.mode("append")
        out.option("compression", "lz4_raw").option("parquet.bloom.filter.enabled#being_id", "true").parquet(self.path)

    def scan(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def find(self, being_id: str) -> DataFrame:
        return self.scan().where(F.col("being_id") == being_id)

    def count(self) -> int:
        return self.scan().count()


def replayable(log: DataFrame, good, arrival: str = "seq") -> DataFrame:
    """The records before the first bad one in order of arrival; a recovery sorts them by seq.

    ``good`` is a condition; null counts as bad. The first bad record is a minimum, one value.
    """
    bad = log.where(~F.coalesce(good, F.lit(False))).agg(F.min(arrival)).first()[0]
    return log if bad is None else log.where(F.col(arrival) < F.lit(bad))


def replay(records: DataFrame) -> DataFrame:
    """pos, seq, tx_id, ops: the payloads of recovered records in the order of seq (then of arrival), from 1.

    A payload that can't be decoded is left out. The order is a sort over ranges of seq; the numbers follow from the sizes of
    the ranges, so no task sees all records.
    """
    spark = records.sparkSession
    rows = records.select("seq", "rec_no", F.from_json("payload", PAYLOAD).alias("p")).where("p is not null")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(rows.repartitionByRange(n, "seq", "rec_no").withColumn("_p", F.spark_partition_id()), "replay")
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))  # a row per range
    pos = F.row_number().over(Window.partitionBy("_p").orderBy("seq", "rec_no")) + F.col("_before")
    return rows.join(F.broadcast(before), "_p").select(pos.cast("int").alias("pos"), "seq", "p.tx_id", "p.ops")
