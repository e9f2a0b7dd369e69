"""Streaming into the store: each micro-batch once; windows with late rows."""

import datetime as dt

from pyspark.sql import functions as F

from lodeframe.sources import store as store_module
from lodeframe.sources.store import Store
from lodeframe.streaming.ingest import ingest, windowed_counts

SCHEMA = "id string, ts timestamp, kind string, v double"


def to_beings(b):
    zero = {"status": 0, "code": "", "description": "", "priority": 0, "created_at": 0, "updated_at": 0, "tx_begin": 0, "tx_end": None, "ext": None}
    out = b.select("id", F.lit("Event").alias("def"), F.col("kind").alias("name"), F.col("v").alias("weight"), F.col("kind").alias("category"))
    return out.withColumns({k: F.lit(v) for k, v in zero.items()})


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    src, store = str(tmp_path / "src"), Store(spark, str(tmp_path / "store"))
    rows = [(f"e{i}", dt.datetime(2025, 1, 1, i), "a" if i % 2 else "b", float(i)) for i in range(6)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(src)
    schema = spark.read.parquet(src).schema
    ingest(spark, src, schema, store, str(tmp_path / "c1"), "events", to_beings).awaitTermination()
    assert store.read("beings").count() == 6
    # the same stream from its start once more, as after the loss of its checkpoint
    ingest(spark, src, schema, store, str(tmp_path / "c2"), "events", to_beings).awaitTermination()
    assert store.read("beings").count() == 6
    spark.createDataFrame([("e9", dt.datetime(2025, 1, 2), "a", 1.0)], SCHEMA).write.mode("append").parquet(src)
    ingest(spark, src, schema, store, str(tmp_path / "c1"), "events", to_beings).awaitTermination()
    assert store.read("beings").count() == 7
    assert store.read("beings").agg(F.count_distinct("ord")).first()[0] == 7


def test_windows(spark, tmp_path):
    rows = [("a", dt.datetime(2025, 1, 1, 1), "x", 1.0), ("b", dt.datetime(2025, 1, 1, 23), "x", 1.0), ("c", dt.datetime(2025, 1, 2, 0), "y", 1.0), ("d", None, "y", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.window_start.day, r.kind): r.n for r in windowed_counts(df, "ts", "kind").collect()}
    assert got == {(1, "x"): 2, (2, "y"): 1}
    src = str(tmp_path / "w")
    df.write.parquet(src)
    q = windowed_counts(spark.readStream.schema(df.schema).parquet(src), "ts", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").count() == 2


def test_new_files_under_a_new_checkpoint_are_taken(spark, tmp_path):
    src, store = str(tmp_path / "src"), Store(spark, str(tmp_path / "store"))
    one = lambda i: spark.createDataFrame([(f"e{i}", dt.datetime(2025, 1, 1), "a", 1.0)], SCHEMA)
    one(1).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    ingest(spark, src, schema, store, str(tmp_path / "c1"), "events", to_beings).awaitTermination()
    one(2).coalesce(1).write.mode("append").parquet(src)
    for c in ("c2", "c2", "c1"):
        ingest(spark, src, schema, store, str(tmp_path / c), "events", to_beings).awaitTermination()
        assert sorted(r.id for r in store.read("beings").collect()) == ["e1", "e2"]


def test_many_commits_leave_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FAN", 3)
    store = Store(spark, str(tmp_path / "store"))
    rows = to_beings(spark.createDataFrame([("x", None, "a", 1.0)], SCHEMA))
    for _ in range(10):
        store.commit({"beings": rows}, [("Note", "n")])
    assert store.read("beings").count() == 10 and store.read("txlog").agg(F.max("seq")).first()[0] == 10
    assert len(store._manifest()["files"]["beings"]) == 2 and store.read("beings").agg(F.count_distinct("ord")).first()[0] == 10
    assert store.vacuum() > 0 and store.read("beings").count() == 10
    store.compact("beings", 2, "id")
    assert store.read("beings").count() == 10
