"""Structured Streaming into the store, each micro-batch once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from lodeframe.sources.store import Files, Store


def ingest(spark: SparkSession, path: str, schema: T.StructType, store: Store, checkpoint: str, name: str, to_beings: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Reads the parquet files of ``path`` (a folder or a pattern) as they come and appends them as beings, each file once.

    A micro-batch and the note that it was taken are one commit, so a batch that Spark repeats after a failure is
    recognised by its number. The number counts for the checkpoint it belongs to; a stream of the same name with another
    checkpoint looks up the files of each batch in the log instead. Stops when all that is there has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(Files(spark, checkpoint).read("metadata"))["id"]
        last = store.stream(name)
        if last.get("query") == query and number <= last["batch"]:
            return
        files = [r.file for r in batch.select(F.col("_file").alias("file")).distinct().collect()]  # as many as a batch may have
        before = bool(last) and (last["query"] != query or last["before"])
        if before:
            notes = [f"{name}:{f}" for f in files]
            seen = {r.payload for r in store.read("txlog").where((F.col("op") == "StreamFile") & F.col("payload").isin(notes)).select("payload").collect()}
            files = [f for f in files if f"{name}:{f}" not in seen]
        rows = batch.where(F.col("_file").isin(files)).drop("_file") if before else batch.drop("_file")
        store.commit({"beings": to_beings(rows)} if files else {}, [("StreamFile", f"{name}:{f}") for f in files], streams={name: {"query": query, "batch": number, "before": before}})

    stream = spark.readStream.schema(schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """window_start, key, n of a (streaming or static) table: tumbling windows, rows later than ``late`` left out of streams."""
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = marked.groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), key, "n")
