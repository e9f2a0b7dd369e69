"""Percentiles with a bounded relative error of rank, from sketches that merge.

A sketch is a stack of relative compactors. Level h holds values that stand for 2 ** h values each. When a level is full it
is sorted, its largest values stay (they are the protected tail), and of a part of the rest every other value goes up
one level; how large a part depends on how often the level was compacted (its trailing ones, in sections of K), so
that values near the tail are compacted rarely. The error of a rank is then in proportion to the number of values
above it: small for the 99th percentile. Sketches of partitions or days are merged level by level.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.ids import referred_id, refers
from lodeframe.sources.tables import materialise

#: Size of a section; the error of a rank is about 1 / K of the number of values above it, or less.
K = 128
SECTIONS = 6
PERCENTS = (50, 90, 99)
KEYS = ("name", "def")


class Sketch:
    """Values with relative error of rank at the upper end. Exact up to 2 * K * SECTIONS values."""

    def __init__(self) -> None:
        self.n = 0
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.turns = [0]

    def add(self, values: np.ndarray) -> Sketch:
        """Finite and infinite numbers; NaN must have been left out."""
        step = 64 * K * SECTIONS
        for at in range(0, len(values), step):
            part = values[at : at + step]
            self.n += len(part)
            self.levels[0] = np.concatenate([self.levels[0], part])
            self._compact()
        return self

    def merge(self, other: Sketch) -> Sketch:
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
            self.turns.append(0)
        for h, v in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], v])
            self.turns[h] |= other.turns[h]
        self.n += other.n
        self._compact()
        return self

    def _capacity(self, h: int) -> int:
        # a section more for each doubling of what the level may have to take, as the relative error asks for
        return 2 * K * max(SECTIONS, math.ceil(math.log2(max(2, self.n / (K << h)))))

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) > (room := self._capacity(h)):
                v = np.sort(self.levels[h])
                turn = self.turns[h]
                ones = (~turn & (turn + 1)).bit_length()  # 1 + the trailing ones of the number of compactions
                keep = max(room // 2, room - K * ones)
                low = max(2, (len(v) - keep) // 2 * 2)
                up = v[:low][turn & 1 :: 2]
                self.levels[h] = v[low:]
                self.turns[h] += 1
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                    self.turns.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], up])
            h += 1

    def quantiles(self, percents: tuple[int, ...] = PERCENTS) -> list[float]:
        """For each percent the value of rank ceil(percent * n / 100), from 1; exact while nothing was compacted."""
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        v, above = v[order], np.cumsum(w[order][::-1])[::-1]  # weight at or above each value
        out = []
        for p in percents:
            rank = -(-p * self.n // 100)
            want = self.n - max(1, rank) + 1  # values at or above the one asked for
            at = int(np.searchsorted(-above, -want, side="right")) - 1
            out.append(float(v[min(max(at, 0), len(v) - 1)]))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<qq", self.n, len(self.levels)) + b"".join(struct.pack("<qq", t, len(v)) for t, v in zip(self.turns, self.levels))
        return head + np.concatenate(self.levels).astype("<f8").tobytes()

    @staticmethod
    def from_bytes(b: bytes) -> Sketch:
        s = Sketch()
        s.n, k = struct.unpack_from("<qq", b)
        heads = [struct.unpack_from("<qq", b, 16 + 16 * i) for i in range(k)]
        at = 16 + 16 * k
        s.turns = [t for t, _ in heads]
        s.levels = []
        for _, size in heads:
            s.levels.append(np.frombuffer(b, dtype="<f8", count=size, offset=at).copy())
            at += 8 * size
        return s


#: Sketches that a task keeps open at a time, numbers in them, and partial sketches of a group that meet at once, about.
OPEN, HELD, FAN_IN = 100_000, 8_000_000, 256
#: Repeated chunk numbers that are broadcast, some 150 bytes each.
AGAIN = 100_000


def _once(chunks: DataFrame) -> DataFrame:
    """Each chunk_no once; rows with a null chunk_no can't be told to repeat, so all count.

    Which rows repeat is found out by chunk_no and place in the files alone. Chunks that come once aren't moved; of those that come again the one
    at the first place stays, by a broadcast of at most AGAIN numbers, or an ordinary join if there are more.
    """
    try:
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        chunks.select(place)
    except AnalysisException:  # not from files
        return chunks.where("chunk_no is not null").dropDuplicates(["chunk_no"]).unionByName(chunks.where("chunk_no is null"))
    numbered = chunks.select("chunk_no", "name", "day", "being_ids", "values", place.alias("_place"))
    again = numbered.where("chunk_no is not null").groupBy("chunk_no").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    again = materialise(again.where("_n > 1").select("chunk_no", "_first"), "again")
    if again.count() <= AGAIN:
        again = F.broadcast(again)
    return numbered.join(again, "chunk_no", "left").where("_first is null or _first = _place")


def values_of(chunks: DataFrame, beings: DataFrame) -> DataFrame:
    """name, def, day, value: each chunk once, its values with the def of their being.

    Null and NaN values are left out, and values of ids without a being or whose being has no def; infinite ones count. A
    position without a partner in the other array has no value or no being. A null chunk_no can't be told to repeat, so
    such rows all count. A being's def is that of its row with the latest updated_at that has one (ties: the larger def).
    """
    pairs = _once(chunks).select("name", "day", F.inline(F.arrays_zip(F.col("being_ids").alias("being"), F.col("values").alias("value"))))
    rows = pairs.toDF("name", "day", "being", "value").where("value is not null and not isnan(value)").where(refers("being")).select("name", "day", referred_id("being").alias("id"), "value")
    last = F.max(F.struct(F.coalesce("updated_at", F.lit(-(2**63))).alias("u"), "def"))
    defs = beings.where("def is not null").where(refers("id")).select(referred_id("id").alias("id"), "updated_at", "def").groupBy("id").agg(last["def"].alias("def"))
    return rows.join(defs, "id").select("name", "def", "day", "value")


def day_sketches(values: DataFrame) -> DataFrame:
    """name, def, day, sketch, n: one sketch per group and day, built in the partitions and then merged.

    What is shuffled are partial sketches, so a group with most of the values is spread over all tasks.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, Sketch] = {}
        held = 0  # at most so many numbers

        def done() -> pa.RecordBatch:
            keys = list(open_)
            cols = [pa.array([k[c] for k in keys], type=t) for c, t in enumerate((pa.string(), pa.string(), pa.date32()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([s.to_bytes() for s in open_.values()], type=pa.binary())], names=["name", "def", "day", "sketch"])

        for batch in batches:
            if held > HELD:
                held = sum(len(v) for s in open_.values() for v in s.levels)
            if len(open_) > OPEN or held > HELD / 2:
                yield done()
                open_.clear()
                held = 0
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            names = []
            for c in range(3):
                d = batch.column(c).dictionary_encode(null_encoding="encode")
                names.append(d.dictionary.to_pylist())
                codes = codes * (len(names[-1]) + 1) + d.indices.to_numpy()
            v = batch.column(3).to_numpy()
            order = np.argsort(codes, kind="stable")
            codes, v = codes[order], v[order]
            at = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
            for a, b in zip(at, [*at[1:], len(v)]):
                k, key = int(codes[a]), []
                for dic in reversed(names):
                    key.append(dic[k % (len(dic) + 1)])
                    k //= len(dic) + 1
                open_.setdefault(tuple(reversed(key)), Sketch()).add(v[a:b])
            held += len(v)
        if open_:
            yield done()

    partial = values.mapInArrow(build, "name string, def string, day date, sketch binary")
    keys = ["name", "def", "day"]
    tasks = values.sparkSession.sparkContext.defaultParallelism
    slices = tasks // FAN_IN  # with very many tasks the partial sketches of a group meet in slices first
    if slices > 1:
        partial = merge_sketches(partial.withColumn("slice", F.pmod(F.xxhash64("sketch"), F.lit(slices))), [*keys, "slice"])
    return merge_sketches(partial, keys)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One merged sketch per ``keys``; n is the number of values in it."""
    kinds = {"name": "string", "def": "string", "day": "date", "slice": "bigint"}
    names = [*keys, "sketch", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for pdf in batches:
            done = []
            for *k, b in zip(*[pdf[c].tolist() for c in keys], pdf["sketch"]):
                if k != key:
                    if total is not None:
                        done.append((*key, total.to_bytes(), total.n))
                    key, total = k, Sketch()
                total.merge(Sketch.from_bytes(bytes(b)))
            yield pd.DataFrame(done, columns=names)
        if total is not None:
            yield pd.DataFrame([(*key, total.to_bytes(), total.n)], columns=names)

    # sorted by the sketches too, so the result doesn't depend on the order of arrival
    together = sketches.select(*keys, "sketch").repartition(*keys).sortWithinPartitions(*keys, "sketch")
    return together.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sketch binary, n bigint")


def percentiles(sketches: DataFrame) -> DataFrame:
    """name, def, n, p50, p90, p99 over all days of the daily sketches. No values, no row."""
    total = merge_sketches(sketches, list(KEYS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = [Sketch.from_bytes(bytes(b)).quantiles() for b in pdf["sketch"]]
            out = pdf[["name", "def", "n"]].copy()
            for i, p in enumerate(PERCENTS):
                out[f"p{p}"] = [x[i] for x in q]
            yield out

    return total.mapInPandas(run, "name string, def string, n bigint, p50 double, p90 double, p99 double")
