"""The present state of a table from a log of inserts, updates and deletes.

The fold is commutative and associative: per key and field the largest (seq, position of the op, op) wins, whatever the
order in which rows arrive. A delete is kept as such (a tombstone), so an older create that comes later changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.ids import ref_id

#: Fixed values of the log format.
MAGIC = "57414C01"
FIELDS = ("status", "name", "weight", "priority", "category")
PAYLOAD = (
    "struct<tx_id:bigint,ops:array<struct<"
    "CreateBeing:struct<being:struct<core:struct<id:string,status:string,name:string,weight:string,priority:string,category:string>>>,"
    "UpdateBeing:struct<id:string,updates:array<struct<field_name:string,new_value:string>>>,"
    "DeleteBeing:struct<id:string>,"
    "CreateRelation:struct<relation:struct<from_id:string,to_id:string>>>>>"
)


def intact() -> Column:
    """Of a row of the log: magic, length and checksum fit the payload. Null in any of them: not intact."""
    return F.coalesce(
        (F.col("magic") == F.expr(f"X'{MAGIC}'")) & F.col("payload").isNotNull() & (F.octet_length("payload") == F.col("payload_len")) & (F.crc32(F.encode("payload", "UTF-8")) == F.col("crc32")),
        F.lit(False),
    )


def transactions(wal: DataFrame) -> DataFrame:
    """seq, tx_id, ops of the transactions to apply: intact rows, each seq once, each tx_id at its smallest seq.

    A null tx_id names no transaction, so such rows apply by their seq alone. A payload that isn't JSON has no ops.
    """
    rows = wal.where(intact()).where("seq is not null").groupBy("seq").agg(F.min("payload").alias("payload"))
    rows = rows.select("seq", F.from_json("payload", PAYLOAD).alias("p")).select("seq", "p.tx_id", "p.ops")
    named = rows.where("tx_id is not null").groupBy("tx_id").agg(F.min_by("ops", "seq").alias("ops"), F.min("seq").alias("seq"))
    return named.select("seq", "tx_id", "ops").unionByName(rows.where("tx_id is null"))


def events(tx: DataFrame) -> DataFrame:
    """id, seq, pos, kind (create, delete, update), field, value: an update has a row for each field it sets, in order."""
    ops = tx.select("seq", F.posexplode("ops").alias("op_no", "op"))
    pick = F.when(F.col("op.CreateBeing").isNotNull(), "create").when(F.col("op.DeleteBeing").isNotNull(), "delete").when(F.col("op.UpdateBeing").isNotNull(), "update")
    ident = F.coalesce(F.col("op.CreateBeing.being.core.id"), F.col("op.DeleteBeing.id"), F.col("op.UpdateBeing.id"))
    rows = ops.select(ref_id(ident).alias("id"), "seq", "op_no", pick.alias("kind"), "op").where("id is not null and kind is not null")
    created = F.array(*[F.struct(F.lit(f).alias("field"), F.col("op.CreateBeing.being.core").getField(f).alias("value")) for f in FIELDS])
    updated = F.transform(F.col("op.UpdateBeing.updates"), lambda u: F.struct(u["field_name"].alias("field"), u["new_value"].alias("value")))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")))
    sets = F.when(F.col("kind") == "create", created).when(F.col("kind") == "update", updated).otherwise(nothing)
    return rows.select("id", "seq", "op_no", "kind", F.posexplode(sets).alias("set_no", "s")).select("id", "seq", F.struct("seq", "op_no", "set_no").alias("pos"), "kind", "s.field", "s.value")


def fold(ev: DataFrame) -> DataFrame:
    """One row per id with life = (pos, kind) of its last create or delete, and for each field the last (pos, value).

    Everything is a maximum, so partial results of partitions, days or a base table merge in any order; a hot id
    is reduced before the shuffle.
    """
    life = F.max(F.when(F.col("kind").isin("create", "delete"), F.struct("pos", "kind"))).alias("life")
    last = [F.max(F.when(F.col("field") == f, F.struct("pos", "value"))).alias(f) for f in FIELDS]
    return ev.groupBy("id").agg(life, *last)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two results of fold, such as base and increment, as one."""
    return a.unionByName(b).groupBy("id").agg(F.max("life").alias("life"), *[F.max(f).alias(f) for f in FIELDS])


def present(folded: DataFrame) -> DataFrame:
    """The beings that exist in the end, each field with its value and the seq that set it.

    A field last set before the last create belongs to it, since a create sets all fields. Updates of a being
    that was never created, or was deleted last, have no effect.
    """
    return folded.where("life.kind = 'create'").select("id", *[F.struct(F.col(f)["value"].alias("value"), F.col(f)["pos"]["seq"].alias("seq")).alias(f) for f in FIELDS])


def field_origins(wal: DataFrame) -> DataFrame:
    """id, field_name, seq: which record set the present value of each field of each being."""
    state = present(fold(events(transactions(wal))))
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["seq"].alias("seq")) for f in FIELDS])
    return state.select("id", F.inline(pairs))


def present_beings(wal: DataFrame) -> DataFrame:
    """The present table of beings, typed."""
    return typed(present(fold(events(transactions(wal)))))


def typed(state: DataFrame) -> DataFrame:
    """The values of present beings, with their types."""
    return state.select(
        "id", F.col("status.value").try_cast("int").alias("status"), F.col("name.value").alias("name"), F.col("weight.value").try_cast("double").alias("weight"),
        F.col("priority.value").try_cast("int").alias("priority"), F.col("category.value").alias("category"),
    )
