"""References to records that don't exist, by AND-NOT of bitmaps.

Every id gets an integer code (range, position): the range is a hash of the id, the position its rank among the ids of
that range. References set bits in words of 64 positions per range and month; beings set bits of birth and death.
``references AND NOT alive`` leaves the (id, month) pairs that hold at least one orphan or lie in the month of a birth or
death; these few are decoded and their rows checked to the nanosecond. Words without bits aren't stored, which
keeps the bitmaps as small as what they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.ids import month_of_ns, norm_id, ref_id

#: Ids per range, at most this many on average; a range is ranked in one task.
RANGE_IDS = 4096
NO_MONTH = -1


def parents(beings: DataFrame, defs: DataFrame) -> DataFrame:
    """id, born_at (smallest created_at), ended_at (updated_at of the latest row if that has a tx_end).

    A definition is a being that doesn't end. Rows without an id are nothing. A null created_at never is later than
    a reference, a null updated_at is before any other. Of rows with the same updated_at the one with a tx_end counts.
    """
    b = beings.select(ref_id("id").alias("id"), "created_at", F.struct(F.coalesce("updated_at", F.lit(-(2**63))).alias("u"), F.col("tx_end").isNotNull().alias("ended")).alias("last"))
    d = defs.select(ref_id("id").alias("id"), "created_at", F.struct(F.lit(-(2**63)).alias("u"), F.lit(False).alias("ended")).alias("last"))
    both = b.unionByName(d).where("id is not null").groupBy("id").agg(F.min("created_at").alias("born_at"), F.max("last").alias("last"))
    return both.select("id", "born_at", F.when(F.col("last.ended") & (F.col("last.u") > -(2**63)), F.col("last.u")).alias("ended_at"))


def references(relations: DataFrame) -> DataFrame:
    """ord, side, id, created_at, month of each reference that refers to something."""
    month = F.coalesce(month_of_ns(F.col("created_at")), F.lit(NO_MONTH)).cast("int")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), ref_id(s).alias("id")) for s in ("from_id", "to_id")])
    return relations.select("ord", "created_at", month.alias("month"), F.inline(sides)).where("id is not null")


def _bit(pos: Column) -> Column:
    return F.expr("shiftleft(1L, cast(pos % 64 as int))")


def orphan_references(relations: DataFrame, beings: DataFrame, defs: DataFrame) -> DataFrame:
    """ord, side, reason, month (of the relation's created_at) of every orphan reference.

    reason: missing, late or deleted as in the problem's statement; where both late and deleted hold, a row for each.
    A relation with a null created_at can only be missing. Empty tables give no rows, or all missing.
    """
    refs = references(relations)
    par = parents(beings, defs)
    pairs = refs.groupBy("id", "month").agg(F.lit(True).alias("r"))
    used = par.select("id", F.lit(None).cast("int").alias("month"), "born_at", "ended_at", F.lit(True).alias("is_parent"))
    used = pairs.select("id", "month", F.lit(None).cast("long").alias("born_at"), F.lit(None).cast("long").alias("ended_at"), F.lit(False).alias("is_parent")).unionByName(used)
    # the dictionary: one entry per distinct id, with the months in which it is referred to
    dictionary = used.groupBy("id").agg(F.collect_set("month").alias("months"), F.max("born_at").alias("born_at"), F.max("ended_at").alias("ended_at"), F.max("is_parent").alias("is_parent"))
    most = 2 * relations.count() + beings.count() + defs.count()  # of parquet files from their footers
    n_ranges = most // RANGE_IDS + 1
    coded = dictionary.withColumn("range", F.pmod(F.xxhash64("id"), F.lit(n_ranges)).cast("int"))
    coded = coded.withColumn("pos", F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1).withColumn("word", F.floor(F.col("pos") / 64).cast("int"))
    # bitmaps of a range: references by month, births and deaths by month (a parent's bit is set once in each)
    born = F.when(F.col("is_parent"), F.coalesce(month_of_ns(F.col("born_at")), F.lit(-2)))
    dead = F.when(F.col("is_parent"), month_of_ns(F.col("ended_at")))
    one = F.struct
    marks = F.concat(
        F.transform("months", lambda m: one(F.lit("r").alias("kind"), m.alias("month"))),
        F.when(born.isNotNull(), F.array(one(F.lit("b").alias("kind"), born.cast("int").alias("month")))).otherwise(F.array().cast("array<struct<kind:string,month:int>>")),
        F.when(dead.isNotNull(), F.array(one(F.lit("d").alias("kind"), dead.cast("int").alias("month")))).otherwise(F.array().cast("array<struct<kind:string,month:int>>")),
    )
    bits = coded.select("range", "word", "pos", F.inline(marks)).groupBy("range", "word", "kind", "month").agg(F.bit_or(_bit(F.col("pos"))).alias("bits"))
    words = bits.groupBy("range", "word").agg(F.collect_list(F.struct("kind", "month", "bits")).alias("maps"))  # at most 64 births and deaths, and the months
    left = words.select("range", "word", F.inline(_survivors(F.col("maps")))).where("bits <> 0")
    # decode: the positions of the bits that are left, and their ids
    where = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    codes = left.select("range", "month", F.explode(F.transform(where, lambda i: i + F.col("word") * 64)).alias("pos"))
    found = codes.join(coded.select("range", "pos", "id", "born_at", "ended_at", "is_parent"), ["range", "pos"]).select("id", "month", "born_at", "ended_at", "is_parent")
    rows = refs.join(found, ["id", "month"])
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("is_parent"), F.lit("missing")),
            F.when(F.col("created_at") < F.col("born_at"), F.lit("late")),
            F.when(F.col("created_at") > F.col("ended_at"), F.lit("deleted")),
        )
    )
    return rows.select("ord", "side", F.explode(reasons).alias("reason"), "month")


def _survivors(maps: Column) -> Column:
    """Of the bitmaps of one word: references by month AND NOT the beings that lived through that month."""

    def ored(kind: str, keep) -> Column:
        return F.aggregate(F.filter(maps, lambda m: (m["kind"] == kind) & keep(m["month"])), F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m["bits"]))

    refs = F.filter(maps, lambda m: m["kind"] == "r")
    return F.transform(
        refs,
        lambda r: F.struct(
            r["month"].alias("month"),
            r["bits"].bitwiseAND(
                F.bitwise_not(
                    F.when(r["month"] == NO_MONTH, ored("b", lambda m: F.lit(True))).otherwise(ored("b", lambda m: m < r["month"]).bitwiseAND(F.bitwise_not(ored("d", lambda m: m <= r["month"]))))
                )
            ).alias("bits"),
        ),
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """side, reason, month (yyyy-MM, null without created_at), n."""
    y, m = F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int")
    name = F.when(F.col("month") >= 0, F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0")))
    return orphans.groupBy("side", "reason", name.alias("month")).agg(F.count(F.lit(1)).alias("n"))
