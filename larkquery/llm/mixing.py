"""Mixing sources to target weights by Pfair scheduling, DataFrame functions only.

Each class of sources has an integer share; with D the sum of shares, its weight is share / D.  A class's documents
are dealt into blocks in a fixed pseudo-random order.  Block i of a class with weight w is released at slot
floor(i / w) and due by slot ceil((i + 1) / w); the earliest deadline among released blocks takes each slot.  As
the weights sum to one, every deadline is met and every class stays within one block of its target at every slot.
The schedule repeats after D slots, so one period of D slots is computed (a fold in Spark, D is a parameter and
does not grow with the data) and block i of a class is placed by arithmetic.

No document is left out: when a class runs out, its slots stay empty and the others go on in their proportion.

Ranks inside a class come from counts per (class, hash bucket) and a window inside each bucket, so that a source
with a third of all rows is ordered by many tasks.

Defined cases: sources that ``shares`` does not name, and null sources, form the class ``*`` with ``rest_share``;
rows without an id are ordered by a hash of the whole row; null texts are mixed like others; rows that repeat one id
each get a place (rows that are equal throughout are interchangeable, and are numbered in one task); an empty table
gives an empty result.  Weights count documents; to weigh tokens or bytes, give shares divided by their mean size.  Helper columns are
named ``_mix_...`` so that extra columns of the input pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REST = "*"
MOST_SLOTS = 10_000


def edf_period(spark: SparkSession, shares: dict[str, int]) -> DataFrame:
    """One period of the schedule: mix_class, _mix_nth (block of the class in the period), _mix_slot.

    ``shares`` in the given order break ties between equal deadlines.
    """
    names, d = list(shares), sum(shares.values())
    if not names or min(shares.values()) < 1 or d > MOST_SLOTS:
        raise ValueError(f"shares must be integers from 1, and their sum at most {MOST_SLOTS}")
    share = F.array(*[F.lit(shares[n]) for n in names])
    at = lambda s: F.get(share, s)

    def step(state, t):
        due = F.transform(
            state["done"],
            lambda x, s: F.when(
                (x < at(s)) & (F.floor(x * d / at(s)) <= t),
                F.struct(F.ceil((x + 1) * d / at(s)).alias("due"), s.alias("s")),
            ),
        )
        pick = F.array_min(due)["s"]
        return F.struct(
            F.transform(state["done"], lambda x, s: x + F.when(s == pick, 1).otherwise(0)).alias("done"),
            F.concat(state["picks"], F.array(pick)).alias("picks"),
        )

    start = F.struct(F.array(*[F.lit(0)] * len(names)).alias("done"), F.array().cast("array<int>").alias("picks"))
    one = spark.range(1).select(F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), start, step, lambda s: s["picks"]).alias("picks"))
    slots = one.select(F.posexplode("picks").alias("_mix_slot", "s"))
    named = slots.withColumn("mix_class", F.get(F.array(*[F.lit(n) for n in names]), F.col("s")))
    nth = F.row_number().over(W.partitionBy("mix_class").orderBy("_mix_slot")) - 1
    return named.select("mix_class", nth.alias("_mix_nth"), F.col("_mix_slot").cast("long").alias("_mix_slot"))


def mix_sources(docs: DataFrame, shares: dict[str, int], rest_share: int, block_docs: int = 16, source_col: str = "source", id_col: str = "doc_id", seed: str = "mix") -> DataFrame:
    """``docs`` with mix_class, mix_rank (place in the class), mix_block, mix_slot, mix_pos (place in the block).

    Order by mix_slot, mix_pos to read the mixture.
    """
    spark = docs.sparkSession
    all_shares = dict(shares) | {REST: rest_share}
    period = sum(all_shares.values())
    n_docs = docs.count()
    digits = max(2, math.ceil(math.log(max(n_docs, 1) / 40_000 + 1, 16)))

    named = F.col(source_col).isin(list(shares))
    unnamed = F.concat(F.lit(":"), F.xxhash64(*docs.columns).cast("string"))
    keyed = docs.withColumns({"mix_class": F.when(named, F.col(source_col)).otherwise(F.lit(REST)), "_mix_hash": F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), unnamed)).cast("binary"))})
    keyed = keyed.withColumn("_mix_bucket", F.substring("_mix_hash", 1, digits))
    before = W.partitionBy("mix_class").orderBy("_mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy("mix_class", "_mix_bucket").count().select("mix_class", "_mix_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_mix_offset"))
    inside = W.partitionBy("mix_class", "_mix_bucket").orderBy("_mix_hash", F.xxhash64("text") if "text" in docs.columns else F.lit(0))
    ranked = keyed.withColumn("_mix_in", F.row_number().over(inside) - 1).join(offsets, ["mix_class", "_mix_bucket"])
    ranked = ranked.withColumn("mix_rank", F.col("_mix_offset") + F.col("_mix_in")).withColumn("mix_block", F.floor(F.col("mix_rank") / block_docs))

    share = F.coalesce(*[F.when(F.col("mix_class") == n, F.lit(a)) for n, a in all_shares.items()])
    ranked = ranked.withColumns({"_mix_nth": (F.col("mix_block") % share).cast("int"), "_mix_round": F.floor(F.col("mix_block") / share)})
    placed = ranked.join(F.broadcast(edf_period(spark, all_shares)), ["mix_class", "_mix_nth"])
    placed = placed.withColumns({"mix_slot": F.col("_mix_round") * period + F.col("_mix_slot"), "mix_pos": (F.col("mix_rank") % block_docs).cast("int")})
    return placed.select(*docs.columns, "mix_class", "mix_rank", "mix_block", "mix_slot", "mix_pos")
