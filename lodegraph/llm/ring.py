"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Built from DataFrame functions alone.  The ring is cut into a fixed number of arcs; a row falls
on the arc of its key's hash.  Each shard owns several virtual nodes; an arc belongs to the next
virtual node clockwise, and behind it stand the other shards in the order in which the ring
reaches them.  No shard may hold more than its share of the rows (the shares differ by one row at
most): in each round every arc offers what it has left to its next shard, which takes offers in
ring order while it has room, and the rest continues clockwise.  After as many rounds as there are
shards every row has a place, since the shares add up to the number of rows.

Only one number per arc enters the rounds, so their input has the same size at any scale; rows
are touched twice: once to be counted by arc (combined before the shuffle) and once to be
numbered within their arc.

Defined cases: a null text has no bytes (size 1) and the checksum of an empty text; a null key has
a hash of its own; equal keys share an arc and are ordered by their size and checksum; repeated
rows each get a place; an empty table gives an empty table; texts never leave the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodegraph.llm.common import settle


@dataclass(frozen=True)
class Params:
    shards: int = 8
    virtual: int = 64
    arcs: int = 8192


def arc_of(key, arcs: int):
    """The arc of a hash: the ring is the range of a 64-bit hash, from the least to the greatest."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - arcs.bit_length() + 1)


def clockwise(spark: SparkSession, p: Params) -> DataFrame:
    """arc, order: for each arc the shards in the order in which the ring reaches them."""
    nodes = spark.range(p.shards * p.virtual).select(
        (F.col("id") % p.shards).cast("int").alias("shard"),
        arc_of(F.concat_ws(":", F.lit("shard"), F.col("id") % p.shards, F.floor(F.col("id") / p.shards)), p.arcs).alias("at"),
    )
    #: smallest arc at or behind each arc, for every shard; arcs x shards values of fixed number
    seats = nodes.groupBy("at").agg(F.collect_set("shard").alias("own"))
    ring = spark.range(p.arcs).withColumnRenamed("id", "arc").join(F.broadcast(seats), F.col("arc") == F.col("at"), "left")
    ahead = W.orderBy("arc").rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    here = lambda s: F.when(F.array_contains("own", s), F.col("arc"))
    steps = [F.coalesce(F.min(here(s)).over(ahead), F.min(here(s)).over(every) + p.arcs) for s in range(p.shards)]
    ring = ring.select("arc", *[x.alias(f"d{s}") for s, x in enumerate(steps)])
    order = F.array_sort(F.array(*[F.struct(F.col(f"d{s}").alias("d"), F.lit(s).alias("shard")) for s in range(p.shards)]))
    return ring.select("arc", F.transform(order, lambda x: x["shard"]).alias("order"))


def places(spark: SparkSession, counts: DataFrame, p: Params) -> DataFrame:
    """arc, parts: pieces (lo, n, shard, base) of each arc; a piece's rows take slots from base on."""
    state = clockwise(spark, p).join(counts, "arc", "left").withColumn("rest", F.coalesce("n", F.lit(0)))
    every = W.partitionBy()
    state = state.withColumn("total", F.sum("rest").over(every)).withColumn("lo", F.lit(0).cast("long"))
    state = settle(state.select("arc", "order", "rest", "total", "lo", *[F.lit(0).cast("long").alias(f"used{s}") for s in range(p.shards)], F.array().cast("array<struct<lo:bigint,n:bigint,shard:int,base:bigint>>").alias("parts")), "ring")
    for k in range(p.shards):
        goal = F.col("order")[k]
        room = F.floor(F.col("total") / p.shards) + (goal < F.col("total") % p.shards).cast("long")
        used = F.array(*[F.col(f"used{s}") for s in range(p.shards)])[goal]
        ahead = W.partitionBy("goal").orderBy("arc").rowsBetween(W.unboundedPreceding, -1)
        state = state.withColumn("goal", goal).withColumn("before", F.coalesce(F.sum("rest").over(ahead), F.lit(0)))
        take = F.greatest(F.lit(0), F.least(F.col("rest"), room - used - F.col("before"))).cast("long")
        state = state.withColumn("base", used + F.col("before")).withColumn("take", take)
        piece = F.struct("lo", F.col("take").alias("n"), F.col("goal").alias("shard"), "base")
        state = state.withColumn("parts", F.when(F.col("take") > 0, F.array_append("parts", piece)).otherwise(F.col("parts")))
        state = state.withColumns({f"used{s}": F.col(f"used{s}") + F.coalesce(F.sum(F.when(F.col("goal") == s, F.col("take"))).over(every), F.lit(0)) for s in range(p.shards)})
        state = state.withColumns({"lo": F.col("lo") + F.col("take"), "rest": F.col("rest") - F.col("take")}).drop("goal", "before", "base", "take")
        state = settle(state, "ring")
    return state.where(F.size("parts") > 0).select("arc", "parts")


def assign(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard for every row; the law is ``rows``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), arc_of(F.col(id_col), p.arcs).alias("arc"),
    )
    counts = docs.select(arc_of(F.col(id_col), p.arcs).alias("arc")).groupBy("arc").agg(F.count("*").alias("n"))
    parts = places(spark, counts, p)
    within = W.partitionBy("arc").orderBy(F.xxhash64(id_col), F.col(id_col), "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    # at most arcs rows of at most one piece per shard, whatever the table's size
    found = ranked.join(F.broadcast(parts), "arc").withColumn(
        "piece", F.filter("parts", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["lo"] + x["n"]))[0]
    )
    return found.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.col("piece.shard").alias("shard"),
        (F.col("piece.base") + F.col("rank") - F.col("piece.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
