"""File changes as a stream: debounced batches, and the work done for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def batches(changes: DataFrame, gap: str = "3 seconds") -> DataFrame:
    """first_at, last_at, changes, paths of each session of (at, path): changes with no silence of ``gap``.

    One session serves all files, as an editor's save-all is one batch.  Sessions are found in slices of a
    thousand gaps each; only the first and the last one of a slice, which may go on in the next slice, meet in one
    place, so that place sees two rows a slice however many changes there are.
    """
    width = F.expr(f"unix_micros(timestamp_seconds(0) + interval {gap}) * 1000")
    pause = F.expr(f"interval {gap}")
    inside = W.partitionBy("slice").orderBy("at")
    rows = changes.select("at", "path", F.floor(F.unix_micros("at") / width).alias("slice"))
    new = F.coalesce((F.col("at") >= F.lag("at").over(inside) + pause).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("n", F.sum("new").over(inside))
    found = rows.groupBy("slice", "n").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("changes"), F.collect_set("path").alias("set"))
    of_slice = W.partitionBy("slice")
    found = found.withColumn("edge", (F.col("n") == 1) | (F.col("n") == F.max("n").over(of_slice))).drop("slice", "n")
    over = W.orderBy("first_at")
    edges = found.where("edge").withColumn("new", F.coalesce((F.col("first_at") >= F.lag("last_at").over(over) + pause).cast("int"), F.lit(1)))
    merged = edges.withColumn("n", F.sum("new").over(over)).groupBy("n").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("changes").alias("changes"), F.array_distinct(F.flatten(F.collect_list("set"))).alias("set"))
    every = found.where("not edge").drop("edge").unionByName(merged.drop("n"))
    return every.select("first_at", "last_at", "changes", F.size("set").cast("bigint").alias("paths"))


def debounced(changes: DataFrame, gap: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """The same over a stream; changes later than ``late`` behind the newest one are dropped."""
    s = changes.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"))
    return s.agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("changes"), F.collect_set("path").alias("paths")).drop("w")


def run(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Start the stream; ``work`` computes all new table versions of a batch and swaps them in."""
    writer = stream.writeStream.outputMode("append").foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()
