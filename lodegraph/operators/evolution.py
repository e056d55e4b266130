"""Versions of symbols: sync, garbage collection, evolution, renames, snapshots, ownership, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def content_hash(symbols: DataFrame) -> DataFrame:
    """file, content_hash: over the symbols' hashes in parse order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "full_hash")))
    return symbols.groupBy("file").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["full_hash"]), ""), 256).alias("content_hash"))


def sync(old: DataFrame, new: DataFrame, old_hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols after, changed files): files whose content hash differs are replaced as a whole."""
    fresh = content_hash(new)
    changed = fresh.join(old_hashes.select("file", F.col("content_hash").alias("was")), "file", "left").where("was is null or was <> content_hash").select("file", "content_hash")
    kept = old.join(changed.select("file"), "file", "left_anti")
    return kept.unionByName(new.join(changed.select("file"), "file", "left_semi")), changed


def collect_garbage(symbols: DataFrame, existing: DataFrame) -> DataFrame:
    return symbols.join(existing.select("file").distinct(), "file", "left_semi")


def stale_embeddings(symbols: DataFrame, embeddings: DataFrame) -> DataFrame:
    e = embeddings.select(F.col("symbol_id").alias("id"), F.col("body_hash").alias("was"))
    return symbols.join(e, "id", "left").where("was is null or was <> body_hash").select("id", "body_hash")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, name, change_type, old_full_hash, new_full_hash of created, modified and deleted symbols."""
    o = old.select("file", "name", F.col("full_hash").alias("old_full_hash"))
    n = new.select("file", "name", F.col("full_hash").alias("new_full_hash"))
    kind = F.when(F.col("old_full_hash").isNull(), "created").when(F.col("new_full_hash").isNull(), "deleted").when(F.col("old_full_hash") != F.col("new_full_hash"), "modified")
    return o.join(n, ["file", "name"], "full_outer").withColumn("change_type", kind).where("change_type is not null")


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_file, new_file, matches: a deleted file and the first created one that holds half its bodies."""
    o_files, n_files = old.select("file").distinct(), new.select("file").distinct()
    gone = old.join(n_files, "file", "left_anti").select(F.col("file").alias("old_file"), "body_hash").distinct()
    come = new.join(o_files, "file", "left_anti").select(F.col("file").alias("new_file"), "body_hash").distinct()
    total = gone.groupBy("old_file").agg(F.count("*").alias("total"))
    met = gone.join(come, "body_hash").groupBy("old_file", "new_file").agg(F.count("*").alias("matches")).join(total, "old_file").where("2 * matches >= total")
    return met.groupBy("old_file").agg(F.min(F.struct("new_file", "matches")).alias("m")).select("old_file", "m.new_file", "m.matches")


def snapshot(symbols: DataFrame, branch: str) -> DataFrame:
    """branch_name, id, full_hash: a row for each symbol, to be written partitioned by branch."""
    return symbols.select(F.lit(branch).alias("branch_name"), "id", "full_hash")


def ownership(lines: DataFrame) -> DataFrame:
    """file, author, commits, last_touched (and the e-mail of the first line, where lines have one) from blamed lines (file, author, at)."""
    mail = [F.min_by("email", "line").alias("email")] if {"email", "line"} <= set(lines.columns) else []
    return lines.groupBy("file", "author").agg(*mail, F.count("*").alias("commits"), F.max("at").alias("last_touched"))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def history(commits: DataFrame, n: int) -> DataFrame:
    """The n latest rows (file, author, at, hash) of each file."""
    w = W.partitionBy("file").orderBy(F.desc("at"), "hash")
    return commits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol_id, old_file, new_file, change_type of the symbols whose bodies a renamed file took along."""
    named = renames(old, new).select("old_file", "new_file")
    there = new.select(F.col("file").alias("new_file"), "body_hash").distinct()
    moved = old.join(named, old["file"] == named["old_file"]).join(there, ["new_file", "body_hash"], "left_semi")
    return moved.select(F.col("id").alias("symbol_id"), "old_file", "new_file", F.lit("moved").alias("change_type"))


def timeline(evolution: DataFrame) -> DataFrame:
    """The changes (symbol_id, id, timestamp, diff_summary) of each symbol with their places, newest first."""
    newest = W.partitionBy("symbol_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return evolution.withColumns({"diff_summary": F.coalesce("diff_summary", F.lit("")), "place": F.row_number().over(newest)})


def touching(commits: DataFrame) -> DataFrame:
    """The commits (file, hash, at, content_hash) that change their file: its content differs from the commit before."""
    before = F.lag("content_hash").over(W.partitionBy("file").orderBy("at", "hash"))
    return commits.withColumn("was", before).where("was is null or was <> content_hash").drop("was")
