"""What a batch of file changes does to the tables, in this order: evolution (before the rows change), sync,
cascade, embeddings, renames, garbage collection, contradictions.

Tables of the catalog: symbols, edges, annotations, evolution, cascade_log, embeddings, insights.  Every table's
next version is computed from the versions at the start of the batch and shown once it is written; a batch that
is run again (its number is kept in the table ``batches``) changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodegraph.functions import embed
from lodegraph.functions import expressions as X
from lodegraph.operators import evolution, knowledge
from lodegraph.sources import files as S
from lodegraph.sources import parse as P
from lodegraph.storage import Catalog, written
from lodegraph.tools import SHAPES

CHANGE = "path string, op string, content string, at timestamp"
KEPT = ["id", "name", "kind", "file", "line_start", "line_end", "signature", "docstring", "scope_chain", "language", "complexity", "body", "body_hash", "full_hash"]


def change_stream(spark: SparkSession, folder: str, most_files: int = 32) -> DataFrame:
    """Changes (path, op, content, at; op: created, modified or deleted) from JSON files in a folder; a trigger takes
    at most so many files, so a writer in a hurry waits in the folder and not in memory."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", most_files).json(folder)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path of a supported language."""
    known = changes.where(S.language(F.col("path")).isNotNull())
    return known.groupBy("path").agg(F.max_by(F.struct("op", "content"), "at").alias("x"), F.max("at").alias("at")).select("path", "x.op", "x.content", "at")


class Upkeep:
    def __init__(self, spark: SparkSession, catalog: Catalog, embedder: embed.Embedder | None = None, now: Column | None = None):
        self.spark, self.catalog, self.embedder = spark, catalog, embedder
        self.now = (F.unix_timestamp() if now is None else now).cast("bigint")

    def table(self, name: str, shape: str | None = None) -> DataFrame:
        return self.catalog.read(name) if self.catalog.exists(name) else self.spark.createDataFrame([], shape or SHAPES[name])

    def __call__(self, changes: DataFrame, batch: int) -> None:
        done = self.table("batches", "batch bigint")
        if not done.where(F.col("batch") == batch).isEmpty():
            return
        changes = written(latest_changes(changes), "changes")
        if not changes.isEmpty():
            self.apply(changes)
        self.catalog.append("batches", self.spark.createDataFrame([(batch,)], "batch bigint"))

    def apply(self, changes: DataFrame) -> None:
        old_symbols, old_edges = self.table("symbols"), self.table("edges", "from_id string, to_id string, kind string, file string, line int, confidence double")
        touched, live = changes.select(F.col("path").alias("file")), changes.where("op <> 'deleted' and content is not null")
        parsed = written(P.parse(live.select("path", S.language(F.col("path")).alias("language"), "content")), "parsed")
        found = P.identified(parsed).withColumn("complexity", F.lit(0).cast("bigint"))
        # an id that occurs twice in a file is its last symbol
        turn = F.row_number().over(W.partitionBy("id").orderBy(F.desc("pos")))
        new = written(found.withColumn("turn", turn).where("turn = 1").select(*KEPT), "new")
        before = written(old_symbols.join(touched, "file", "left_semi"), "before")

        # evolution, before the rows change
        names = lambda s: s.groupBy("file", "name").agg(F.max_by(F.struct("id", "full_hash"), "line_start").alias("x")).select("file", "name", "x.id", "x.full_hash")
        changed = evolution.diff(names(before), names(new)).join(names(new).select("file", "name", F.col("id").alias("new_id")), ["file", "name"], "left").join(names(before).select("file", "name", F.col("id").alias("old_id")), ["file", "name"], "left")
        log = changed.select(F.coalesce("new_id", "old_id").alias("symbol_id"), self.now.alias("timestamp"), "change_type", "old_full_hash", "new_full_hash", F.lit(None).cast("string").alias("diff_summary"))
        renamed = written(evolution.renames(before.join(new.select("file"), "file", "left_anti"), new.join(before.select("file"), "file", "left_anti")) if not before.isEmpty() else self.spark.createDataFrame([], "old_file string, new_file string, matches bigint"), "renamed")
        moved = before.join(renamed.select(F.col("old_file").alias("file"), "new_file"), "file").join(new.select(F.col("file").alias("new_file"), "body_hash", F.col("full_hash").alias("h")).dropDuplicates(["new_file", "body_hash"]), ["new_file", "body_hash"])
        moved = moved.select(F.col("id").alias("symbol_id"), self.now.alias("timestamp"), F.lit("moved").alias("change_type"), F.col("full_hash").alias("old_full_hash"), F.col("h").alias("new_full_hash"), F.concat("file", F.lit(" -> "), "new_file").alias("diff_summary"))
        log = log.unionByName(moved).withColumn("id", F.sha2(F.concat_ws(":", "symbol_id", "change_type", F.col("timestamp").cast("string")), 256))
        self.catalog.upsert("evolution", log.select("id", "symbol_id", "timestamp", "change_type", "old_full_hash", "new_full_hash", "diff_summary"), ["id"])

        # sync: rows of touched files go, new ones come, lines are fresh even where no symbol differs
        symbols = self.catalog.replace("symbols", old_symbols.join(touched, "file", "left_anti").select(*KEPT).unionByName(new))
        edges = old_edges.join(touched, "file", "left_anti").unionByName(P.call_edges(parsed).select(*old_edges.columns))
        edges = self.catalog.replace("edges", edges)

        # cascade from the symbols whose hash differs
        hashes = new.select("id", "full_hash").join(before.select("id", F.col("full_hash").alias("was")), "id", "left").where("was is null or was <> full_hash").select("id", "full_hash")
        hashes = written(hashes, "hashes")
        notes = self.table("annotations")
        after, told = knowledge.cascade(edges.where("kind = 'CALLS'").select("from_id", "to_id"), notes.select("id", "symbol_id", "confidence", "status", "full_hash_at"), hashes)
        told = written(told.withColumn("timestamp", self.now), "told")
        fresh = after.select("id", F.col("confidence").alias("c"), F.col("status").alias("s"))
        self.catalog.replace("annotations", notes.join(fresh, "id").withColumns({"confidence": F.col("c"), "status": F.col("s")}).select(*notes.columns))
        self.catalog.append("cascade_log", told)

        # embeddings of new and altered symbols, then rows of symbols that are gone
        if self.embedder is not None:
            texts = new.select("id", "body_hash", X.embedding_text(F.col("kind"), F.col("name"), F.col("scope_chain"), F.col("signature"), F.col("docstring"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")).alias("text"))
            embed.refresh(self.catalog, texts, self.embedder)
            self.catalog.replace("embeddings", self.table("embeddings").join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi"))

        # contradictions of all active notes
        found = knowledge.contradiction_insights(self.spark, self.table("annotations"))
        self.catalog.replace("insights", written(knowledge.add_insights(self.table("insights"), found, self.now), "insights"))


def start(spark: SparkSession, catalog: Catalog, root: str, embedder: embed.Embedder | None = None, repo: str | None = None) -> Upkeep:
    """The first index of a source tree: all files as one batch of changes, git's tables where there is a repository."""
    work = Upkeep(spark, catalog, embedder)
    files = S.read_sources(spark, root)
    work.apply(written(files.select("path", F.lit("created").alias("op"), "content", F.current_timestamp().alias("at")), "changes"))
    if repo is not None:
        S.sync_git(spark, catalog, repo)
    return work
