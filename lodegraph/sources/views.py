"""The engine's model (symbols, call edges, attention, notes) as views of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodegraph.operators.knowledge import attention
from lodegraph.operators.search import Index
from lodegraph.storage import workspace

_INDEXES: dict[tuple[str, str], Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each document: its source is the file, its text the body."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.lit("module").alias("kind"),
        F.col("source").alias("file"), F.col("lang").alias("language"), F.col("text").alias("body"), F.sha2("text", 256).alias("body_hash"),
    )


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), F.col("p_size").cast("bigint").alias("complexity"))


def calls(spark: SparkSession, sf_dir: str, least: int = 48) -> DataFrame:
    """Distinct (from_id, to_id): a part calls the next one of its order where the quantity is large."""
    lines = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    e = lines.select(F.col("l_partkey").alias("from_id"), F.lead("l_partkey").over(w).alias("to_id"), "l_quantity")
    return e.where((F.col("l_quantity") >= least) & (F.col("from_id") != F.col("to_id"))).select("from_id", "to_id").distinct()


def attention_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "view").when(F.col("event_type") == "click", "query").when(F.col("event_type") == "purchase", "annotate")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), kind.alias("kind"), F.col("ts").alias("at")).where("kind is not null")


def hot(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """id, importance of the k symbols of most attention."""
    found = attention(attention_events(spark, sf_dir)).where("importance > 0")
    return found.select("id", "importance").orderBy(F.desc("importance"), "id").limit(k)


def part_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, old_hash, full_hash of two versions of the part symbols: large parts differ."""
    now = F.concat(F.lit("h"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") >= 40, F.lit("old")).otherwise(now).alias("old_hash"), now.alias("full_hash"))


def search_index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored postings of the documents, built at the first search of a session."""
    key = spark.sparkContext.applicationId, sf_dir.rstrip("/")
    if key not in _INDEXES:
        _INDEXES[key] = Index.build(table(spark, sf_dir, "documents"), "doc_id", "text", f"{workspace(spark)}/postings-{uuid.uuid4().hex}")
    return _INDEXES[key]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("symbol_id"), F.col("text").alias("content"))


def part_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note on every third part; every second of them anchored to another hash, every fifth stale."""
    p = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("symbol_id"), F.lit(0.8).alias("confidence"),
        F.when(F.col("p_partkey") % 5 == 0, "stale").otherwise("active").alias("status"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("h"), F.col("p_partkey").cast("string"))).otherwise(F.lit("old")).alias("full_hash_at"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("file"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("hash"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the text symbols: every tenth deleted, the next altered, every tenth added anew;
    the file src3 is renamed."""
    s = text_symbols(spark, sf_dir).select("id", "file", "name", "body", F.col("id").alias("pos"), F.col("body_hash").alias("full_hash"), "body_hash")
    kept = s.where("id % 10 <> 0").withColumn("body", F.when(F.col("id") % 10 == 1, F.concat("body", F.lit(" edited"))).otherwise(F.col("body")))
    added = s.where("id % 10 = 2").withColumns({"id": F.col("id") + 1_000_000_000, "name": F.concat("name", F.lit("_new")), "pos": F.col("id") + 1_000_000_000})
    new = kept.unionByName(added).withColumns({"full_hash": F.sha2("body", 256), "body_hash": F.sha2("body", 256), "file": F.when(F.col("file") == "src3", F.lit("src3_moved")).otherwise(F.col("file"))})
    return s, new
