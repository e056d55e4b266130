"""Annotations, staleness cascade, contradictions, attention, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodegraph.functions import expressions as X
from lodegraph.operators.graph import in_degree, reach

#: Opposed keywords, in order; the first pair that matches counts.
OPPOSED = (
    ("always", "never"),
    ("always", "sometimes"),
    ("true", "false"),
    ("returns true", "returns false"),
    ("mutable", "immutable"),
    ("synchronous", "asynchronous"),
    ("sync", "async"),
    ("safe", "unsafe"),
    ("pure", "impure"),
    ("stateless", "stateful"),
    ("required", "optional"),
    ("deprecated", "recommended"),
    ("public", "private"),
    ("todo", "done"),
    ("broken", "working"),
    ("slow", "fast"),
    ("should not", "must"),
    ("do not", "always"),
)
DECAY, FLOOR, FURTHEST = 0.3, 0.01, 5


def attention(events: DataFrame) -> DataFrame:
    """id, views, queries, annotations, importance, last_accessed from events (id, kind, at)."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    out = events.groupBy("id").agg(n("view").alias("views"), n("query").alias("queries"), n("annotate").alias("annotations"), F.max("at").alias("last_accessed"))
    return out.withColumn("importance", (F.col("views") + 2 * F.col("queries") + 3 * F.col("annotations")).cast("double"))


def cascade(edges: DataFrame, annotations: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations after, log): hash drift makes annotations stale, a restored hash heals them, and
    annotations of callers lose 0.3, 0.15, ... by distance; reductions of all triggers add up to a floor of 0.

    annotations: id, symbol_id, confidence, status, full_hash_at; changed: id, full_hash.
    """
    hit = annotations.join(changed.select(F.col("id").alias("symbol_id"), "full_hash"), "symbol_id", "left")
    heals = (F.col("full_hash") == F.col("full_hash_at")) & (F.col("status") == "stale")
    drifts = (F.col("full_hash") != F.col("full_hash_at")) & (F.col("status") == "active")
    hit = hit.withColumns({
        "status": F.when(heals, F.lit("active")).when(drifts, F.lit("stale")).otherwise(F.col("status")),
        "confidence": F.when(heals, F.lit(1.0)).otherwise(F.col("confidence")),
        "direct": F.when(heals, F.lit("revert_reactivation")).when(drifts, F.lit("direct_staleness")),
    })
    far = reach(edges, changed.select("id"), FURTHEST, True).withColumn("reduction", DECAY * F.pow(F.lit(0.5), F.col("depth") - 1)).where(F.col("reduction") >= FLOOR)
    loss = far.groupBy(F.col("id").alias("symbol_id")).agg(F.sum("reduction").alias("loss"))
    after = hit.join(loss, "symbol_id", "left").withColumn("new", F.round(F.greatest(F.lit(0.0), F.col("confidence") - F.coalesce("loss", F.lit(0.0))), 6))
    log = far.join(annotations.select(F.col("id").alias("annotation_id"), "symbol_id", "confidence"), F.col("id") == F.col("symbol_id")).select(
        F.col("seed").alias("trigger_symbol"), F.col("symbol_id").alias("affected_symbol"), "annotation_id", F.col("depth").alias("distance"), F.round("reduction", 6).alias("reduction")
    )
    return after.select("id", "symbol_id", F.col("new").alias("confidence"), "status", "full_hash_at", "direct"), log


def _chosen(ids: list[int] | Column) -> Column:
    return ids if isinstance(ids, Column) else F.col("id").isin(ids)


def verify(annotations: DataFrame, ids: list[int] | Column) -> DataFrame:
    hit = _chosen(ids)
    return annotations.withColumns({"confidence": F.when(hit, 1.0).otherwise(F.col("confidence")), "status": F.when(hit, "active").otherwise(F.col("status"))})


def downvote(annotations: DataFrame, ids: list[int] | Column) -> DataFrame:
    lower = F.greatest(F.lit(0.0), F.col("confidence") - 0.2)
    return annotations.withColumn("confidence", F.when(_chosen(ids), lower).otherwise(F.col("confidence")))


def contradictions(spark: SparkSession, notes: DataFrame, pairs=OPPOSED) -> DataFrame:
    """symbol_id, a, b, first, second: pairs of active notes (a < b) of one symbol with opposed keywords.

    Notes without a ``status`` count as active.  Notes are first cut down to those that hold a keyword, one
    row each, so only they meet.
    """
    if "status" in notes.columns:
        notes = notes.where("status = 'active'")
    words = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "n int, first string, second string")  # a fixed list
    held = notes.crossJoin(F.broadcast(words)).select(
        "symbol_id", "id", "n", "first", "second", F.lower("content").contains(F.col("first")).alias("x"), F.lower("content").contains(F.col("second")).alias("y")
    ).where("x or y")
    a = held.select("symbol_id", F.col("id").alias("a"), "n", "first", "second", "x", "y")
    b = held.select("symbol_id", F.col("id").alias("b"), "n", F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = a.join(b, ["symbol_id", "n"]).where("a < b and ((x and y2) or (y and x2))")
    return met.groupBy("symbol_id", "a", "b").agg(F.min(F.struct("n", "first", "second")).alias("m")).select("symbol_id", "a", "b", "m.first", "m.second")


def contradiction_insights(spark: SparkSession, notes: DataFrame, pairs=OPPOSED) -> DataFrame:
    """An insight for each contradiction of any symbol, with the notes' texts cut to 50 characters."""
    met = contradictions(spark, notes, pairs)
    text = lambda key, name: notes.select(F.col("id").alias(key), X.shortened(F.col("content"), 50).alias(name))
    said = F.format_string("'%s' vs '%s': %s / %s", "first", "second", "ta", "tb")
    return met.join(text("a", "ta"), "a").join(text("b", "tb"), "b").select(
        F.lit("contradiction").alias("insight_type"), "symbol_id", said.alias("content"), F.lit(0.7).alias("confidence"), F.lit("active").alias("status")
    )


def annotate(annotations: DataFrame, symbols: DataFrame, name: str, kind: str, content: str, now: Column, author: str = "agent") -> DataFrame:
    """``annotations`` with one more note on the first symbol of that name, anchored to its present hash."""
    one = symbols.where(F.col("name") == name).orderBy("id").limit(1)
    last = annotations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = one.crossJoin(F.broadcast(last)).select(  # one row each
        (F.col("last") + 1).cast("bigint").alias("id"), F.col("id").alias("symbol_id"), F.lit(kind).alias("annotation_type"), F.lit(content).alias("content"), F.lit(author).alias("author"),
        F.lit(0.8).alias("confidence"), F.col("full_hash").alias("full_hash_at"), F.lit("active").alias("status"), now.alias("created_at"), now.alias("updated_at"),
    )
    return annotations.unionByName(new.select(*annotations.columns))


def set_status(annotations: DataFrame, ids: list[int], status: str) -> DataFrame:
    return annotations.withColumn("status", F.when(F.col("id").isin(ids), status).otherwise(F.col("status")))


def set_confidence(annotations: DataFrame, ids: list[int], confidence: float) -> DataFrame:
    return annotations.withColumn("confidence", F.when(F.col("id").isin(ids), float(confidence)).otherwise(F.col("confidence")))


def notes_of(annotations: DataFrame, symbols: DataFrame) -> DataFrame:
    """The notes of the given symbols (id), newest first."""
    return annotations.join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").orderBy(F.desc("created_at"), F.desc("id"))


def resolved_names(symbols: DataFrame, names: Column) -> DataFrame:
    """symbol_ids: the ids of all symbols with one of the names (an array column of one row's world), in order."""
    return symbols.where(F.array_contains(names, F.col("name"))).agg(F.array_sort(F.collect_list("id")).alias("symbol_ids"))


def numbered_after(table: DataFrame, row: DataFrame) -> DataFrame:
    """``table`` and one more row, whose id follows the greatest one."""
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    return table.unionByName(row.crossJoin(F.broadcast(last)).withColumn("id", (F.col("last") + 1).cast("bigint")).select(*table.columns))


def record_decision(decisions: DataFrame, symbols: DataFrame, csv: str, description: str, now: Column, rationale: str | None = None, alternatives: str | None = None) -> DataFrame:
    ids = resolved_names(symbols, X.names_of(F.lit(csv), keep_blank=True))
    text = lambda x: F.lit(x).cast("string")
    return numbered_after(decisions, ids.withColumns({"description": F.lit(description), "rationale": text(rationale), "alternatives": text(alternatives), "confidence": F.lit(0.8), "created_at": now}))


def record_pattern(patterns: DataFrame, symbols: DataFrame, name: str, description: str, now: Column, csv: str = "") -> DataFrame:
    ids = resolved_names(symbols, X.names_of(F.lit(csv))).withColumnRenamed("symbol_ids", "trigger_symbol_ids")
    return numbered_after(patterns, ids.withColumns({"name": F.lit(name), "description": F.lit(description), "evidence": F.lit(None).cast("string"), "confidence": F.lit(0.7), "created_at": now}))


def active_insights(insights: DataFrame) -> DataFrame:
    return insights.where("status = 'active'").withColumn("symbol_ids", F.coalesce("symbol_ids", F.array().cast(insights.schema["symbol_ids"].dataType))).orderBy(F.desc("confidence"), "id")


def resolve_insight(insights: DataFrame, one: int, status: str) -> DataFrame:
    if status not in ("resolved", "dismissed"):
        raise ValueError("an insight is resolved or dismissed")
    return insights.withColumn("status", F.when(F.col("id") == one, status).otherwise(F.col("status")))


def add_insights(stored: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """``stored`` with the found ones (insight_type, symbol_id, content, confidence, status) that it lacks."""
    rows = found.select("insight_type", "content", F.array("symbol_id").alias("symbol_ids"), "confidence", "status").dropDuplicates(["insight_type", "content", "symbol_ids"])
    new = rows.join(stored.select("insight_type", "content", "symbol_ids"), ["insight_type", "content", "symbol_ids"], "left_anti")
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    place = F.row_number().over(W.orderBy("insight_type", "symbol_ids", "content"))
    new = new.withColumn("n", place).crossJoin(F.broadcast(last)).withColumns({"id": (F.col("last") + F.col("n")).cast("bigint"), "created_at": now})
    return stored.unionByName(new.select(*stored.columns))


def add_topic(topics: DataFrame, rows: DataFrame) -> DataFrame:
    return topics.unionByName(rows.select("topic", "symbol_id")).dropDuplicates(["topic", "symbol_id"])


def god_nodes(edges: DataFrame, more_than: int = 10) -> DataFrame:
    return in_degree(edges).where(F.col("callers") > more_than)


def insights(edges: DataFrame, more_than: int = 10) -> DataFrame:
    """insight_type, symbol_id, content, confidence, status; one for each symbol, however often it is asked for."""
    text = F.format_string("symbol has %d callers", F.col("callers"))
    return god_nodes(edges, more_than).select(F.lit("god_node").alias("insight_type"), F.col("id").alias("symbol_id"), text.alias("content"), F.lit(0.7).alias("confidence"), F.lit("active").alias("status"))
