"""The engine's tools: parameters in, rows and text out.

``Tools`` holds the tables of one code base (see ``SHAPES``) and answers by the operators.  An ``Answer`` is a lazy
DataFrame with a ``line`` of text for each row; ``text()`` brings the lines together under a head.  Tools that
change a table replace it in ``tables`` by its next version, and in the catalog where there is one.  Questions
never change anything: attention is recorded by ``track``, which the caller may switch off.

Names may stand for several symbols; unknown names give no rows, and ids of no symbol are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodegraph.functions import expressions as X
from lodegraph.operators import clones, context, evolution, graph, knowledge, search
from lodegraph.storage import Catalog

SHAPES = {
    "symbols": "id string, name string, kind string, file string, line_start int, line_end int, signature string, docstring string, scope_chain array<string>, language string, complexity bigint, body string, body_hash string, full_hash string",
    "edges": "from_id string, to_id string, kind string",
    "annotations": "id bigint, symbol_id string, annotation_type string, content string, author string, confidence double, full_hash_at string, status string, created_at bigint, updated_at bigint",
    "attention": "id string, kind string, at bigint",
    "insights": "id bigint, insight_type string, content string, symbol_ids array<string>, confidence double, status string, created_at bigint",
    "decisions": "id bigint, symbol_ids array<string>, description string, rationale string, alternatives string, confidence double, created_at bigint",
    "patterns": "id bigint, name string, description string, trigger_symbol_ids array<string>, evidence string, confidence double, created_at bigint",
    "topics": "topic string, symbol_id string",
    "evolution": "id string, symbol_id string, timestamp bigint, change_type string, old_full_hash string, new_full_hash string, diff_summary string",
    "commits": "file string, hash string, author string, email string, timestamp bigint, message string",
    "blame": "file string, line int, commit_hash string, author string, email string, at bigint",
    "owners": "file string, author string, email string, commits bigint, last_touched bigint",
    "embeddings": "symbol_id string, embedding array<float>, body_hash string",
    "sources": "file string, content string",
}
TIERS = ("brief", "standard", "full", "deep")


@dataclass
class Answer:
    """Rows in order (by ``order``), a line of text each, and what to say of them."""

    rows: DataFrame
    line: Column
    order: list
    head: str = ""
    none: str = "nothing found"

    def lines(self) -> list[str]:
        return [r[0] for r in self.rows.orderBy(*self.order).select(self.line.alias("line")).collect()]

    def text(self) -> str:
        found = self.lines()
        return "\n".join([self.head] * bool(self.head) + found) if found else self.none


class Tools:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], index: search.Index | None = None, embedder=None, catalog: Catalog | None = None, now: Column | None = None):
        self.spark, self.index, self.embedder, self.catalog = spark, index, embedder, catalog
        self.tables = {name: tables[name] if name in tables else spark.createDataFrame([], shape) for name, shape in SHAPES.items()}
        self.now = F.unix_timestamp() if now is None else now

    def __getattr__(self, name: str) -> DataFrame:
        if name in SHAPES:
            return self.tables[name]
        raise AttributeError(name)

    # --- shared parts -----------------------------------------------------------------------------------

    def save(self, name: str, table: DataFrame) -> None:
        self.tables[name] = table if self.catalog is None else self.catalog.replace(name, table)

    def named(self, name: str) -> DataFrame:
        return self.symbols.where(F.col("name") == name)

    def calls(self) -> DataFrame:
        return self.edges.where("kind = 'CALLS'").select("from_id", "to_id").distinct()

    def risky(self) -> DataFrame:
        return graph.risk(self.symbols, self.calls(), self.annotations.where("status = 'stale'"))

    def seen(self) -> DataFrame:
        return knowledge.attention(self.attention)

    def track(self, symbols: DataFrame, kind: str) -> None:
        """Record that symbols were viewed, found by a query, or annotated."""
        self.save("attention", self.attention.unionByName(symbols.select("id", F.lit(kind).alias("kind"), self.now.cast("bigint").alias("at"))))

    @staticmethod
    def at() -> Column:
        return F.format_string("%s %s (%s:%d)", "kind", "name", "file", "line_start")

    def _reached(self, name: str, depth: int, callers: bool) -> DataFrame:
        found = graph.reach(self.calls(), self.named(name).select("id"), depth, callers).groupBy("id").agg(F.min("depth").alias("depth"))
        return found.join(self.symbols, "id")

    # --- 1 to 6: lookups -----------------------------------------------------------------------------------

    def get_symbol(self, name: str) -> Answer:
        rows = self.named(name).withColumn("found", F.lit("exact")) if self.index is None else search.lookup(self.symbols, self.index, name, 5)
        near = F.when(F.col("found") == "search", "near: ").otherwise("")
        text = F.concat(near, F.concat_ws("\n  ", self.at(), "signature", X.shortened(F.col("docstring"), 200)))
        return Answer(rows, text, ["file", "line_start", "id"], none=f"no symbol {name}")

    def find_callers(self, name: str, depth: int = 3) -> Answer:
        text = F.format_string("%d: %s %s (%s:%d)", "depth", "kind", "name", "file", "line_start")
        return Answer(self._reached(name, depth, True), text, ["depth", "file", "line_start", "id"], f"callers of {name}:", f"no callers of {name}")

    def find_dependencies(self, name: str, depth: int = 3) -> Answer:
        text = F.format_string("%d: %s %s (%s:%d)", "depth", "kind", "name", "file", "line_start")
        return Answer(self._reached(name, depth, False), text, ["depth", "file", "line_start", "id"], f"{name} depends on:", f"{name} depends on nothing known")

    def search_semantic(self, query: str, top_k: int = 10) -> Answer:
        """Hybrid where there are embeddings, else BM25; a failing embedder falls back to BM25 too."""
        vectors = self.embeddings.select(F.col("symbol_id").alias("id"), F.col("embedding").alias("v"))
        asked = None
        if self.embedder is not None:
            try:
                asked = self.spark.createDataFrame([([float(x) for x in self.embedder.embed_batch([query])[0]],)], "q array<float>")
            except (RuntimeError, OSError, ValueError):
                asked = None
        hot = self.seen().where("importance > 0").select("id", "importance").orderBy(F.desc("importance"), "id").limit(3 * top_k)
        found = search.search_or_fall_back(self.index, query, top_k, vectors, asked, self.calls(), hot)
        rows = found.join(self.symbols, "id")
        return Answer(rows, F.concat(self.at(), F.format_string(" %s %.4f", "found", "score")), ["rank"], f"results for {query}:", f"no results for {query}")

    def get_file_summary(self, file: str) -> Answer:
        text = F.format_string("%d-%d %s %s", "line_start", "line_end", "kind", "name")
        return Answer(self.symbols.where(F.col("file") == file), text, ["line_start", "id"], file, f"no symbols in {file}")

    def get_project_identity(self) -> Answer:
        counts = self.symbols.agg(F.count("*").alias("symbols"), F.count_distinct("file").alias("files")).crossJoin(self.edges.agg(F.count("*").alias("edges")))  # one row each
        total = counts.select(F.lit(0).alias("place"), F.format_string("%d symbols, %d edges, %d files", "symbols", "edges", "files").alias("said"), F.lit("").alias("language"))
        langs = self.symbols.groupBy("language").agg(F.count("*").alias("n")).select((-F.col("n")).alias("place"), F.format_string("%s: %d", "language", "n").alias("said"), "language")
        return Answer(total.unionByName(langs.withColumn("place", F.col("place") + (1 << 60))), F.col("said"), ["place", "language"])

    # --- 7 to 13: knowledge ----------------------------------------------------------------------------------

    def annotate_symbol(self, symbol: str, annotation_type: str, content: str) -> Answer:
        one = self.named(symbol).orderBy("id").limit(1)
        self.save("annotations", knowledge.annotate(self.annotations, self.symbols, symbol, annotation_type, content, self.now.cast("bigint")))
        self.track(one, "annotate")
        last = self.annotations.join(one.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").orderBy(F.desc("id")).limit(1)
        return Answer(last, F.format_string("note %d kept", "id"), ["id"], none=f"no symbol {symbol}")

    def _voted(self, one: int) -> Answer:
        return Answer(self.annotations.where(F.col("id") == one), F.format_string("note %d: %s, confidence %.2f", "id", "status", "confidence"), ["id"], none=f"no note {one}")

    def verify_annotation(self, annotation_id: int) -> Answer:
        self.save("annotations", knowledge.verify(self.annotations, [annotation_id]))
        return self._voted(annotation_id)

    def downvote_annotation(self, annotation_id: int) -> Answer:
        self.save("annotations", knowledge.downvote(self.annotations, [annotation_id]))
        return self._voted(annotation_id)

    def record_decision(self, symbols: str, description: str, rationale: str | None = None, alternatives: str | None = None) -> Answer:
        self.save("decisions", knowledge.record_decision(self.decisions, self.symbols, symbols, description, self.now.cast("bigint"), rationale, alternatives))
        return Answer(self.decisions.orderBy(F.desc("id")).limit(1), F.format_string("decision %d on %d symbols", "id", F.size("symbol_ids")), ["id"])

    def record_pattern(self, name: str, description: str, symbols: str = "") -> Answer:
        self.save("patterns", knowledge.record_pattern(self.patterns, self.symbols, name, description, self.now.cast("bigint"), symbols))
        return Answer(self.patterns.orderBy(F.desc("id")).limit(1), F.format_string("pattern %d on %d symbols", "id", F.size("trigger_symbol_ids")), ["id"])

    def get_insights(self, more_than: int = 10) -> Answer:
        found = knowledge.insights(self.calls(), more_than).unionByName(knowledge.contradiction_insights(self.spark, self.annotations))
        self.save("insights", knowledge.add_insights(self.insights, found, self.now.cast("bigint")))
        return Answer(knowledge.active_insights(self.insights), F.format_string("%d: %s, %s (%.0f%%)", "id", "insight_type", "content", F.col("confidence") * 100), [F.desc("confidence"), "id"], none="no active insights")

    def resolve_insight(self, insight_id: int, status: str = "resolved") -> Answer:
        self.save("insights", knowledge.resolve_insight(self.insights, insight_id, status))
        return Answer(self.insights.where(F.col("id") == insight_id), F.format_string("insight %d: %s", "id", "status"), ["id"], none=f"no insight {insight_id}")

    # --- 14 to 19: risk, context, exploration ------------------------------------------------------------------

    def get_risk_score(self, symbol: str) -> Answer:
        text = F.format_string("%s (%s): risk %.1f, %d callers, complexity %d, %d stale", "name", "file", "risk", "callers", "complexity", "stale")
        return Answer(self.risky().where(F.col("name") == symbol), text, ["file", "line_start", "id"], none=f"no symbol {symbol}")

    def get_codebase_report(self, k: int = 10) -> Answer:
        identity = self.get_project_identity()
        said = identity.rows.select(F.lit(0).alias("part"), F.col("place").cast("double").alias("place"), "language", identity.line.alias("said"))
        called = self.risky().where("callers > 0").orderBy(F.desc("callers"), "id").limit(k)
        called = called.select(F.lit(1).alias("part"), (-F.col("callers")).cast("double").alias("place"), F.col("id").alias("language"), F.concat(F.lit("called: "), self.at(), F.format_string(" %d callers, risk %.1f", "callers", "risk")).alias("said"))
        stale = self.risky().where("stale > 0").select(F.lit(2).alias("part"), (-F.col("stale")).cast("double").alias("place"), F.col("id").alias("language"), F.concat(F.lit("stale: "), self.at(), F.format_string(" %d", "stale")).alias("said"))
        return Answer(said.unionByName(called).unionByName(stale), F.col("said"), ["part", "place", "language"])

    def _context(self, seeds: DataFrame, tier: str) -> DataFrame:
        return context.tier(tier if tier in TIERS else "standard", self.risky(), self.calls(), self.annotations, self.sources, seeds)

    def get_context(self, symbol: str, tier: str = "standard") -> Answer:
        found = self._context(self.named(symbol).select("id"), tier).join(self.named(symbol).select("id", "file", "line_start"), "id")
        return Answer(found, F.col("text"), ["file", "line_start", "id"], none=f"no symbol {symbol}")

    def get_context_batch(self, symbols: str, budget: int, by_attention: bool = False) -> Answer:
        """Brief lines in the order of the names, then the standard tier for each, in order, while 100 tokens are left.

        An estimate is a quarter of the bytes; what does not fit is passed over."""
        asked = self.spark.createDataFrame(list(enumerate(dict.fromkeys(x.strip() for x in symbols.split(",") if x.strip()))), "pos long, name string")
        first = self.symbols.join(F.broadcast(asked), "name").groupBy("pos").agg(F.min("id").alias("id"))  # the caller's own list
        if by_attention:
            first = first.join(self.seen().select("id", "importance"), "id", "left").withColumn("pos", F.row_number().over(W.orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), "pos")).cast("bigint")).drop("importance")
        ids = first.select("id")
        both = self._context(ids, "brief").withColumnRenamed("text", "brief").join(self._context(ids, "standard").withColumnRenamed("text", "standard"), "id").join(first, "id")
        packed = both.agg(context.upgraded(F.collect_list(F.struct("pos", "id", "brief", "standard")), budget).alias("p"))
        rows = packed.select(F.explode("p.taken").alias("x")).select("x.pos", "x.id", "x.text")
        return Answer(rows, F.col("text"), ["pos"], none="nothing fits")

    def get_exploration_map(self) -> Answer:
        seen = self.seen().where("importance > 0")
        known = seen.join(self.symbols, "id").orderBy(F.desc("importance"), "id").limit(15)
        known = known.select(F.lit(0).alias("part"), (-F.col("importance")).alias("place"), "id", F.concat(F.lit("explored: "), self.at(), F.format_string(" %.1f", "importance")).alias("said"))
        blind = graph.unexplored(self.symbols, self.calls(), self.seen(), 3, 20)
        blind = blind.select(F.lit(1).alias("part"), (-F.col("callers")).cast("double").alias("place"), "id", F.concat(F.lit("blind: "), self.at(), F.format_string(" %d callers", "callers")).alias("said"))
        return Answer(known.unionByName(blind), F.col("said"), ["part", "place", "id"], none="nothing explored, no blind spots")

    def suggest_next(self, limit: int = 10) -> Answer:
        every = self.edges.select("from_id", "to_id")
        rows = graph.unexplored(self.symbols, every, self.seen(), -1, limit)
        return Answer(rows, F.concat(self.at(), F.format_string(" %d edges in", "callers")), [F.desc("callers"), "id"], none="all is explored")

    # --- 20 to 28: history, modules, clones, topics -----------------------------------------------------------

    def get_blame(self, file: str) -> Answer:
        rows = self.blame.where(F.col("file") == file).orderBy("line").limit(50)
        return Answer(rows, F.format_string("%d: %s %s %s", "line", F.substring("commit_hash", 1, 8), "author", X.day(F.col("at"))), ["line"], none=f"no blame of {file}")

    def get_ownership(self, file: str) -> Answer:
        """Stored owners, else those that the blamed lines tell."""
        stored = self.owners.where(F.col("file") == file)
        rows = evolution.ownership(self.blame.where(F.col("file") == file)) if stored.isEmpty() else stored.select("file", "author", "commits", "last_touched")
        return Answer(rows, F.format_string("%s: %d, last %s", "author", "commits", X.day(F.col("last_touched"))), [F.desc("commits"), "author"], none=f"no owners of {file}")

    def get_symbol_history(self, name: str, limit: int = 20) -> Answer:
        files = self.named(name).select("file").distinct()
        rows = self.commits.join(files, "file", "left_semi").orderBy(F.desc("timestamp"), "hash").limit(limit)
        return Answer(rows, F.format_string("%s %s %s: %s", F.substring("hash", 1, 8), X.day(F.col("timestamp")), "author", "message"), [F.desc("timestamp"), "hash"], none=f"no commits of {name}")

    def get_evolution(self, name: str) -> Answer:
        ids = self.named(name).select(F.col("id").alias("symbol_id"))
        changes = evolution.timeline(self.evolution.join(ids, "symbol_id", "left_semi")).select(F.lit(0).alias("part"), "place", F.concat_ws(" ", X.minute(F.col("timestamp")), "change_type", F.when(F.col("diff_summary") != "", F.col("diff_summary"))).alias("said"))
        notes = knowledge.notes_of(self.annotations, self.named(name))
        turn = F.row_number().over(W.orderBy(F.desc("created_at"), F.desc("id")))
        notes = notes.select(F.lit(1).alias("part"), turn.alias("place"), F.format_string("note %d: %s (%s)", "id", "content", "status").alias("said"))
        return Answer(changes.unionByName(notes), F.col("said"), ["part", "place"], none=f"no changes of {name}")

    def get_module_context(self, path: str) -> Answer:
        inside = self.risky().where(F.col("file").contains(path))
        members = graph.communities_or_files(self.symbols, self.calls())
        held = inside.join(members, "id", "left").groupBy("file").agg(F.count("*").alias("symbols"), F.max("risk").alias("risk"), F.count_distinct("community").alias("communities"))
        return Answer(held, F.format_string("%s: %d symbols, risk up to %.2f, %d communities", "file", "symbols", "risk", "communities"), ["file"], none=f"no files under {path}")

    def find_similar(self, name: str, k: int = 10, least: float = 0.8) -> Answer:
        one = self.named(name).orderBy("id").limit(1).select("id").first()
        vectors = self.embeddings.select(F.col("symbol_id").alias("id"), F.col("embedding").alias("v"))
        rows = clones.similar_to(self.symbols, vectors, one["id"] if one else None, least, k).join(self.symbols, "id")
        return Answer(rows, F.concat(self.at(), F.format_string(" %s %.4f", "clone_type", "score")), [F.desc("score"), "id"], none=f"nothing like {name}")

    def get_hot_path(self, k: int = 15) -> Answer:
        rows = self.risky().where("callers > 0").withColumn("heat", F.col("risk") * F.col("callers")).orderBy(F.desc("heat"), "id").limit(k)
        return Answer(rows, F.concat(self.at(), F.format_string(" %.1f", "heat")), [F.desc("heat"), "id"], none="no calls")

    def get_trace(self, name: str) -> Answer:
        found = graph.trace(self.calls(), self.named(name).select("id"), 2).groupBy("direction", "id").agg(F.min("depth").alias("depth")).join(self.symbols, "id")
        return Answer(found, F.concat(F.format_string("%s %d: ", "direction", "depth"), self.at()), ["direction", "depth", "file", "line_start", "id"], none=f"no trace of {name}")

    def get_topic_summary(self) -> Answer:
        return Answer(self.topics.groupBy("topic").agg(F.count("*").alias("n")), F.format_string("%s: %d", "topic", "n"), [F.desc("n"), "topic"], none="no topics")

    # --- the command line's questions --------------------------------------------------------------------------

    def context_for_file(self, path: str) -> Answer:
        """A file's rollup, its path given in whole, from its end, or longer than it is kept."""
        r = self.risky().where(X.suffix_either_way(F.col("file"), F.lit(path)))
        turn = F.row_number().over(W.partitionBy("file").orderBy("line_start", "id"))
        names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") <= 3, F.struct("turn", "name")))), lambda x: x["name"]), ", ")
        rows = r.withColumn("turn", turn).groupBy("file").agg(F.sum("callers").alias("callers"), F.max("risk").alias("risk"), F.sum("stale").alias("stale"), names.alias("names"))
        return Answer(rows, F.format_string("%s: %d callers, risk up to %.1f, %d stale, %s", "file", "callers", "risk", "stale", "names"), ["file"], none=f"no symbols in {path}")

    status, search = get_project_identity, search_semantic
