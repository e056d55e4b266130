"""Registered queries of the engine with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodegraph.functions import expressions as X
from lodegraph.operators import clones, context, evolution, graph, knowledge, search, structure
from lodegraph.sources import views as V

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


# --- SQL of the views -------------------------------------------------------------------------

CALLS = """SELECT DISTINCT from_id, to_id FROM (SELECT l_partkey AS from_id, l_quantity,
 lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS to_id
 FROM lineitem) WHERE l_quantity >= {least} AND from_id <> to_id"""
E48, E40 = CALLS.format(least=48), CALLS.format(least=40)
TEXT = """SELECT doc_id AS id, 'doc_' || doc_id AS name, 'module' AS kind, source AS file, lang AS language, text AS body, sha256(text) AS body_hash FROM documents"""
ATT = """SELECT user_id AS id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS queries,
 count(*) FILTER (event_type = 'purchase') AS annotations, max(ts) AS last_accessed FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id"""
NOTES = """SELECT p_partkey AS id, p_partkey AS symbol_id, 0.8::DOUBLE AS confidence, CASE WHEN p_partkey % 5 = 0 THEN 'stale' ELSE 'active' END AS status,
 CASE WHEN p_partkey % 2 = 0 THEN 'h' || p_partkey ELSE 'old' END AS full_hash_at FROM part WHERE p_partkey % 3 = 0"""
DEG = "SELECT to_id AS id, count(*) AS callers FROM e GROUP BY to_id"
WORDS = ("the", "and")
BM25 = r"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
 tf AS (SELECT id, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'and')) AS b FROM w),
 st AS (SELECT count(*) AS n, avg(dl) AS g, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf),
 sc AS (SELECT id, round(-(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / g))
  + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / g))), 6) AS score FROM tf, st WHERE a > 0 AND b > 0),
 bm AS (SELECT id, score, row_number() OVER (ORDER BY score, id) - 1 AS rank FROM sc ORDER BY score, id LIMIT {k})"""
COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
VEC = """q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
 vs AS (SELECT vec_id AS id, round(""" + COS.format(a="embedding", b="qv") + """, 6) AS score FROM embeddings, q),
 ve AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM vs ORDER BY score DESC, id LIMIT {k})"""
HOT = f"hot AS (SELECT id, (views + 2 * queries + 3 * annotations)::DOUBLE AS importance FROM ({ATT}) WHERE views + queries + annotations > 0 ORDER BY importance DESC, id LIMIT 30)"
PROX = """e AS (""" + E48 + """), """ + HOT + """,
 st1 AS (SELECT to_id AS at, from_id AS nxt, 'in' AS way FROM e UNION ALL SELECT from_id, to_id, 'out' FROM e),
 one AS (SELECT hot.id AS seed, importance, nxt, way FROM hot JOIN st1 ON hot.id = st1.at),
 two AS (SELECT seed, importance, st1.nxt, one.way FROM one JOIN st1 ON one.nxt = st1.at AND one.way = st1.way),
 al AS (SELECT seed, importance, nxt, 1 AS d FROM one UNION ALL SELECT seed, importance, nxt, 2 FROM two),
 px AS (SELECT nxt AS id, round(max(importance / (d + 1)), 6) AS score FROM al WHERE nxt <> seed GROUP BY nxt),
 pr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM px ORDER BY score DESC, id LIMIT {k})"""
REACH = """r AS (SELECT s.id AS seed, s.id AS id, 0 AS depth FROM seeds s UNION SELECT r.seed, e.{next}, r.depth + 1 FROM r JOIN e ON e.{at} = r.id WHERE r.depth < {depth})"""
V1 = """o AS (SELECT doc_id AS id, source AS file, 'doc_' || doc_id AS name, text AS body, doc_id AS pos, sha256(text) AS full_hash, sha256(text) AS body_hash FROM documents)"""
V2 = V1 + """, n0 AS (SELECT id, file, name, CASE WHEN id % 10 = 1 THEN body || ' edited' ELSE body END AS body, pos FROM o WHERE id % 10 <> 0
 UNION ALL SELECT id + 1000000000, file, name || '_new', body, id + 1000000000 FROM o WHERE id % 10 = 2),
 n AS (SELECT id, CASE WHEN file = 'src3' THEN 'src3_moved' ELSE file END AS file, name, body, pos, sha256(body) AS full_hash, sha256(body) AS body_hash FROM n0)"""
CH = """(SELECT file, sha256(string_agg(full_hash, '' ORDER BY pos, full_hash)) AS content_hash FROM {t} GROUP BY file)"""


# --- lookups and aggregates ---------------------------------------------------------------------

@query(f"""WITH e AS ({E48}) SELECT (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT p_brand) FROM part) AS files""")
def stats(spark, d):
    s = V.part_symbols(spark, d).agg(F.count("*").alias("symbols"), F.count_distinct("file").alias("files"))
    return s.crossJoin(V.calls(spark, d).agg(F.count("*").alias("edges"))).select("symbols", "edges", "files")  # one row each


@query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY lang")
def language_breakdown(spark, d):
    return V.text_symbols(spark, d).groupBy("language").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS file FROM part WHERE p_partkey = 7 OR p_name = (SELECT p_name FROM part WHERE p_partkey = 7)")
def symbol_lookup(spark, d):
    s = V.part_symbols(spark, d).select("id", "name", "kind", "file")
    return s.join(F.broadcast(s.where("id = 7").select("name").limit(1)), "name", "left_semi")


@query("SELECT p_partkey AS id, p_name AS name, p_type AS kind FROM part WHERE p_brand = 'Brand#11'")
def file_summary(spark, d):
    return V.part_symbols(spark, d).where(F.col("file") == "Brand#11").select("id", "name", "kind").orderBy("id")


@query("SELECT p_brand AS file, count(*) AS symbols, sum(p_size)::BIGINT AS complexity, max(p_size)::BIGINT AS most_complex FROM part WHERE contains(p_brand, '#1') GROUP BY p_brand")
def module_context(spark, d):
    s = V.part_symbols(spark, d).where(F.col("file").contains("#1"))
    return s.groupBy("file").agg(F.count("*").alias("symbols"), F.sum("complexity").alias("complexity"), F.max("complexity").alias("most_complex"))


@query("SELECT p_type AS topic, count(*) AS n FROM part GROUP BY p_type")
def topics(spark, d):
    return V.part_symbols(spark, d).groupBy(F.col("kind").alias("topic")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS ({TEXT}) SELECT id, sha256(file || ':' || name || ':' || kind) AS symbol_id, sha256(name || ':' || kind || ':' || body_hash) AS canonical_id,
 body_hash, sha256(name || ':' || body || ':') AS full_hash FROM s""")
def identity_hashes(spark, d):
    s = V.text_symbols(spark, d)
    return s.select("id", X.symbol_id(F.col("file"), F.col("name"), F.col("kind")).alias("symbol_id"), X.canonical_id(F.col("name"), F.col("kind"), F.col("body_hash")).alias("canonical_id"), "body_hash", X.full_hash(F.col("name"), F.col("body"), F.lit(None).cast("string")).alias("full_hash"))


@query(f"WITH {V1} SELECT * FROM {CH.format(t='o')}")
def content_hash(spark, d):
    return evolution.content_hash(V.versions(spark, d)[0])


@query(f"""WITH s AS ({TEXT}) SELECT id, sha256(CASE WHEN strlen(body) < 200 THEN name || ' ' || body ELSE name END) AS text_hash FROM s""")
def fts_document_text(spark, d):
    s = V.text_symbols(spark, d)
    return s.select("id", F.sha2(X.index_text(F.col("kind"), F.col("name"), F.col("body")), 256).alias("text_hash"))


@query(f"""WITH e AS ({E48}), c AS (SELECT to_id AS id, list(from_id::VARCHAR ORDER BY from_id) AS l FROM e GROUP BY 1), u AS (SELECT from_id AS id, list(to_id::VARCHAR ORDER BY to_id) AS l FROM e GROUP BY 1)
 SELECT p_partkey AS id, p_type || ' ' || p_name || ' in ' || p_brand || chr(10) || p_name || coalesce(chr(10) || 'called by: ' || array_to_string(c.l, ', '), '') || coalesce(chr(10) || 'uses: ' || array_to_string(u.l, ', '), '') AS text
 FROM part LEFT JOIN c ON c.id = p_partkey LEFT JOIN u ON u.id = p_partkey""")
def embedding_text(spark, d):
    e = V.calls(spark, d)
    near = lambda key, other, name: e.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(other)), lambda x: x.cast("string")).alias(name))
    s = V.part_symbols(spark, d).join(near("to_id", "from_id", "callers"), "id", "left").join(near("from_id", "to_id", "uses"), "id", "left")
    return s.select("id", X.embedding_text(F.col("kind"), F.col("name"), F.array("file", "name"), F.col("name"), F.lit(None).cast("string"), F.col("callers"), F.col("uses")).alias("text"))


@query(r"""SELECT doc_id AS id, ceil(strlen(text) / 4.0)::BIGINT AS tokens, length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g'))::BIGINT AS visible FROM documents""")
def token_estimate(spark, d):
    s = V.text_symbols(spark, d)
    return s.select("id", X.token_estimate(F.col("body")).alias("tokens"), X.visible_chars(F.col("body")).cast("bigint").alias("visible"))


# --- search -----------------------------------------------------------------------------------------

@query("WITH " + BM25.format(k=10) + " SELECT id, score, rank FROM bm")
def bm25_search(spark, d):
    return V.search_index(spark, d).search(list(WORDS), 10)


@query(r"""SELECT t AS term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents) GROUP BY t""")
def postings_summary(spark, d):
    return search.postings(V.table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _query_vector(spark, d) -> DataFrame:
    return V.table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


@query("WITH " + VEC.format(k=10) + " SELECT id, score, rank FROM ve")
def vector_topk(spark, d):
    return search.vector_top_k(V.table(spark, d, "embeddings"), _query_vector(spark, d), 10, "vec_id", "embedding")


@query("WITH " + PROX.format(k=30) + " SELECT id, score, rank FROM pr")
def graph_proximity(spark, d):
    return search.proximity(V.calls(spark, d), V.hot(spark, d, 30), 30)


RRF = """fu AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score FROM ({u}) GROUP BY id),
 fr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM fu ORDER BY score DESC, id LIMIT {k})"""


@query("WITH " + BM25.format(k=30) + ", " + VEC.format(k=30) + ", " + RRF.format(u="SELECT id, rank FROM bm UNION ALL SELECT id, rank FROM ve", k=10) + " SELECT id, score, rank FROM fr")
def rrf_fuse(spark, d):
    a = V.search_index(spark, d).search(list(WORDS), 30)
    b = search.vector_top_k(V.table(spark, d, "embeddings"), _query_vector(spark, d), 30, "vec_id", "embedding")
    return search.rrf([a, b], 10)


@query("WITH " + BM25.format(k=30) + ", " + VEC.format(k=30) + ", " + PROX.format(k=30) + ", " + RRF.format(u="SELECT id, rank FROM bm UNION ALL SELECT id, rank FROM ve UNION ALL SELECT id, rank FROM pr", k=10) + " SELECT id, score, rank FROM fr")
def hybrid_search(spark, d):
    a = V.search_index(spark, d).search(list(WORDS), 30)
    b = search.vector_top_k(V.table(spark, d, "embeddings"), _query_vector(spark, d), 30, "vec_id", "embedding")
    return search.rrf([a, b, graph_proximity(spark, d)], 10)


GOLD = """g AS (SELECT doc_id AS id, quality + toxic AS grade, 'q' AS query FROM labels)"""


def _metric_inputs(spark, d):
    found = V.search_index(spark, d).search(list(WORDS), 10).withColumn("query", F.lit("q"))
    gold = V.table(spark, d, "labels").select(F.lit("q").alias("query"), F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("grade"))
    return structure.metrics(found, gold, 10)


METRICS = "WITH " + BM25.format(k=10) + ", " + GOLD + """, h AS (SELECT max(1.0::DOUBLE / (rank + 1)) AS rr, count(*) AS hits, sum((2.0::DOUBLE ** grade - 1) / log2(rank + 2)) AS dcg FROM bm JOIN g USING (id) WHERE grade > 0),
 b AS (SELECT count(*) AS total, sum(CASE WHEN place < 10 THEN (2.0::DOUBLE ** grade - 1) / log2(place + 2) ELSE 0 END) AS ideal FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC, id) - 1 AS place FROM g WHERE grade > 0))
 SELECT 'q' AS query, """


@query(METRICS + "round(coalesce(rr, 0), 6) AS mrr FROM h, b")
def mrr(spark, d):
    return _metric_inputs(spark, d).select("query", "mrr")


@query(METRICS + "round(coalesce(hits / 10.0::DOUBLE, 0), 6) AS precision, round(coalesce(hits::DOUBLE / total, 0), 6) AS recall FROM h, b")
def precision_recall_at_k(spark, d):
    return _metric_inputs(spark, d).select("query", "precision", "recall")


@query(METRICS + "round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM h, b")
def ndcg(spark, d):
    return _metric_inputs(spark, d).select("query", "ndcg")


# --- graph -------------------------------------------------------------------------------------------

def _seeds(spark, d) -> DataFrame:
    return V.part_symbols(spark, d).select("id")


def _named(found, spark, d) -> DataFrame:
    """Ids with their symbols' names and files; ids of no symbol go."""
    return found.join(V.part_symbols(spark, d).select("id", "name", "file"), "id").select("seed", "id", "depth", "name", "file")


SEEDS = "seeds AS (SELECT p_partkey AS id FROM part)"
MINR = "SELECT seed, id, min(depth) AS depth, any_value(p_name) AS name, any_value(p_brand) AS file FROM r JOIN part ON p_partkey = id WHERE id <> seed GROUP BY seed, id"


@query(f"WITH RECURSIVE e AS ({E48}), {SEEDS}, {REACH.format(next='from_id', at='to_id', depth=3)} {MINR}")
def find_callers(spark, d):
    return _named(graph.reach(V.calls(spark, d), _seeds(spark, d), 3, True), spark, d)


@query(f"WITH RECURSIVE e AS ({E48}), {SEEDS}, {REACH.format(next='to_id', at='from_id', depth=3)} {MINR}")
def find_dependencies(spark, d):
    return _named(graph.reach(V.calls(spark, d), _seeds(spark, d), 3, False), spark, d)


@query(f"""WITH RECURSIVE e AS ({E48}), {SEEDS}, {REACH.format(next='from_id', at='to_id', depth=2)},
 {REACH.format(next='to_id', at='from_id', depth=2).replace('r AS', 'r2 AS').replace('r.', 'r2.').replace('FROM r JOIN', 'FROM r2 JOIN')}
 SELECT seed, id, min(depth) AS depth, 'caller' AS direction FROM r WHERE id <> seed GROUP BY seed, id
 UNION ALL SELECT seed, id, min(depth), 'dependency' FROM r2 WHERE id <> seed GROUP BY seed, id""")
def trace(spark, d):
    return graph.trace(V.calls(spark, d), _seeds(spark, d), 2)


@query(f"WITH e AS ({E48}) SELECT to_id AS id, from_id AS caller FROM e")
def direct_callers(spark, d):
    return V.calls(spark, d).select(F.col("to_id").alias("id"), F.col("from_id").alias("caller"))


@query(f"WITH e AS ({E40}) SELECT * FROM ({DEG}) WHERE callers > 10")
def god_nodes(spark, d):
    return knowledge.god_nodes(V.calls(spark, d, 40), 10)


@query(f"""WITH e AS ({E40}) SELECT 'god_node' AS insight_type, id AS symbol_id, 'symbol has ' || callers || ' callers' AS content, 0.7::DOUBLE AS confidence, 'active' AS status FROM ({DEG}) WHERE callers > 10""")
def insights(spark, d):
    return knowledge.insights(V.calls(spark, d, 40), 10)


RISK = f"""WITH e AS ({E48}), a AS ({NOTES}), s AS (SELECT symbol_id AS id, count(*) AS stale FROM a WHERE status = 'stale' GROUP BY 1),
 k AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_size::BIGINT AS complexity, coalesce(callers, 0) AS callers, coalesce(stale, 0) AS stale
 FROM part LEFT JOIN ({DEG}) c ON c.id = p_partkey LEFT JOIN s ON s.id = p_partkey), r AS (SELECT *, ((1 + complexity) * (1 + callers) * (1 + stale))::DOUBLE AS risk FROM k)"""


def _risk(spark, d):
    stale = V.part_annotations(spark, d).where("status = 'stale'")
    return graph.risk(V.part_symbols(spark, d), V.calls(spark, d), stale)


@query(RISK + " SELECT id, callers, stale, risk FROM r")
def risk_score(spark, d):
    return _risk(spark, d).select("id", "callers", "stale", "risk")


@query(RISK + " SELECT id, name, risk * callers AS heat FROM r WHERE callers > 0 ORDER BY heat DESC, id LIMIT 15")
def hot_path(spark, d):
    return _risk(spark, d).where("callers > 0").select("id", "name", (F.col("risk") * F.col("callers")).alias("heat")).orderBy(F.desc("heat"), "id").limit(15)


@query(RISK + " SELECT file, sum(callers)::BIGINT AS callers, max(risk) AS most_risk, sum(stale)::BIGINT AS stale, list_slice(list(name ORDER BY id), 1, 3) AS names FROM r GROUP BY file")
def file_rollup(spark, d):
    # the three first names of a file are found by a bounded aggregate, not by collecting the file
    r = _risk(spark, d)
    top = r.withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("id"))).where("n <= 3").groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("names"))
    return r.groupBy("file").agg(F.sum("callers").alias("callers"), F.max("risk").alias("most_risk"), F.sum("stale").alias("stale")).join(top, "file")


@query(RISK + " SELECT id, name, callers, stale FROM r ORDER BY callers DESC, id LIMIT 10")
def codebase_report(spark, d):
    return _risk(spark, d).select("id", "name", "callers", "stale").orderBy(F.desc("callers"), "id").limit(10)


@query(RISK + """, w AS (SELECT to_id, from_id, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS n FROM e),
 b AS (SELECT to_id AS id, string_agg(r.name, ', ' ORDER BY n) AS names FROM w JOIN r ON r.id = from_id WHERE n <= 5 GROUP BY to_id),
 t AS (SELECT symbol_id AS id, string_agg(printf('note %d: %s, %.2f', id, status, confidence), chr(10) ORDER BY id) AS notes FROM a GROUP BY symbol_id),
 h AS (SELECT r.id, printf('%s %s (%s:%d) risk %.1f', p_type, r.name, r.file, r.id, risk) || CASE WHEN r.stale > 0 THEN printf(' [%d stale]', r.stale) ELSE '' END AS brief FROM r JOIN part ON p_partkey = r.id)
 SELECT h.id, brief, concat_ws(chr(10), brief, 'called by: ' || names, notes) AS standard FROM h LEFT JOIN b USING (id) LEFT JOIN t USING (id)""")
def context_tiers(spark, d):
    s = _risk(spark, d).withColumn("line_start", F.col("id"))
    return context.standard(s, V.calls(spark, d), V.part_annotations(spark, d)).select("id", "brief", "standard")


UNSEEN = f"WITH e AS ({E40}), seen AS ({ATT}) SELECT p_partkey AS id, coalesce(callers, 0) AS callers FROM part LEFT JOIN ({DEG}) c ON c.id = p_partkey WHERE p_partkey NOT IN (SELECT id FROM seen) AND coalesce(callers, 0) > {{n}} ORDER BY callers DESC, id LIMIT {{k}}"


def _unseen(spark, d, n, k):
    seen = V.attention_events(spark, d).select("id").distinct()
    return graph.unexplored(V.part_symbols(spark, d).select("id"), V.calls(spark, d, 40), seen, n, k)


@query(UNSEEN.format(n=3, k=20))
def blind_spots(spark, d):
    return _unseen(spark, d, 3, 20)


@query(UNSEEN.format(n=-1, k=10))
def suggest_next(spark, d):
    return _unseen(spark, d, -1, 10)


@query()
def communities(spark, d):
    e = V.calls(spark, d)
    members = graph.communities(e)
    return graph.cohesion(members, e)


# --- attention, clones, notes -------------------------------------------------------------------------

@query(f"SELECT *, (views + 2 * queries + 3 * annotations)::DOUBLE AS importance FROM ({ATT})")
def attention_map(spark, d):
    return knowledge.attention(V.attention_events(spark, d))


@query(f"SELECT id, (views + 2 * queries + 3 * annotations)::DOUBLE AS importance FROM ({ATT}) ORDER BY importance DESC, id LIMIT 20")
def hot_symbols(spark, d):
    return knowledge.attention(V.attention_events(spark, d)).where("importance > 0").select("id", "importance").orderBy(F.desc("importance"), "id").limit(20)


@query(f"""WITH s AS ({TEXT}) SELECT body_hash, count(*) AS members, count(DISTINCT file) AS files, min(id) AS first_id FROM s GROUP BY body_hash HAVING count(DISTINCT file) > 1""")
def exact_clones(spark, d):
    return clones.exact_groups(V.text_symbols(spark, d))


@query(f"""WITH s AS ({TEXT}), f AS (SELECT body_hash, min(id) AS first_id, arg_min(file, id) AS ff FROM s GROUP BY body_hash) SELECT first_id, id FROM s JOIN f USING (body_hash) WHERE id > first_id AND file <> ff""")
def exact_clone_members(spark, d):
    return clones.exact_pairs(V.text_symbols(spark, d))


def _vectors(spark, d):
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("file"), F.col("embedding").alias("v"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(""" + COS.format(a="a.embedding", b="b.embedding") + """, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE round(""" + COS.format(a="a.embedding", b="b.embedding") + """, 6) >= 0.4""")
def near_clones(spark, d):
    return clones.near_pairs(_vectors(spark, d), 0.4)


@query("""WITH me AS (SELECT sha256(text) AS h, source AS f FROM documents WHERE doc_id = 11), ex AS (SELECT doc_id AS id, 1.0::DOUBLE AS score, 'Exact' AS clone_type FROM documents, me WHERE sha256(text) = h AND source <> f AND doc_id <> 11),
 q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 11), ne AS (SELECT vec_id AS id, round(""" + COS.format(a="embedding", b="qv") + """, 6) AS score, 'Near' AS clone_type FROM embeddings, q WHERE vec_id <> 11)
 SELECT * FROM (SELECT * FROM ex UNION ALL SELECT * FROM ne WHERE score >= 0.2 AND id NOT IN (SELECT id FROM ex)) ORDER BY score DESC, id LIMIT 10""")
def similar_to(spark, d):
    return clones.similar_to(V.text_symbols(spark, d), _vectors(spark, d), 11, 0.2, 10)


PAIRS = (("and", "by"), ("and", "der"))


@query("""WITH n AS (SELECT conv_id * 1000 + turn AS id, conv_id AS symbol_id, lower(text) AS t FROM conversations), p(n, first, second) AS (VALUES (0, 'and', 'by'), (1, 'and', 'der')),
 m AS (SELECT a.symbol_id, a.id AS a, b.id AS b, p.n, first, second FROM n a JOIN n b ON a.symbol_id = b.symbol_id AND a.id < b.id, p
 WHERE (contains(a.t, first) AND contains(b.t, second)) OR (contains(a.t, second) AND contains(b.t, first)))
 SELECT symbol_id, a, b, arg_min(first, n) AS first, arg_min(second, n) AS second FROM m GROUP BY symbol_id, a, b""")
def contradictions(spark, d):
    return knowledge.contradictions(spark, V.notes(spark, d), PAIRS)


def _cascade(spark, d):
    changed = V.part_hashes(spark, d).where("old_hash <> full_hash").select("id", "full_hash")
    return knowledge.cascade(V.calls(spark, d), V.part_annotations(spark, d), changed)


CASC = f"""WITH RECURSIVE e AS ({E48}), a AS ({NOTES}), seeds AS (SELECT p_partkey AS id FROM part WHERE p_size >= 40), {REACH.format(next='from_id', at='to_id', depth=5)},
 far AS (SELECT seed, id, min(depth) AS depth FROM r WHERE id <> seed GROUP BY seed, id), rd AS (SELECT *, 0.3::DOUBLE * 0.5::DOUBLE ** (depth - 1) AS reduction FROM far)"""


@query(CASC + """, l AS (SELECT id AS symbol_id, sum(reduction) AS loss FROM rd GROUP BY id),
 h AS (SELECT a.*, CASE WHEN s.id IS NULL THEN NULL ELSE 'h' || a.symbol_id END AS fh FROM a LEFT JOIN seeds s ON s.id = a.symbol_id),
 g AS (SELECT id, symbol_id, full_hash_at, CASE WHEN fh = full_hash_at AND status = 'stale' THEN 'revert_reactivation' WHEN fh <> full_hash_at AND status = 'active' THEN 'direct_staleness' END AS direct, confidence, status FROM h)
 SELECT g.id, symbol_id, round(greatest(0, CASE WHEN direct = 'revert_reactivation' THEN 1.0::DOUBLE ELSE confidence END - coalesce(loss, 0)), 6) AS confidence,
 CASE direct WHEN 'revert_reactivation' THEN 'active' WHEN 'direct_staleness' THEN 'stale' ELSE status END AS status, full_hash_at, direct FROM g LEFT JOIN l USING (symbol_id)""")
def cascade(spark, d):
    return _cascade(spark, d)[0]


@query(CASC + " SELECT seed AS trigger_symbol, a.symbol_id AS affected_symbol, a.id AS annotation_id, depth AS distance, round(reduction, 6) AS reduction FROM rd JOIN a ON a.symbol_id = rd.id")
def cascade_log(spark, d):
    return _cascade(spark, d)[1]


@query(f"""SELECT id, CASE WHEN id % 6 = 0 THEN 1.0::DOUBLE WHEN id % 9 = 0 THEN round(greatest(0, confidence - 0.2), 6) ELSE confidence END AS confidence, CASE WHEN id % 6 = 0 THEN 'active' ELSE status END AS status FROM ({NOTES})""")
def annotation_votes(spark, d):
    up = F.col("id") % 6 == 0
    after = knowledge.verify(knowledge.downvote(V.part_annotations(spark, d), ~up & (F.col("id") % 9 == 0)), up)
    return after.select("id", F.round("confidence", 6).alias("confidence"), "status")


# --- versions -------------------------------------------------------------------------------------------

@query(f"WITH {V2} SELECT n.id, n.body_hash FROM n LEFT JOIN o USING (id) WHERE o.id IS NULL OR o.body_hash <> n.body_hash")
def stale_embeddings(spark, d):
    old, new = V.versions(spark, d)
    return evolution.stale_embeddings(new, old.select(F.col("id").alias("symbol_id"), "body_hash"))


@query(f"""WITH {V2} SELECT coalesce(o.file, n.file) AS file, coalesce(o.name, n.name) AS name, o.full_hash AS old_full_hash, n.full_hash AS new_full_hash,
 CASE WHEN o.file IS NULL THEN 'created' WHEN n.file IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
 FROM o FULL JOIN n ON o.file = n.file AND o.name = n.name WHERE o.file IS NULL OR n.file IS NULL OR o.full_hash <> n.full_hash""")
def evolution_diff(spark, d):
    old, new = V.versions(spark, d)
    return evolution.diff(old, new).select("file", "name", "old_full_hash", "new_full_hash", "change_type")


@query(f"""WITH {V2}, g AS (SELECT DISTINCT file AS old_file, body_hash FROM o WHERE file NOT IN (SELECT file FROM n)), c AS (SELECT DISTINCT file AS new_file, body_hash FROM n WHERE file NOT IN (SELECT file FROM o)),
 m AS (SELECT old_file, new_file, count(*) AS matches FROM g JOIN c USING (body_hash) GROUP BY 1, 2), t AS (SELECT old_file, count(*) AS total FROM g GROUP BY 1)
 SELECT old_file, min(new_file) AS new_file, arg_min(matches, new_file) AS matches FROM m JOIN t USING (old_file) WHERE 2 * matches >= total GROUP BY old_file""")
def renames(spark, d):
    return evolution.renames(*V.versions(spark, d))


@query(f"WITH {V1} SELECT 'main' AS branch_name, id, full_hash FROM o")
def branch_snapshot(spark, d):
    return evolution.snapshot(V.versions(spark, d)[0], "main")


SYNC = f"""WITH {V2}, ho AS {CH.format(t='o')}, hn AS {CH.format(t='n')}, ch AS (SELECT hn.file FROM hn LEFT JOIN ho USING (file) WHERE ho.file IS NULL OR ho.content_hash <> hn.content_hash)"""


@query(SYNC + " SELECT id, file, full_hash FROM o WHERE file NOT IN (SELECT file FROM ch) UNION ALL SELECT id, file, full_hash FROM n WHERE file IN (SELECT file FROM ch)")
def incremental_sync(spark, d):
    old, new = V.versions(spark, d)
    return evolution.sync(old, new, evolution.content_hash(old))[0].select("id", "file", "full_hash")


@query(f"WITH {V2} SELECT id, file FROM o WHERE file IN (SELECT file FROM n)")
def gc_files(spark, d):
    old, new = V.versions(spark, d)
    return evolution.collect_garbage(old, new).select("id", "file")


@query("SELECT o_orderpriority AS file, o_custkey AS author, count(*) AS commits, max(o_orderdate) AS last_touched FROM orders GROUP BY 1, 2")
def ownership(spark, d):
    return evolution.ownership(V.commits(spark, d))


@query("""SELECT file, author, committed_at, hash FROM (SELECT o_orderpriority AS file, o_custkey AS author, o_orderdate AS committed_at, o_orderkey AS hash,
 row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 50""")
def file_history(spark, d):
    return evolution.history(V.commits(spark, d), 50).select("file", "author", F.col("at").alias("committed_at"), "hash")


@query("SELECT o_custkey AS author, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS hash FROM orders GROUP BY 1")
def latest_hash(spark, d):
    rows = V.commits(spark, d).withColumn("at", F.struct("at", "hash"))
    return evolution.latest(rows, "author", "at", "hash")


# --- structure ---------------------------------------------------------------------------------------------

SPANS = """sp AS (SELECT conv_id AS file, turn AS id, turn AS pos, (turn % 4) * 10 AS line_start, (turn % 4) * 10 + 40 - (turn % 7) * 5 AS line_end FROM conversations)"""
PARENT = """pa AS (SELECT file, id, arg_min(pid, (w, ppos)) AS parent_id FROM (SELECT s.file, s.id, p.id AS pid, p.line_end - p.line_start AS w, p.pos AS ppos FROM sp s JOIN sp p ON s.file = p.file AND p.id <> s.id
 AND p.line_start <= s.line_start AND p.line_end >= s.line_end AND NOT (p.line_start = s.line_start AND p.line_end = s.line_end AND p.pos > s.pos)) GROUP BY file, id),
 pp AS (SELECT sp.file, sp.id, parent_id FROM sp LEFT JOIN pa USING (file, id))"""


def _spans(spark, d):
    t = F.col("turn")
    c = V.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("file"), t.alias("id"), t.alias("pos"), ((t % 4) * 10).alias("line_start"), ((t % 4) * 10 + 40 - (t % 7) * 5).alias("line_end"))


@query(f"WITH {SPANS}, {PARENT} SELECT file, id, parent_id FROM pp")
def scope_parent(spark, d):
    return structure.scope_parents(_spans(spark, d))


@query(f"""WITH RECURSIVE {SPANS}, {PARENT}, ch AS (SELECT file, id, [id] AS chain, parent_id AS nxt FROM pp UNION ALL SELECT ch.file, ch.id, list_prepend(ch.nxt, ch.chain), pp.parent_id FROM ch JOIN pp ON pp.file = ch.file AND pp.id = ch.nxt WHERE len(chain) < 9)
 SELECT file, id, arg_max(chain, len(chain)) AS chain FROM ch GROUP BY file, id""")
def scope_chain(spark, d):
    return structure.scope_chains(structure.scope_parents(_spans(spark, d)))


MD = r"""tx AS (SELECT page_id AS file, regexp_replace(html, '<h[12][^>]*>', chr(10) || '# ', 'g') AS text FROM pages), li AS (SELECT file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM tx),
 hd AS (SELECT *, regexp_extract(trim(line, ' '), '^(#{1,6})\s*([^#\s].*)$', 2) AS title FROM li), se AS (SELECT *, sum((title <> '')::INT) OVER (PARTITION BY file ORDER BY pos) AS section FROM hd)"""


@query("WITH " + MD + " SELECT file, section::BIGINT AS section, arg_min(title, pos) AS title, min(pos) + 1 AS line_start, max(pos) + 1 AS line_end, sha256(substring(string_agg(line, chr(10) ORDER BY pos), 1, 500)) AS doc_hash FROM se WHERE section > 0 GROUP BY file, section")
def markdown_sections(spark, d):
    p = V.table(spark, d, "pages").select(F.col("page_id").alias("file"), F.regexp_replace("html", "<h[12][^>]*>", "\n# ").alias("text"))
    s = structure.sections(p)
    return s.select("file", "section", "title", F.col("line_start").cast("bigint").alias("line_start"), F.col("line_end").cast("bigint").alias("line_end"), F.sha2("docstring", 256).alias("doc_hash"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 m AS (SELECT *, length(regexp_replace(line, '\s', '', 'g')) AS nws, (regexp_replace(line, '\s', '', 'g') = '' OR regexp_matches(line, '[;{}:]\s*$') OR NOT (starts_with(line, '    ') OR starts_with(line, chr(9)))) AS fit FROM l),
 r AS (SELECT id, i, nws AS n, 0 AS k, nws >= 500 AND fit AS done FROM m WHERE i = 0 UNION ALL
 SELECT m.id, m.i, CASE WHEN r.done THEN 0 ELSE r.n END + m.nws, r.k + r.done::INT, CASE WHEN r.done THEN 0 ELSE r.n END + m.nws >= 500 AND fit FROM r JOIN m ON m.id = r.id AND m.i = r.i + 1),
 g AS (SELECT id, k, string_agg(line, chr(10) ORDER BY i) AS content, min(i) + 1 AS a, max(i) + 1 AS b, sum(nws)::BIGINT AS nws FROM r JOIN m USING (id, i) GROUP BY id, k)
 SELECT id, k::INT AS chunk_index, content, a::INT AS line_start, b::INT AS line_end, nws AS nws_count, ceil(strlen(content) / 4.0)::BIGINT AS token_count FROM g WHERE id IN (SELECT id FROM g GROUP BY id HAVING count(*) > 1 AND sum(nws) > 500)""")
def chunks(spark, d):
    return structure.chunks(V.text_symbols(spark, d).select("id", "body", F.lit(1).alias("line_start")))


@query("""WITH RECURSIVE s AS (SELECT source AS file, doc_id, floor(strlen(text) / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
 f AS (SELECT DISTINCT file, 0::BIGINT AS n, 0::BIGINT AS used, []::BIGINT[] AS ids FROM s UNION ALL SELECT f.file, s.n, CASE WHEN used + tokens <= 4000 THEN used + tokens ELSE used END,
 CASE WHEN used + tokens <= 4000 THEN list_append(ids, doc_id) ELSE ids END FROM f JOIN s ON s.file = f.file AND s.n = f.n + 1) SELECT file, arg_max(used, n) AS used, arg_max(ids, n) AS ids FROM f GROUP BY file""")
def context_batch(spark, d):
    s = V.text_symbols(spark, d).select("file", F.struct(F.col("id").alias("pos"), "id", (F.octet_length("body") / 4).cast("bigint").alias("tokens")).alias("x"))
    got = s.groupBy("file").agg(structure.packed(F.collect_list("x"), 4000).alias("p"))
    return got.select("file", F.col("p.used").alias("used"), F.col("p.ids").alias("ids"))


@query("""SELECT min(ts) AS first_at, max(ts) AS last_at, count(*) AS changes, count(DISTINCT user_id) AS paths FROM
 (SELECT ts, user_id, sum(gap) OVER (ORDER BY ts, event_id) AS s FROM (SELECT ts, user_id, event_id, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) < INTERVAL 300 SECOND THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY s""")
def debounce_batches(spark, d):
    from lodegraph.streaming.watch import batches

    ev = V.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("path"))
    return batches(ev, "300 seconds").select(F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "changes", "paths")


#: A file of each language for each part, and the symbols that it holds (name, kind, lines).
SNIPPETS = {
    "py": ("python", "class C{n}:\n    def run(self):\n        return helper()\n\ndef helper():\n    return 1\n", [("C{n}", "class", 1, 3), ("run", "function", 2, 3), ("helper", "function", 5, 6)]),
    "rs": ("rust", "/// Doc\npub struct S{n} {\n    a: u32,\n}\n\nfn go() {\n    help()\n}\n\nfn help() {}\n", [("S{n}", "struct", 2, 4), ("go", "function", 6, 8), ("help", "function", 10, 10)]),
    "go": ("go", "package p\n\ntype T{n} struct {\n\ta int\n}\n\nfunc (t T{n}) Run() int {\n\treturn t.a\n}\n", [("p", "module", 1, 1), ("T{n}", "type_alias", 3, 5), ("Run", "method", 7, 9)]),
    "java": ("java", "class A{n} {\n    A{n}() {\n        go();\n    }\n\n    int go() {\n        return 1;\n    }\n}\n", [("A{n}", "class", 1, 9), ("A{n}", "function", 2, 4), ("go", "method", 6, 8)]),
    "rb": ("ruby", "module M{n}\n  def self.run(a)\n    a\n  end\nend\n", [("M{n}", "module", 1, 5), ("run", "function", 2, 4)]),
    "c": ("c", "struct S{n} {\n    int x;\n};\n\nint get(int a) {\n    return a;\n}\n", [("S{n}", "struct", 1, 3), ("get", "function", 5, 7)]),
    "cpp": ("cpp", "class A{n} {\n    A{n}(int x) {}\n};\n\nint run() {\n    return 1;\n}\n", [("A{n}", "class", 1, 3), ("A{n}", "function", 2, 2), ("run", "function", 5, 7)]),
    "ts": ("typescript", "interface I{n} {\n  a: string;\n}\n\nexport const f = async (p: string) => {\n  return p;\n};\n", [("I{n}", "interface", 1, 3), ("f", "variable", 5, 7)]),
    "js": ("javascript", "class B{n} {\n  run() {\n    return 1;\n  }\n}\n", [("B{n}", "class", 1, 5), ("run", "method", 2, 4)]),
}
HELD = ", ".join(f"('{ext}', '{name}', '{kind}', {a}, {b})" for ext, (_, _, held) in SNIPPETS.items() for name, kind, a, b in held)


@query(f"""SELECT p_brand || '/part' || p_partkey || '.' || ext AS file, replace(name, '{{n}}', p_partkey::VARCHAR) AS name, kind, a::INT AS line_start, b::INT AS line_end FROM part, (VALUES {HELD}) v(ext, name, kind, a, b)""")
def parse_symbols(spark, d):
    from lodegraph.sources.parse import parse

    texts = spark.createDataFrame([(ext, lang, text) for ext, (lang, text, _) in SNIPPETS.items()], "ext string, language string, template string")  # nine rows
    rows = V.part_symbols(spark, d).crossJoin(F.broadcast(texts)).select(F.concat("file", F.lit("/part"), F.col("id").cast("string"), F.lit("."), "ext").alias("path"), "language", F.replace("template", F.lit("{n}"), F.col("id").cast("string")).alias("content"))
    return parse(rows, ("file", "name", "kind", "line_start", "line_end")).select("file", "name", "kind", "line_start", "line_end")


# --- lookups in order, notes, topics, owners ---------------------------------------------------------------

@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY p_brand, p_partkey) AS place FROM part")
def all_symbols(spark, d):
    s = V.part_symbols(spark, d).withColumn("line_start", F.col("id"))
    # places through all symbols: rows before each file from the files' counts, places within a file from its window
    n = s.groupBy("file").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(W.partitionBy("file").orderBy("line_start", "id"))
    return s.withColumn("inner", inner).join(F.broadcast(n.select("file", "ahead")), "file").select("id", (F.col("ahead") + F.col("inner")).alias("place"))


@query("SELECT p_partkey AS id, p_brand AS file FROM part WHERE ends_with(p_brand, 'src/Brand#13') OR ends_with('src/Brand#13', p_brand)")
def files_by_suffix(spark, d):
    return V.part_symbols(spark, d).where(X.suffix_either_way(F.col("file"), F.lit("src/Brand#13"))).select("id", "file")


@query("SELECT conv_id * 1000 + turn AS id, conv_id AS symbol_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, conv_id * 1000 + turn DESC) AS place FROM conversations")
def symbol_notes(spark, d):
    n = V.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("symbol_id"), F.col("turn").alias("created_at"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("symbol_id").orderBy(F.desc("created_at"), F.desc("id")))).select("id", "symbol_id", "place")


@query(f"SELECT id, full_hash_at FROM ({NOTES})")
def annotation_hashes(spark, d):
    return V.part_annotations(spark, d).select("id", "full_hash_at")


@query("SELECT p_partkey AS symbol_id FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def topic_symbols(spark, d):
    s = V.part_symbols(spark, d)
    first = s.agg(F.min("kind").alias("kind"))
    return s.join(F.broadcast(first), "kind", "left_semi").select(F.col("id").alias("symbol_id"))


@query("""SELECT author, commits, row_number() OVER (ORDER BY commits DESC, author) AS place FROM (SELECT o_custkey AS author, count(*) AS commits FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ORDER BY place LIMIT 50""")
def file_owners(spark, d):
    own = evolution.ownership(V.commits(spark, d).where("file = '1-URGENT'")).orderBy(F.desc("commits"), "author").limit(50)
    return own.withColumn("place", F.row_number().over(W.orderBy(F.desc("commits"), "author"))).select("author", "commits", "place")


@query("""SELECT user_id AS symbol_id, event_id AS id, coalesce(props, '') AS diff_summary, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events""")
def evolution_timeline(spark, d):
    ev = V.table(spark, d, "events").select(F.col("user_id").alias("symbol_id"), F.col("event_id").alias("id"), "ts", F.col("props").alias("diff_summary"))
    return evolution.timeline(ev.withColumnRenamed("ts", "timestamp")).select("symbol_id", "id", "diff_summary", "place")


@query("WITH " + BM25.format(k=5) + ", ex AS (SELECT doc_id AS id FROM documents WHERE 'doc_' || doc_id = 'doc_7') SELECT id, 'exact' AS found FROM ex UNION ALL SELECT id, 'search' FROM bm")
def exact_or_search(spark, d):
    s, index = V.text_symbols(spark, d), V.search_index(spark, d)
    return search.lookup(s, index, "doc_7").unionByName(search.lookup(s, index, " ".join(WORDS))).select("id", "found")


@query("WITH " + BM25.format(k=10) + ", " + VEC.format(k=30) + ", " + BM25.format(k=30)[BM25.format(k=30).index("bm AS"):].replace("bm AS", "b3 AS") + ", " + RRF.format(u="SELECT id, rank FROM b3 UNION ALL SELECT id, rank FROM ve", k=10)
       + " SELECT id, score, rank, 'bm25' AS found FROM bm UNION ALL SELECT id, score, rank, 'hybrid' FROM fr")
def search_fallback(spark, d):
    index, vectors, text = V.search_index(spark, d), V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), " ".join(WORDS)
    plain = search.search_or_fall_back(index, text, 10)
    return plain.unionByName(search.search_or_fall_back(index, text, 10, vectors, _query_vector(spark, d))).select("id", "score", "rank", "found")


# --- knowledge that is kept ----------------------------------------------------------------------------------

@query(f"""WITH a AS ({NOTES}), l AS (SELECT max(id) AS m FROM a) SELECT id, symbol_id, confidence, CASE WHEN id = 3 THEN 'stale' ELSE status END AS status FROM
 (SELECT id, symbol_id, CASE WHEN id = 6 THEN 0.25::DOUBLE ELSE confidence END AS confidence, status FROM a UNION ALL
 SELECT m + 1, (SELECT min(p_partkey) FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 7)), 0.8, 'active' FROM l)""")
def annotation_life(spark, d):
    a = V.part_annotations(spark, d).withColumns({"annotation_type": F.lit("note"), "content": F.lit("c"), "author": F.lit("agent"), "created_at": F.lit(0).cast("bigint"), "updated_at": F.lit(0).cast("bigint")})
    s = V.part_symbols(spark, d).withColumn("full_hash", F.lit("h"))
    name = s.where("id = 7").first()["name"]
    a = knowledge.annotate(a, s, name, "note", "new", F.lit(1).cast("bigint"))
    return knowledge.set_status(knowledge.set_confidence(a, [6], 0.25), [3], "stale").select("id", "symbol_id", "confidence", "status")


@query("""WITH n AS (SELECT DISTINCT p_name FROM part WHERE p_partkey IN (7, 11)) SELECT 1::BIGINT AS id, list(p_partkey ORDER BY p_partkey) AS symbol_ids, 'decision' AS kind FROM part WHERE p_name IN (SELECT p_name FROM n)
 UNION ALL SELECT 1, list(p_partkey ORDER BY p_partkey), 'pattern' FROM part WHERE p_name IN (SELECT p_name FROM n)""")
def decisions_and_patterns(spark, d):
    s = V.part_symbols(spark, d)
    csv = ", ".join(r["name"] for r in s.where("id in (7, 11)").select("name").distinct().collect())
    empty = lambda cols: spark.createDataFrame([], cols)
    now = F.lit(1).cast("bigint")
    one = knowledge.record_decision(empty("id bigint, symbol_ids array<bigint>, description string, rationale string, alternatives string, confidence double, created_at bigint"), s, csv, "why", now)
    two = knowledge.record_pattern(empty("id bigint, name string, description string, trigger_symbol_ids array<bigint>, evidence string, confidence double, created_at bigint"), s, "p", "what", now, csv + ", ,")
    return one.select("id", "symbol_ids", F.lit("decision").alias("kind")).unionByName(two.select("id", F.col("trigger_symbol_ids").alias("symbol_ids"), F.lit("pattern").alias("kind")))


@query(f"""WITH e AS ({E40}), g AS (SELECT id AS symbol_id, 'symbol has ' || callers || ' callers' AS content, row_number() OVER (ORDER BY id) AS id FROM ({DEG}) WHERE callers > 10)
 SELECT id, [symbol_id] AS symbol_ids, content FROM g WHERE id <> 1""")
def stored_insights(spark, d):
    empty = spark.createDataFrame([], "id bigint, insight_type string, content string, symbol_ids array<bigint>, confidence double, status string, created_at bigint")
    found = knowledge.insights(V.calls(spark, d, 40), 10)
    once = knowledge.add_insights(empty, found, F.lit(1).cast("bigint"))
    again = knowledge.add_insights(once, found, F.lit(2).cast("bigint"))  # known ones are not added again
    return knowledge.active_insights(knowledge.resolve_insight(again, 1, "dismissed")).select("id", "symbol_ids", "content")


@query("SELECT DISTINCT p_type AS topic, p_partkey AS symbol_id FROM part UNION SELECT 'named', p_partkey FROM part WHERE p_size > 25")
def topics_added(spark, d):
    s = V.part_symbols(spark, d)
    t = s.select(F.col("kind").alias("topic"), F.col("id").alias("symbol_id"))
    new = s.where("complexity > 25").select(F.lit("named").alias("topic"), F.col("id").alias("symbol_id"))
    return knowledge.add_topic(knowledge.add_topic(t, new), new)


PAIRS_SQL = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(knowledge.OPPOSED))


@query(f"""WITH n AS (SELECT conv_id * 1000 + turn AS id, conv_id AS symbol_id, text || CASE turn % 4 WHEN 0 THEN ' must' WHEN 1 THEN ' should not be public' WHEN 2 THEN ' is private, Always unsafe' ELSE '' END AS content,
 CASE WHEN turn % 5 = 4 THEN 'stale' ELSE 'active' END AS status FROM conversations), t AS (SELECT *, lower(content) AS t FROM n WHERE status = 'active'), p(n, first, second) AS (VALUES {PAIRS_SQL}),
 m AS (SELECT a.symbol_id, a.id AS a, b.id AS b, p.n, first, second, a.content AS ca, b.content AS cb FROM t a JOIN t b ON a.symbol_id = b.symbol_id AND a.id < b.id, p WHERE (contains(a.t, first) AND contains(b.t, second)) OR (contains(a.t, second) AND contains(b.t, first))),
 g AS (SELECT symbol_id, a, b, arg_min(first, n) AS first, arg_min(second, n) AS second, min(ca) AS ca, min(cb) AS cb FROM m GROUP BY symbol_id, a, b)
 SELECT 'contradiction' AS insight_type, symbol_id, printf('''%s'' vs ''%s'': %s / %s', first, second, CASE WHEN length(ca) > 50 THEN ca[:50] || '...' ELSE ca END, CASE WHEN length(cb) > 50 THEN cb[:50] || '...' ELSE cb END) AS content, 0.7::DOUBLE AS confidence, 'active' AS status FROM g""")
def contradiction_insights(spark, d):
    said = F.when(F.col("turn") % 4 == 0, " must").when(F.col("turn") % 4 == 1, " should not be public").when(F.col("turn") % 4 == 2, " is private, Always unsafe").otherwise("")
    n = V.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("symbol_id"), F.concat("text", said).alias("content"), F.when(F.col("turn") % 5 == 4, "stale").otherwise("active").alias("status"))
    return knowledge.contradiction_insights(spark, n)


@query(f"""WITH e AS ({E40}), seen AS ({ATT}), x AS (SELECT p_partkey AS id, 'explored' AS part, (views + 2 * queries + 3 * annotations)::DOUBLE AS importance FROM seen JOIN part ON p_partkey = seen.id)
 SELECT id, part, importance FROM (SELECT * FROM x WHERE importance > 0 ORDER BY importance DESC, id LIMIT 15) UNION ALL
 SELECT id, 'blind', callers::DOUBLE FROM (SELECT p_partkey AS id, coalesce(callers, 0) AS callers FROM part LEFT JOIN ({DEG}) c ON c.id = p_partkey WHERE p_partkey NOT IN (SELECT id FROM seen) AND coalesce(callers, 0) > 3 ORDER BY callers DESC, id LIMIT 20)""")
def exploration_map(spark, d):
    s = V.part_symbols(spark, d).select("id")
    seen = knowledge.attention(V.attention_events(spark, d)).where("importance > 0")
    known = seen.join(s, "id").orderBy(F.desc("importance"), "id").limit(15).select("id", F.lit("explored").alias("part"), "importance")
    return known.unionByName(_unseen(spark, d, 3, 20).select("id", F.lit("blind").alias("part"), F.col("callers").cast("double").alias("importance")))


# --- communities, history, sources ---------------------------------------------------------------------------

@query("SELECT p_partkey AS id, p_brand AS community FROM part")
def file_communities(spark, d):
    s = V.part_symbols(spark, d)
    return graph.communities_or_files(s, V.calls(spark, d).where("from_id = to_id"))


@query("""WITH m AS (SELECT p_partkey AS id, p_size AS community, p_brand AS file FROM part WHERE p_size < 40 OR p_brand < 'Brand#2'), f AS (SELECT community, file, count(*) AS n FROM m GROUP BY 1, 2),
 e AS (SELECT community, min(file) AS a, max(file) AS b, arg_min(file, (-n, file)) AS usual FROM f GROUP BY 1),
 p AS (SELECT community, usual, a[:coalesce(list_max(list_filter(range(0, length(a)::BIGINT + 1), lambda k: a[:k] = b[:k])), 0)] AS pre FROM e)
 SELECT community, CASE WHEN strlen(pre) > 2 THEN regexp_replace(pre, '/+$', '') ELSE usual END AS label FROM p""")
def community_labels(spark, d):
    s = V.part_symbols(spark, d)
    return graph.labels(s.where("complexity < 40 or file < 'Brand#2'").select("id", F.col("complexity").cast("int").alias("community")), s)


@query(f"""WITH {V2}, g AS (SELECT DISTINCT file AS old_file, body_hash FROM o WHERE file NOT IN (SELECT file FROM n)), c AS (SELECT DISTINCT file AS new_file, body_hash FROM n WHERE file NOT IN (SELECT file FROM o)),
 m AS (SELECT old_file, new_file, count(*) AS matches FROM g JOIN c USING (body_hash) GROUP BY 1, 2), t AS (SELECT old_file, count(*) AS total FROM g GROUP BY 1),
 r AS (SELECT old_file, min(new_file) AS new_file FROM m JOIN t USING (old_file) WHERE 2 * matches >= total GROUP BY old_file)
 SELECT o.id AS symbol_id, old_file, new_file, 'moved' AS change_type FROM r JOIN o ON o.file = old_file WHERE o.body_hash IN (SELECT n.body_hash FROM n WHERE n.file = new_file)""")
def moved_symbols(spark, d):
    return evolution.moves(*V.versions(spark, d)).select("symbol_id", "old_file", "new_file", "change_type")


@query("""SELECT author, hash FROM (SELECT o_custkey AS author, o_orderkey AS hash, o_orderstatus AS s, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS NULL OR p <> s""")
def touching_commits(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("content_hash"))
    return evolution.touching(o).select(F.col("file").alias("author"), "hash")


@query(r"""WITH l AS (SELECT page_id AS file, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS n FROM pages)
 SELECT file, n::INT AS line_number, printf('%4d | %s', n, rtrim(line, chr(13))) AS text FROM l WHERE n BETWEEN 2 AND 4 AND NOT (line = '' AND n = (SELECT max(x.n) FROM l x WHERE x.file = l.file))""")
def source_slices(spark, d):
    p = V.table(spark, d, "pages").select(F.col("page_id").alias("file"), F.col("html").alias("content"), F.lit(2).alias("line_start"), F.lit(4).alias("line_end"))
    return context.numbered(p).select("file", "line_number", "text")


@query(r"""SELECT doc_id AS id, starts_with(text, 'T') AS starts, ends_with(text, '.') AS ends, length(rtrim(text)) AS trimmed, instr(text, 'e')::INT AS at, regexp_replace(source, '\d$', '') AS stripped,
 len(list_filter(list_transform(string_split(text[:200], ','), lambda x: trim(x, ' ')), lambda x: x <> '')) AS parts, length(regexp_extract(source || '/x.tar.gz', '\.([^./]+)$', 1)) AS ext,
 strftime(make_timestamp(doc_id * 1000000 * 86399), '%Y-%m-%d') AS day, strftime(make_timestamp(doc_id * 1000000 * 86399), '%Y-%m-%d %H:%M') AS minute,
 '["' || lang || '","' || source || '"]' AS encoded, source AS decoded FROM documents""")
def scalar_functions(spark, d):
    t, src = F.col("text"), F.col("source")
    coded = F.to_json(F.array("lang", "source"))
    return V.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), t.startswith("T").alias("starts"), t.endswith(".").alias("ends"), F.length(F.rtrim(t)).cast("bigint").alias("trimmed"), F.locate("e", t).alias("at"),
        F.regexp_replace(src, r"\d$", "").alias("stripped"), F.size(X.names_of(F.substring(t, 1, 200))).cast("bigint").alias("parts"), F.length(X.extension(F.concat(src, F.lit("/x.tar.gz")))).cast("bigint").alias("ext"),
        X.day(F.col("doc_id") * 86399).alias("day"), X.minute(F.col("doc_id") * 86399).alias("minute"), coded.alias("encoded"), F.element_at(F.from_json(coded, "array<string>"), 2).alias("decoded"),
    )


@query("WITH " + BM25.format(k=10) + """, g AS (SELECT doc_id AS id, lang AS query_type FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT query_type, count(*) AS hits FROM bm JOIN g USING (id) GROUP BY 1""")
def hits_by_type(spark, d):
    found = V.search_index(spark, d).search(list(WORDS), 10)
    gold = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("lang").alias("query_type"))
    return found.join(gold, "id").groupBy("query_type").agg(F.count("*").alias("hits"))
