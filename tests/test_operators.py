"""Hand-computed cases of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import evolution, graph, knowledge, search, structure
from lodegraph.sources.parse import edges, parse


def test_rrf_places(spark):
    a = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, rank int")
    b = spark.createDataFrame([("b", 0), ("c", 1), ("a", 2)], "id string, rank int")
    assert [r.id for r in search.rrf([a, b], 3).orderBy("rank").collect()] == ["b", "a", "c"]


def test_reach_has_least_depths_on_random_graphs(spark):
    rng = random.Random(4)
    e = {(rng.randrange(12), rng.randrange(12)) for _ in range(30)}
    df = spark.createDataFrame([x for x in e if x[0] != x[1]], "from_id bigint, to_id bigint")
    got = {(r.id, r.depth) for r in graph.reach(df, spark.createDataFrame([(0,)], "id bigint"), 4, True).collect()}
    seen, front, want = {0}, {0}, set()
    for d in range(1, 5):
        front = {a for a, b in e if b in front and a != b} - seen
        seen |= front
        want |= {(x, d) for x in front}
    assert got == want


def test_cascade_chain(spark):
    e = spark.createDataFrame([(2, 1), (3, 2)], "from_id bigint, to_id bigint")
    notes = spark.createDataFrame([(i, i, 0.8, "active", f"h{i}") for i in (1, 2, 3)], "id bigint, symbol_id bigint, confidence double, status string, full_hash_at string")
    after, log = knowledge.cascade(e, notes, spark.createDataFrame([(1, "new")], "id bigint, full_hash string"))
    got = {r.id: (r.confidence, r.status) for r in after.collect()}
    assert got == {1: (0.8, "stale"), 2: (0.5, "active"), 3: (0.65, "active")}
    assert {(r.affected_symbol, r.distance) for r in log.collect()} == {(2, 1), (3, 2)}


def test_contradiction_takes_the_first_pair(spark):
    notes = spark.createDataFrame([(1, 7, "it always returns true"), (2, 7, "it sometimes returns false")], "id bigint, symbol_id bigint, content string")
    row = knowledge.contradictions(spark, notes).collect()
    assert [(r.a, r.b, r.first, r.second) for r in row] == [(1, 2, "always", "sometimes")]


def test_attention(spark):
    ev = spark.createDataFrame([(1, "view", 1), (1, "view", 2), (1, "query", 3)], "id bigint, kind string, at bigint")
    assert knowledge.attention(ev).first().importance == 4.0


def test_ownership(spark):
    lines = spark.createDataFrame([("f", "Alice", 100), ("f", "Alice", 100), ("f", "Bob", 200)], "file string, author string, at bigint")
    assert {(r.author, r.commits, r.last_touched) for r in evolution.ownership(lines).collect()} == {("Alice", 2, 100), ("Bob", 1, 200)}


def test_ndcg(spark):
    gold = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 1)], "query string, id string, grade int")
    best = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "c", 2)], "query string, id string, rank int")
    assert structure.metrics(best, gold, 10).first().ndcg == pytest.approx(1.0)


def test_budget_passes_over_what_does_not_fit(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 10, 50), (1, 11, 80), (2, 12, 40)], "pos bigint, id bigint, tokens bigint")
    got = df.agg(structure.packed(F.collect_list(F.struct("pos", "id", "tokens")), 100).alias("p")).first().p
    assert got.used == 90 and got.ids == [10, 12]


def test_python_symbols_and_edges(spark):
    code = "class A:\n    def f(self):\n        return g()\n\nclass B(A):\n    pass\n\ndef g():\n    return 1\n"
    files = spark.createDataFrame([("a.py", "python", code), ("b.go", "go", "package p\n\nfunc F() {\n  x()\n}\n")], "path string, language string, content string")
    s = parse(files)
    got = {(r.file, r.name, r.kind, r.line_start, r.line_end) for r in s.collect()}
    assert {("a.py", "A", "class", 1, 3), ("a.py", "f", "function", 2, 3), ("a.py", "B", "class", 5, 6), ("a.py", "g", "function", 8, 9), ("b.go", "F", "function", 3, 5)} <= got
    assert [(r.from_name, r.to_name) for r in edges(s, "calls", "CALLS").collect()] == [("f", "g")]
    assert [(r.from_name, r.to_name) for r in edges(s, "bases", "INHERITS").collect()] == [("B", "A")]


def test_catalog_versions(spark, tmp_path):
    from lodegraph.storage import Catalog

    c = Catalog(spark, str(tmp_path))
    c.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), ["id"])
    c.upsert("t", spark.createDataFrame([(2, "c")], "id int, v string"), ["id"])
    assert sorted((r.id, r.v) for r in c.read("t").collect()) == [(1, "a"), (2, "c")]


def test_context_tiers(spark):
    from lodegraph.operators import context

    s = spark.createDataFrame([(i, "function", f"f{i}", "a.py", i, 2.0, int(i == 1)) for i in range(1, 9)], "id bigint, kind string, name string, file string, line_start bigint, risk double, stale bigint")
    e = spark.createDataFrame([(i, 1) for i in range(2, 9)], "from_id bigint, to_id bigint")
    notes = spark.createDataFrame([(5, 1, 0.5, "stale")], "id bigint, symbol_id bigint, confidence double, status string")
    got = {r.id: r.full for r in context.full(s, e, notes, s.where("id < 3").select("id")).collect()}
    assert got[1] == "function f1 (a.py:1) risk 2.0 [1 stale]\ncalled by: f2, f3, f4, f5, f6\nnote 5: stale, 0.50\nwithin 3 calls: 7 callers, 0 dependencies"
    assert got[2] == "function f2 (a.py:2) risk 2.0\nwithin 3 calls: 0 callers, 1 dependencies"


def test_embeddings_are_kept_until_a_body_changes(spark, tmp_path):
    from lodegraph.functions.embed import HashingEmbedder, refresh
    from lodegraph.storage import Catalog

    c, shape = Catalog(spark, str(tmp_path)), "id bigint, body_hash string, text string"
    first = {r.symbol_id: r.embedding for r in refresh(c, spark.createDataFrame([(1, "a", "x"), (2, "b", "y y"), (3, "c", None)], shape), HashingEmbedder(8)).collect()}
    after = {r.symbol_id: r.embedding for r in refresh(c, spark.createDataFrame([(1, "a", "other"), (2, "d", "x")], shape), HashingEmbedder(8)).collect()}
    assert after[1] == first[1] == after[2] != first[2] and after[3] == [0.0] * 8


def test_scope_chains_of_any_depth_and_cycles(spark):
    rows = [(1, i, i - 1 if i else None) for i in range(14)] + [(2, 0, 1), (2, 1, 0)]
    got = {(r.file, r.id): r.chain for r in structure.scope_chains(spark.createDataFrame(rows, "file bigint, id bigint, parent_id bigint")).collect()}
    assert got == {(1, i): list(range(i + 1)) for i in range(14)} | {(2, 0): [1, 0], (2, 1): [0, 1]}


def test_sections_of_odd_lines(spark):
    texts = [("a", "# t\n" + "x" * 495 + "\nrest"), ("b", "# one\r\n#\x0btwo\n# a\u2028b\n# c\u0085"), ("c", "# same\nx"), ("c", "# same\nx")]
    got = {(r.file, r.section): r for r in structure.sections(spark.createDataFrame(texts, "file string, text string")).collect()}
    assert got["a", 1].docstring == "# t\n" + "x" * 495 + "\n"
    assert [got["b", i].title for i in (1, 2, 3, 4)] == ["one\r", "\x0btwo", "a\u2028b", "c\u0085"]
    assert [(k, r.title, r.line_start, r.line_end) for k, r in got.items() if k[0] == "c"] == [(("c", 2), "same", 1, 2)]
    assert got["c", 2].docstring == "# same\n# same\nx\nx"


def test_files_are_dealt_out_before_they_are_parsed(spark):
    files = spark.createDataFrame([(f"{i}.py", "python", f"def f{i}(): pass") for i in range(64)], "path string, language string, content string").coalesce(1)
    places = [r.n for r in parse(files).groupBy(F.spark_partition_id().alias("at")).agg(F.count("*").alias("n")).collect()]
    assert sum(places) == 64 and max(places) < 32
    assert {r.name: r.line_end for r in parse(files.limit(1), ("name", "line_end")).collect()} == {"f0": 1}


def test_index_counts_words_where_they_are_read(spark, tmp_path):
    rows = [("a", "The the-cat, \u00c9T\u00c9 x2"), ("b", ""), ("c", None), ("d", "...cat"), ("e", "dog _cat_ dog")]
    docs = spark.createDataFrame(rows, "k string, t string").coalesce(2)
    index = search.Index.build(docs, "k", "t", str(tmp_path / "i"))
    got = {(r.term, r.id): (r.tf, r.dl) for r in index.postings(["the", "cat", "\u00e9t\u00e9", "dog", "x2", ""]).collect()}
    assert got == {("the", "a"): (2, 5), ("cat", "a"): (1, 5), ("\u00e9t\u00e9", "a"): (1, 5), ("x2", "a"): (1, 5), ("cat", "d"): (1, 1), ("dog", "e"): (2, 3), ("cat", "e"): (1, 3)}
    stats = spark.read.parquet(str(tmp_path / "i" / "stats")).first()
    assert (stats.n, stats.avgdl) == (5, 9 / 4)
    stored = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert dict(stored.dtypes) == {"term": "string", "ids": "array<string>", "tf": "array<int>", "dl": "array<int>"} and stored.where("term = 'cat'").count() <= 2
    assert search.Index.build(docs.limit(0), "k", "t", str(tmp_path / "e")).search(["cat"], 3).count() == 0


def test_near_pairs_of_few_groups_are_all_pairs(spark, monkeypatch):
    from lodegraph.operators import clones

    monkeypatch.setattr(clones, "BLOCK", 4)
    monkeypatch.setattr(clones, "GROUPS", 3)
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", None]), [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(40)]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    size = lambda x: dot(x, x) ** 0.5
    want = {(i, j): dot(x, y) / (size(x) * size(y)) for i, f, x in rows for j, g, y in rows if i < j and f and g and f != g and size(x) and size(y)}
    found = clones.near_pairs(spark.createDataFrame(rows, "id bigint, file string, v array<double>"), 0.5)
    assert {(r.a, r.b): r.score for r in found.collect()} == {k: pytest.approx(s, abs=1e-6) for k, s in want.items() if round(s, 6) >= 0.5}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_large_component_moves_as_by_plain_sweeps():
    import numpy as np

    rng = random.Random(5)
    edges = list({(rng.randrange(60), rng.randrange(60)) for _ in range(110)})
    edges = [(7 * a - 100, 7 * b - 100) for a, b in edges if a != b]
    near, m = {}, len(edges) / 2
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    own = {i: i for i in near}
    for _ in range(20):
        before = dict(own)
        for i in sorted(near):
            at = lambda c: sum(len(near[j]) for j in near if own[j] == c)  # noqa: E731, B023
            tie = lambda c: sum(own[j] == c for j in near[i])  # noqa: E731, B023
            rest = at(own[i]) - len(near[i])
            gains = [((tie(c) - tie(own[i])) / m - len(near[i]) * (at(c) - rest) / (2 * m * m), -c) for c in {own[j] for j in near[i]} - {own[i]}]
            if gains and max(gains)[0] > 0:
                own[i] = -max(gains)[1]
        if own == before:
            break
    ids, moved = graph._moved(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), m, 20)
    assert dict(zip(ids.tolist(), ids[moved].tolist())) == own
