"""The tools on a small code base that is parsed, watched and asked about."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodegraph.functions.embed import HashingEmbedder
from lodegraph.operators import context
from lodegraph.operators.search import Index
from lodegraph.sources import files as S
from lodegraph.sources import parse as P
from lodegraph.storage import Catalog
from lodegraph.streaming import upkeep, watch
from lodegraph.tools import SHAPES, Tools

STORE = '''/// Keeps users.
pub struct Store {
    path: String,
}

impl Reader for Store {
    fn load_user(&self, id: u32) -> User {
        let row = self.read_row(id);
        decode(row)
    }

    fn read_row(&self, id: u32) -> Row {
        open(self.path)
    }
}

trait Reader {
    fn peek(&self);
}

/// Opens a path.
fn open(path: String) -> Row {
    println!("{}", path);
    Row::new(path)
}

fn decode(row: Row) -> User {
    check(row);
    User {}
}

fn check(row: Row) {}

const LIMIT: u32 = 3;
'''
SHOP = '''class Base:
    """All things."""


class Item(Base):
    def price(self):
        return tax(1) + self.cost()

    def cost(self):
        return 2


def tax(x):
    """Adds tax."""
    def half(y):
        return y / 2
    return half(x)
'''
FILES = {"src/store.rs": STORE, "lib/shop.py": SHOP, "lib/copy.py": SHOP, "node_modules/x.py": "def no(): pass\n", "skip/gone.py": "def gone(): pass\n", ".gitignore": "skip/\n# a note\n*.tmp.py\n", "lib/a b.py": "def spaced():\n    return 1\n", "x.tmp.py": "def tmp(): pass\n", "notes.txt": "no"}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def kept(spark, tree, tmp_path_factory):
    catalog = Catalog(spark, str(tmp_path_factory.mktemp("catalog")))
    upkeep.start(spark, catalog, tree, HashingEmbedder(64))
    return catalog


@pytest.fixture
def tools(spark, kept, tmp_path):
    s = kept.read("symbols")
    index = Index.build(s.withColumn("text", F.concat_ws(" ", "name", "signature", "docstring", "file")), "id", "text", str(tmp_path / "index"))
    tables = {n: kept.read(n).select(*[c.split(" ")[0] for c in SHAPES[n].split(", ")]) for n in ("symbols", "edges", "annotations", "insights", "embeddings", "evolution")}
    tables["sources"] = spark.createDataFrame([(k, v) for k, v in FILES.items()], "file string, content string")
    return Tools(spark, tables, index, HashingEmbedder(64), now=F.lit(1_700_000_000))


def test_discovery(spark, tree):
    got = {(r.path, r.language) for r in S.read_sources(spark, tree).collect()}
    assert got == {("src/store.rs", "rust"), ("lib/shop.py", "python"), ("lib/copy.py", "python"), ("lib/a b.py", "python")}


def test_parsed_rows():
    got = [(s.name, s.kind, s.start, s.end, s.chain, s.doc) for s in P.symbols_of(STORE, "rust")]
    assert got == [
        ("Store", "struct", 2, 4, ["Store"], "Keeps users."), ("load_user", "function", 7, 10, ["load_user"], None), ("read_row", "function", 12, 14, ["read_row"], None),
        ("Reader", "trait", 17, 19, ["Reader"], None), ("open", "function", 22, 25, ["open"], "Opens a path."), ("decode", "function", 27, 30, ["decode"], None),
        ("check", "function", 32, 32, ["check"], None), ("LIMIT", "constant", 34, 34, ["LIMIT"], None),
    ]
    got = [(s.name, s.kind, s.start, s.end, s.chain) for s in P.symbols_of(SHOP, "python")]
    assert got == [
        ("Base", "class", 1, 2, ["Base"]), ("Item", "class", 5, 10, ["Item"]), ("price", "function", 6, 7, ["Item", "price"]), ("cost", "function", 9, 10, ["Item", "cost"]),
        ("tax", "function", 13, 17, ["tax"]), ("half", "function", 15, 16, ["tax", "half"]),
    ]


LANGUAGES = {
    "typescript": ("interface A {\n  go(): void;\n}\n\n/** Does it. */\nclass B {\n  constructor(x: number) {\n    go(x);\n  }\n\n  run(): void {\n    if (x) {\n      stop();\n    }\n  }\n}\n\nenum C { X }\ntype D = {\n  a: string;\n};\nfunction go(a: number) {\n  const t = new B(a);\n  return t;\n}\nexport const f = async (p: string) => {\n  return go(1);\n};\n", [
        ("A", "interface", 1, 3), ("B", "class", 6, 16), ("constructor", "method", 7, 9), ("run", "method", 11, 15), ("C", "enum", 18, 18), ("D", "type_alias", 19, 21), ("go", "function", 22, 25), ("t", "variable", 23, 23), ("f", "variable", 26, 28)]),
    "javascript": ("class B {\n  run() {\n    return 1;\n  }\n}\nfunction go(a) {\n  return a;\n}\n", [("B", "class", 1, 5), ("run", "method", 2, 4), ("go", "function", 6, 8)]),
    "go": ("package p\n\n// T holds.\ntype T struct {\n\ta int\n}\n\ntype N int\n\nconst K = 1\n\nfunc (t T) Run() int {\n\treturn t.a\n}\n\nfunc Go() {\n\tRun()\n}\n", [("p", "module", 1, 1), ("T", "type_alias", 4, 6), ("N", "type_alias", 8, 8), ("Run", "method", 12, 14), ("Go", "function", 16, 18)]),
    "java": ("public class A {\n    private int x;\n\n    public A(int x) {\n        super(x);\n    }\n\n    public int get() {\n        return compute(x);\n    }\n}\n\ninterface B {\n    boolean ok();\n}\n\nenum C {\n    X\n}\n", [("A", "class", 1, 11), ("A", "function", 4, 6), ("get", "method", 8, 10), ("B", "interface", 13, 15), ("ok", "method", 14, 14), ("C", "enum", 17, 19)]),
    "c": ("struct A {\n    int x;\n};\n\nenum B {\n    X\n};\n\ntypedef struct A AA;\n\nint get(struct A* a) {\n    return a->x;\n}\n", [("A", "struct", 1, 3), ("B", "enum", 5, 7), ("AA", "type_alias", 9, 9), ("A", "struct", 9, 9), ("get", "function", 11, 13), ("A", "struct", 11, 11)]),
    "cpp": ("class A {\npublic:\n    A(int x) : x(x) {}\n\n    int get() const {\n        return x;\n    }\n};\n\nenum class B {\n    X\n};\n\nint run(const A& a) {\n    return a.get();\n}\n", [("A", "class", 1, 8), ("A", "function", 3, 3), ("B", "enum", 10, 12), ("run", "function", 14, 16)]),
    "ruby": ("module M\n  class A\n    def go\n      if x\n        1\n      end\n    end\n  end\n\n  def self.run(a)\n    a\n  end\nend\n", [("M", "module", 1, 13), ("A", "class", 2, 8), ("go", "method", 3, 7), ("run", "function", 10, 12)]),
}


@pytest.mark.parametrize("lang", sorted(LANGUAGES))
def test_languages(lang):
    text, want = LANGUAGES[lang]
    assert [(s.name, s.kind, s.start, s.end) for s in P.symbols_of(text, lang)] == want
    assert all(s.chain and s.body for s in P.symbols_of(text, lang))
    assert P.symbols_of(None, lang) == P.symbols_of("", lang) == []


def test_edges(kept):
    names = {r.id: f"{r.file[:3]}:{r.name}" for r in kept.read("symbols").collect()}
    got = {(names[r.from_id], names[r.to_id], r.kind) for r in kept.read("edges").collect()}
    shop = {("lib:price", "lib:tax", "CALLS"), ("lib:tax", "lib:half", "CALLS"), ("lib:Item", "lib:Base", "INHERITS")}
    assert got == shop | {("src:load_user", "src:read_row", "CALLS"), ("src:load_user", "src:decode", "CALLS"), ("src:read_row", "src:open", "CALLS"), ("src:decode", "src:check", "CALLS"), ("src:Store", "src:Reader", "IMPLEMENTS")}


def test_lookups(tools):
    assert tools.get_symbol("open").text() == "function open (src/store.rs:22)\n  fn open(path: String) -> Row\n  Opens a path."
    assert tools.get_symbol("adds tax").text().startswith("near: function tax (lib/")
    assert tools.find_callers("check").text() == "callers of check:\n1: function decode (src/store.rs:27)\n2: function load_user (src/store.rs:7)"
    assert tools.find_dependencies("load_user", 1).lines() == ["1: function read_row (src/store.rs:12)", "1: function decode (src/store.rs:27)"]
    assert tools.find_callers("nobody").text() == "no callers of nobody"
    assert tools.get_file_summary("src/store.rs").lines()[:2] == ["2-4 struct Store", "7-10 function load_user"]
    assert tools.get_project_identity().lines() == ["21 symbols, 11 edges, 4 files", "python: 13", "rust: 8"]
    assert tools.get_trace("decode").lines() == ["caller 1: function load_user (src/store.rs:7)", "dependency 1: function check (src/store.rs:32)"]


def test_search_and_its_fallback(tools):
    assert tools.search_semantic("load user", 3).lines()[0].startswith("function load_user (src/store.rs:7) hybrid")
    tools.embedder = None
    assert tools.search_semantic('open" (path', 3).lines()[0].startswith("function open (src/store.rs:22) bm25 ")
    assert tools.search_semantic("AND nothing", 3).text() == "no results for AND nothing"


def test_notes_and_risk(tools):
    assert tools.annotate_symbol("decode", "note", "it always returns true").text() == "note 1 kept"
    assert tools.annotate_symbol("decode", "note", "it sometimes returns false").text() == "note 2 kept"
    assert tools.annotate_symbol("nobody", "note", "x").text() == "no symbol nobody"
    assert tools.downvote_annotation(1).text() == "note 1: active, confidence 0.60"
    assert tools.verify_annotation(1).text() == "note 1: active, confidence 1.00"
    assert tools.seen().first().importance == 6.0
    assert tools.get_risk_score("decode").text() == "decode (src/store.rs): risk 2.0, 1 callers, complexity 0, 0 stale"
    found = tools.get_insights().lines()
    assert found == ["1: contradiction, 'always' vs 'sometimes': it always returns true / it sometimes returns false (70%)"] == tools.get_insights().lines()
    assert tools.resolve_insight(1, "dismissed").text() == "insight 1: dismissed"
    assert tools.get_insights().text() == "no active insights"
    assert tools.record_decision("decode, open,", "split", "tests").text() == "decision 1 on 2 symbols"
    assert tools.record_pattern("p", "d", "tax").text() == "pattern 1 on 2 symbols"
    assert tools.get_evolution("decode").lines()[-2:] == ["note 2: it sometimes returns false (active)", "note 1: it always returns true (active)"]
    assert "decode" in tools.get_exploration_map().text() and "decode" not in tools.suggest_next(30).text()


def test_tiers_hold_each_other(tools):
    texts = [tools.get_context("decode", t).text() for t in context_tiers()]
    assert texts[0] == "function decode (src/store.rs:27) risk 2.0"
    assert texts[1] == texts[0] + "\nlines 27-30\nfn decode(row: Row) -> User\ncalled by: load_user"
    assert texts[2] == texts[1] + "\nwithin 3 calls: 1 callers, 1 dependencies"
    assert texts[3] == texts[2] + "\n  27 | fn decode(row: Row) -> User {\n  28 |     check(row);\n  29 |     User {}\n  30 | }"
    assert tools.get_context("decode", "other").text() == texts[1]
    assert "in Item" in tools.get_context("price").text() and tools.get_context("nobody").text() == "no symbol nobody"


def context_tiers():
    return ("brief", "standard", "full", "deep")


def test_batch_upgrades_while_room_is_left(tools):
    brief, standard = tools.get_context("decode", "brief").text(), tools.get_context("decode").text()
    assert tools.get_context_batch("decode, open", 1000).lines()[0] == standard
    assert tools.get_context_batch("decode, open", 60).lines()[0] == brief
    assert tools.get_context_batch("decode, open", 1).text() == "nothing fits"


def test_upgrades(spark):
    rows = spark.createDataFrame([(0, "a", "x" * 40, "y" * 800), (1, "b", "x" * 40, "z" * 400), (2, "c", "x" * 4000, "q")], "pos long, id string, brief string, standard string")
    got = rows.agg(context.upgraded(F.collect_list(F.struct("pos", "id", "brief", "standard")), 150).alias("p")).first().p
    assert got.used == 110 and [(t.id, t.text[0]) for t in got.taken] == [("a", "x"), ("b", "z")]


def test_clones_modules_and_paths(tools):
    assert tools.find_similar("tax").lines()[0].endswith("Exact 1.0000")
    assert tools.get_hot_path().lines()[0].split()[1] in ("tax", "half", "read_row", "decode", "open", "check")
    assert tools.get_module_context("src").lines()[0].startswith("src/store.rs: 8 symbols, risk up to 2.00")
    assert tools.context_for_file("/home/me/src/store.rs").text() == tools.context_for_file("store.rs").text() == "src/store.rs: 4 callers, risk up to 2.0, 0 stale, Store, load_user, read_row"
    assert "called: function" in tools.get_codebase_report().text()
    assert tools.get_topic_summary().text() == "no topics" and tools.get_blame("x").text() == "no blame of x"


def test_git(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for k, text in enumerate(("def f(): pass\n", "def f(): pass\ndef g(): pass\n")):
        (repo / "m.py").write_text(text)
        git("add", "-A")
        git("commit", "-qm", f"change {k}")
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    S.sync_git(spark, catalog, str(repo))
    assert S.current_branch(str(repo)) == "main"
    assert [r.message for r in S.file_commits(catalog.read("commits"), "m.py", 5).collect()] in (["change 1", "change 0"], ["change 0", "change 1"])
    assert [(r.file, r.author, r.email, r.commits) for r in catalog.read("owners").collect()] == [("m.py", "A", "a@x", 2)]
    assert sorted((r.start, r.lines) for r in S.blame_hunks(catalog.read("blame")).collect()) == [(1, 1), (2, 1)]
    tools = Tools(spark, {n: catalog.read(n) for n in ("blame", "commits", "owners")})
    assert tools.get_ownership("m.py").lines()[0].startswith("A: 2, last ") and len(tools.get_blame("m.py").lines()) == 2


def test_stream_of_changes(spark, tmp_path):
    catalog, folder = Catalog(spark, str(tmp_path / "catalog")), tmp_path / "changes"
    folder.mkdir()
    work = upkeep.Upkeep(spark, catalog, HashingEmbedder(16), F.lit(1_700_000_000))

    def change(n, *rows):
        with open(folder / f"{n}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("path", "op", "content", "at"), r))) + "\n" for r in rows)
        watch.run(upkeep.change_stream(spark, str(folder)), work, str(tmp_path / "checkpoint"), once=True).awaitTermination()

    leaf = "def leaf():\n    return 1\n\ndef top():\n    return leaf()\n"
    change(0, ("a.py", "created", leaf, "2024-01-01T00:00:00Z"), ("b.md", "created", "# x", "2024-01-01T00:00:00Z"), ("a.py", "created", "", "2023-01-01T00:00:00Z"))
    ids = {r.name: (r.id, r.full_hash) for r in catalog.read("symbols").where("file = 'a.py'").collect()}
    assert set(ids) == {"leaf", "top"}
    notes = [(k, ids[n][0], "note", n, "agent", 0.8, ids[n][1], "active", 0, 0) for k, n in enumerate(("leaf", "top"))]
    catalog.replace("annotations", spark.createDataFrame(notes, SHAPES["annotations"]))
    change(1, ("a.py", "modified", leaf.replace("return 1", "return 2"), "2024-01-02T00:00:00Z"))
    got = {r.content: (r.status, round(r.confidence, 6)) for r in catalog.read("annotations").collect()}
    assert got == {"leaf": ("stale", 0.8), "top": ("active", 0.5)}
    assert [(r.affected_symbol, r.distance) for r in catalog.read("cascade_log").collect()] == [(ids["top"][0], 1)]
    assert ("leaf", "modified") in {(next(n for n, x in ids.items() if x[0] == r.symbol_id), r.change_type) for r in catalog.read("evolution").where(F.col("symbol_id").isin([x[0] for x in ids.values()])).collect()}
    change(2, ("a.py", "modified", leaf, "2024-01-03T00:00:00Z"))  # restored
    assert {r.content: r.status for r in catalog.read("annotations").collect()} == {"leaf": "active", "top": "active"}
    change(3, ("a.py", "deleted", None, "2024-01-04T00:00:00Z"), ("c.py", "created", leaf, "2024-01-04T00:00:00Z"))
    assert {r.file for r in catalog.read("symbols").where("language = 'python'").collect()} == {"c.py"}
    assert catalog.read("evolution").where("change_type = 'moved'").count() == 2
    assert {r.symbol_id for r in catalog.read("embeddings").collect()} == {r.id for r in catalog.read("symbols").collect()}
    before = catalog.versions("symbols")
    work(spark.createDataFrame([], upkeep.CHANGE), 3)  # a batch that ran already
    assert catalog.versions("symbols") == before


def test_catalog_appends_and_keeps_old_versions(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    old = c.replace("t", rows((1, "a")))
    c.append("t", rows((2, "b")))
    assert c.read("t").count() == 2 and old.count() == 1 and c.versions("t") == [1, 2]
    assert len(os.listdir(tmp_path / "t")) >= 3
    c.upsert("t", rows((2, "x"), (2, "y"), (3, "z")).coalesce(1), ["id"])
    assert sorted(map(tuple, c.read("t").collect())) == [(1, "a"), (2, "y"), (3, "z")]
