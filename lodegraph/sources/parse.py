"""Source texts to symbols: Python by its own grammar, brace languages and Ruby by declaration scanners.

The scanners blank out strings and comments, find declarations by one pattern per kind, and match braces (or end
keywords) for their extent.  A symbol's parent is the smallest one whose lines hold its own, and its scope chain
leads from the outermost one to itself.  Calls are names before a parenthesis, resolved within a file to functions,
methods and classes (the last of equal names), and belong to every function around them; calls through
paths, macros, ``self`` in Python, and all calls of Java and Ruby yield none.  Python's bases give INHERITS,
Rust's ``impl T for S`` gives IMPLEMENTS.

Defined cases: null and empty texts, texts that don't parse and unknown languages have no symbols; files without
symbols give no rows; repeated files repeat their rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import expressions as X

_ID = r"([A-Za-z_$][\w$]*)"
_NOT = r"(?!(?:if|else|for|while|do|switch|catch|return|function|new|throw|case|with|await|yield|typeof|super|this)\b)"
_SCRIPT = [
    ("class", rf"\bclass\s+{_ID}"), ("interface", rf"\binterface\s+{_ID}"), ("enum", rf"\benum\s+{_ID}"), ("type_alias", rf"\btype\s+{_ID}\s*(?:<[^=]*>)?\s*="),
    ("function", rf"\bfunction\s*\*?\s*{_ID}"), ("variable", rf"\b(?:const|let|var)\s+{_ID}"),
    ("method", rf"^[ \t]+(?:public |private |protected |static |async |readonly |get |set |\*)*{_NOT}{_ID}\s*(?:<[^>(]*>)?\([^;{{}}]*\)\s*(?::[^;{{=]*)?\{{"),
]
_DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", rf"\bfn\s+{_ID}[^;{{]*\{{"), ("struct", rf"\bstruct\s+{_ID}"), ("enum", rf"\benum\s+{_ID}"), ("trait", rf"\btrait\s+{_ID}"), ("module", rf"\bmod\s+{_ID}"), ("constant", rf"\b(?:const|static)\s+(?:mut\s+)?{_ID}\s*:"), ("type_alias", rf"\btype\s+{_ID}\s*(?:<[^=]*>)?\s*=")],
    "typescript": _SCRIPT,
    "javascript": [x for x in _SCRIPT if x[0] in ("class", "function", "variable", "method")],
    "go": [("module", rf"^package\s+{_ID}"), ("type_alias", rf"^type\s+{_ID}"), ("method", rf"^func\s+\([^)]*\)\s*{_ID}"), ("function", rf"^func\s+{_ID}")],
    "java": [("class", rf"\bclass\s+{_ID}"), ("interface", rf"\binterface\s+{_ID}"), ("enum", rf"\benum\s+{_ID}"), ("method", rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*{_NOT}(?!(?:public|private|protected|static|final|abstract)\b)\w[\w<>\[\], .?]*?\s+{_ID}\s*\([^;{{}}]*\)\s*(?:throws [\w, .]+)?[;{{]"), ("function", rf"^[ \t]+(?:public |private |protected )?{_NOT}{_ID}\s*\([^;{{}}]*\)\s*(?:throws [\w, .]+)?\{{")],
    "c": [("struct", rf"\bstruct\s+{_ID}"), ("enum", rf"\benum\s+{_ID}"), ("type_alias", rf"\btypedef\b[^;{{]*(?:\{{[^}}]*\}}\s*)?\b{_ID}\s*;"), ("function", rf"^{_NOT}[A-Za-z_][\w\s*]*?\b{_NOT}{_ID}\s*\([^;{{]*\)\s*\{{")],
    "cpp": [("class", rf"(?<!enum )\bclass\s+{_ID}"), ("struct", rf"\bstruct\s+{_ID}"), ("enum", rf"\benum\s+(?:class\s+)?{_ID}"), ("function", rf"^{_NOT}[A-Za-z_][\w\s*&:<>,]*?(?<![:~])\b{_NOT}{_ID}\s*\([^;{{]*\)[^;{{}}]*\{{")],
    "ruby": [("module", rf"^[ \t]*module\s+{_ID}"), ("class", rf"^[ \t]*class\s+{_ID}"), ("function", r"^[ \t]*def\s+self\.([A-Za-z_]\w*[?!]?)"), ("method", r"^[ \t]*def\s+(?!self\.)([A-Za-z_]\w*[?!]?)")],
}
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n]){2,}'|`(?:\\.|[^`\\])*`", re.S)
_RUST = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)
_HASH = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_CALL = re.compile(r"(?<![\w$:])([A-Za-z_$][\w$]*)\s*\(")
_DECLARES = re.compile(r"\b(?:fn|func|function|new|class|def)\s+\*?\s*$|\)\s+$")
_BRACE, _ENDS, _STOP = re.compile(r"[{}]"), re.compile(r"[(\[{}\])]|;|\n"), re.compile(r"[{;]")
_BODY = re.compile(r"\s*(?:final\s*)?(?::[^;{(]*)?\{")
_CLASS = re.compile(r"\b(?:class|struct)\s+([A-Za-z_]\w*)")
_MAKES = re.compile(r"^[ \t]+(?:explicit\s+)?([A-Za-z_]\w*)(?=\s*\()", re.M)
_MAKER = re.compile(r"^[ \t]+(?:explicit\s+)?([A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}]*\{", re.M)
#: Words one of which a text must hold if a rule is to find anything; none for rules that are tried on every text.
_WORDS = {"variable": ("const", "let", "var"), "constant": ("const", "static"), "class": ("class",), "interface": ("interface",), "enum": ("enum",), "struct": ("struct",), "trait": ("trait",), "type_alias": ("type",)}
_RULES = {lang: [(kind, re.compile(p, re.M), _WORDS.get(kind, ())) for kind, p in rules] for lang, rules in _DECLARATIONS.items()}
_IMPL = re.compile(r"\bimpl(?:<[^{>]*>)?\s+([A-Za-z_]\w*)(?:<[^{]*?>)?\s+for\s+([A-Za-z_]\w*)")


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    signature: str
    doc: str | None
    body: str
    chain: list[str] = field(default_factory=list)
    calls: list[tuple[str, int]] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    parent: int | None = None
    place: int = 0


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _walk(node: ast.AST) -> list[ast.AST]:
    """``ast.walk`` without its generators, in the same order; contexts of names are left out."""
    todo = [node]
    for node in todo:
        for x in node.__dict__.values():
            if isinstance(x, list):
                todo.extend(y for y in x if isinstance(y, ast.AST))
            elif isinstance(x, ast.AST) and not isinstance(x, ast.expr_context):
                todo.append(x)
    return todo


def _python(content: str) -> list[Symbol]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = content.split("\n"), []
    for node in _walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = node.body[0].lineno
            head = "\n".join(lines[node.lineno - 1 : first - 1]) if first > node.lineno else lines[node.lineno - 1]
            is_class = isinstance(node, ast.ClassDef)
            calls = [] if is_class else [(n.func.id, n.lineno) for n in _walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)]
            bases = [b.id for b in node.bases if isinstance(b, ast.Name)] if is_class else []
            body = "\n".join(lines[first - 1 : node.end_lineno])
            out.append(Symbol(node.name, "class" if is_class else "function", node.lineno, node.end_lineno, head.strip(), ast.get_docstring(node), body, calls=calls, bases=bases))
    return sorted(out, key=lambda s: (s.start, -s.end))


def _block(plain: str, at: int) -> int:
    """Place of the brace that closes the one at ``at``."""
    depth = 0
    for m in _BRACE.finditer(plain, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(plain) - 1


def _statement(plain: str, at: int) -> int:
    """Place where a statement ends: a semicolon, or a line end with all brackets closed."""
    depth = 0
    for m in _ENDS.finditer(plain, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return m.start() - 1
        elif depth == 0 and (c == ";" or plain[at : m.start()].rstrip()[-1:] not in ("=", ">", ",", "")):
            return m.start() - (c == "\n")
    return len(plain) - 1


def _extent(plain: str, lang: str, kind: str, m: re.Match) -> tuple[int, int | None]:
    """(last place of a declaration, place where its body starts, if it has one)."""
    after = m.end(1)
    line_end = plain.find("\n", after) if plain.find("\n", after) >= 0 else len(plain)
    if kind == "variable" or kind == "constant" or (kind == "type_alias" and lang in ("rust", "typescript")):
        return _statement(plain, after), None
    if kind == "module" and lang == "go":
        return after, None
    if lang == "go" and kind == "type_alias" and "{" not in plain[after:line_end]:
        return line_end - 1, None
    if lang in ("c", "cpp") and kind in ("struct", "enum", "class"):
        nxt = _BODY.match(plain, after)
        return (_block(plain, nxt.end() - 1), nxt.end() - 1) if nxt else (after - 1, None)
    if lang == "c" and kind == "type_alias":
        return m.end() - 1, None
    stop = _STOP.search(plain, m.end() - 1 if plain[m.end() - 1] in "{;" else after)
    if stop is None:
        return line_end - 1, None
    return (_block(plain, stop.start()), stop.start()) if stop[0] == "{" else (stop.start(), None)


def _doc(content: str, lines: list[str], start: int, lang: str) -> str | None:
    marks = {"rust": ("///", "//!"), "go": ("//",)}.get(lang)
    if marks:
        out, k = [], start - 2
        while k >= 0 and lang == "rust" and lines[k].strip().startswith("#["):
            k -= 1
        while k >= 0 and lines[k].strip().startswith(marks):
            out.append(lines[k].strip().lstrip("/!").strip())
            k -= 1
        return "\n".join(reversed(out)) or None
    if lang in ("typescript", "javascript") and "/**" in content:
        above = "\n".join(lines[: start - 1]).rstrip()
        if above.endswith("*/") and (at := above.rfind("/**")) >= 0:
            return "\n".join(x.strip().lstrip("*").strip() for x in above[at + 3 : -2].split("\n")).strip() or None
    return None


def _constructors(plain: str) -> Iterator[re.Match]:
    """Bodies of constructors; what one of a class spans holds no other of that class."""
    made, upto = set(_CLASS.findall(plain)), {}
    for at in _MAKES.finditer(plain) if made else ():
        if at[1] in made and at.start() >= upto.get(at[1], 0) and (m := _MAKER.match(plain, at.start())):
            upto[at[1]] = m.end()
            yield m


def _scan(content: str, lang: str) -> list[Symbol]:
    plain = {"ruby": _HASH, "rust": _RUST}.get(lang, _COMMENT).sub(_blank, content)
    lines, found = content.split("\n"), {}
    tries = [(kind, rule.finditer(plain)) for kind, rule, words in _RULES.get(lang, ()) if not words or any(w in plain for w in words)]
    if lang == "cpp":
        tries.append(("function", _constructors(plain)))
    for kind, matches in tries:
        for m in matches:
            line = lambda at: plain.count("\n", 0, at) + 1
            start = line(m.start(1) if kind != "type_alias" else m.start() + (plain[m.start()] == "\n"))
            if (m[1], start) in found:
                continue
            if lang == "ruby":
                indent = re.match(r"[ \t]*", lines[start - 1])[0]
                end = next((k for k in range(start, len(lines)) if re.match(indent + r"end\b", lines[k])), start - 1) + 1
                body = "\n".join(lines[start : end - 1])
                signature = lines[start - 1].strip()
            else:
                stop, brace = _extent(plain, lang, kind, m)
                end = line(max(stop, m.start(1)))
                head = plain.rfind("\n", 0, m.start(1)) + 1
                body = content[brace : stop + 1] if brace is not None else content[head : stop + 1].strip()
                signature = content[head:brace].strip() if brace is not None else lines[start - 1].strip()
            found[m[1], start] = Symbol(m[1], kind, start, end, signature, _doc(content, lines, start, lang), body, place=m.start())
    out = sorted(found.values(), key=lambda s: (s.start, -s.end, s.place))
    if lang not in ("java", "ruby"):
        calls = [(m[1], plain.count("\n", 0, m.start()) + 1) for m in _CALL.finditer(plain) if not _DECLARES.search(plain, max(0, m.start() - 40), m.start())]
        for s in out:
            if s.kind in ("function", "method"):
                s.calls = [(n, at) for n, at in calls if s.start <= at <= s.end]
    if lang == "rust":
        made = {s.name: s for s in out if s.kind in ("struct", "enum")}
        for m in _IMPL.finditer(plain):
            if m[2] in made:
                made[m[2]].bases.append(m[1])
    return out


def symbols_of(content: str | None, lang: str | None) -> list[Symbol]:
    """The symbols of a text in order of their lines, with parents and scope chains."""
    out = _python(content or "") if lang == "python" else _scan(content or "", lang or "")
    for i, s in enumerate(out):
        around = [(p.end - p.start, j) for j, p in enumerate(out) if j != i and p.start <= s.start and p.end >= s.end and not (p.start == s.start and p.end == s.end and j > i)]
        s.parent = min(around)[1] if around else None
    for i, s in enumerate(out):
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            at = out[at].parent
        s.chain = [out[k].name for k in reversed(seen)]
    return out


SCHEMA = "file string, language string, pos int, name string, kind string, line_start int, line_end int, signature string, docstring string, scope_chain array<string>, parent int, calls array<struct<name:string,line:int>>, bases array<string>, body string"


def parse(files: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Symbols of (path, language, content), with all columns of ``SCHEMA`` or the named ones alone.

    Files are dealt out before they are parsed: a few MB of packed rows may hold millions of small files.
    """
    schema = ", ".join(c for c in SCHEMA.split(", ") if not columns or c.split(" ")[0] in columns)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    get = {
        "file": lambda f, i, s: f[0], "language": lambda f, i, s: f[1], "pos": lambda f, i, s: i, "line_start": lambda f, i, s: s.start, "line_end": lambda f, i, s: s.end, "docstring": lambda f, i, s: s.doc,
        "scope_chain": lambda f, i, s: s.chain, "calls": lambda f, i, s: [{"name": n, "line": at} for n, at in s.calls],
    }
    takes = [get.get(n) or (lambda f, i, s, n=n: getattr(s, n)) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, kind_of = pa.string(), {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<struct<name:string,line:int>>": pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32())]))}
        kinds = pa.schema([(n, kind_of[c.split(" ")[1]]) for n, c in zip(names, schema.split(", "))])
        for b in batches:
            rows = [(f, i, s) for f in zip(*(b.column(k).cast(texts).to_pylist() for k in range(2)), b.column(2).to_pylist()) for i, s in enumerate(symbols_of(f[2], f[1]))]
            yield pa.RecordBatch.from_arrays([pa.array([take(*r) for r in rows], k.type) for take, k in zip(takes, kinds)], schema=kinds)

    spark = files.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", "language", "content").repartition(n).mapInArrow(run, schema)


def identified(parsed: DataFrame) -> DataFrame:
    """``parsed`` with id, canonical_id, body_hash and full_hash."""
    out = parsed.withColumns({"id": X.symbol_id(F.col("file"), F.col("name"), F.col("kind")), "body_hash": F.sha2("body", 256), "full_hash": X.full_hash(F.col("signature"), F.col("body"), F.col("docstring"))})
    return out.withColumn("canonical_id", X.canonical_id(F.col("name"), F.col("kind"), F.col("body_hash")))


def call_edges(parsed: DataFrame) -> DataFrame:
    """from_id, to_id, kind, file, line, confidence of the calls and bases that are resolved in their file."""
    s = identified(parsed)
    last = s.where("kind in ('function', 'method', 'class')").groupBy("file", F.col("name").alias("to_name")).agg(F.max_by("id", "pos").alias("to_id"))
    used = s.select("file", F.col("id").alias("from_id"), F.explode("calls").alias("c")).select("file", "from_id", F.col("c.name").alias("to_name"), F.col("c.line").alias("line"))
    calls = used.join(last, ["file", "to_name"]).where("from_id <> to_id").groupBy("from_id", "to_id", "file").agg(F.min("line").alias("line")).withColumn("kind", F.lit("CALLS"))
    kinds = s.groupBy("file", F.col("name").alias("to_name")).agg(F.max_by("id", "pos").alias("to_id"))
    bases = s.select("file", "language", F.col("id").alias("from_id"), F.col("line_start").alias("line"), F.explode("bases").alias("to_name")).join(kinds, ["file", "to_name"]).where("from_id <> to_id")
    bases = bases.withColumn("kind", F.when(F.col("language") == "rust", "IMPLEMENTS").otherwise("INHERITS")).groupBy("from_id", "to_id", "kind", "file").agg(F.min("line").alias("line"))
    cols = ["from_id", "to_id", "kind", "file", "line"]
    return calls.select(*cols).unionByName(bases.select(*cols)).withColumn("confidence", F.lit(1.0))


def edges(symbols: DataFrame, column: str, kind: str) -> DataFrame:
    """file, from_name, to_name, kind: calls or bases resolved by name to the symbols of the same file."""
    named = symbols.select("file", F.col("name").alias("to_name")).distinct()
    target = F.col("x.name") if column == "calls" else F.col("x")
    used = symbols.select("file", F.col("name").alias("from_name"), F.explode(column).alias("x")).select("file", "from_name", target.alias("to_name")).where("from_name <> to_name").distinct()
    return used.join(named, ["file", "to_name"]).select("file", "from_name", "to_name", F.lit(kind).alias("kind"))
