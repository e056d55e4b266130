"""Source trees: discovery, languages, whole texts, git history."""

from __future__ import annotations

import json
import os
import re
import subprocess

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Languages by extension, and folders that hold no sources.
LANGUAGES = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rb": "ruby", "md": "markdown", "markdown": "markdown",
}
PRUNED = ("node_modules", "target", ".git", "__pycache__", ".venv", "vendor", "dist", "build")


def language(path: Column) -> Column:
    """The language of a path, null if it is none of ours."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), language, content of the sources under a root; hidden and pruned folders are left out."""
    # file paths come URI-encoded; the root may be a path or a URI
    full = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    base = re.sub(r"^[a-z0-9+.-]+:/+", "/", root.rstrip("/")) + "/"
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(full.alias("full"), F.col("value").alias("content"))
    rows = raw.select(F.expr(f"substring(full, locate({json.dumps(base)}, full) + {len(base)})").alias("path"), "content")
    skip = "(^|/)(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + r"|\.[^/]+)(/|$)"
    rows = rows.where(~F.col("path").rlike(skip))
    for pattern in ignore_rules(spark, root):
        rows = rows.where(~F.col("path").rlike(pattern))
    return rows.select("path", language(F.col("path")).alias("language"), "content").where("language is not null")


def ignore_rules(spark: SparkSession, root: str) -> list[str]:
    """Patterns of the lines of the ignore files under a root, by folder; a rule with ! takes its folder's
    equal patterns back.  Read on the driver: they are a few lines each."""
    out: dict[str, None] = {}
    base = re.sub(r"^[a-z0-9+.-]+:/+", "/", root.rstrip("/")) + "/"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, below = [], root.rstrip("/")
    while len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{below}/*")) or ()):  # Spark's own readers skip hidden files
        found += [f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{below}/.gitignore")) or ()]
        below += "/*"
    for at in found:
        stream = fs.open(at)
        body = stream.readAllBytes()
        stream.close()
        folder = at.toUri().getPath().rsplit("/", 1)[0].split(base.rstrip("/"), 1)[-1].strip("/")
        for line in bytes(body).decode("utf-8", "replace").splitlines():
            rule = line.strip()
            if rule and not rule.startswith("#"):
                pattern = ignore_pattern(rule.lstrip("!"), folder)
                if rule.startswith("!"):
                    out.pop(pattern, None)
                else:
                    out[pattern] = None
    return list(out)


def ignore_pattern(rule: str, folder: str = "") -> str:
    """A line of an ignore file as a pattern over relative paths."""
    anchored, only_dir = "/" in rule.rstrip("/"), rule.endswith("/")
    body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|[*?]|[^*?]+", rule.strip("/")))
    head = "^" + (re.escape(folder) + "/" if folder else "")
    return head + ("" if anchored else "(?:.*/)?") + body.replace(".*/", "(?:.*/)?") + ("/" if only_dir else "(?:/|$)")


def git_commits(spark: SparkSession, repo: str, limit: int = 500) -> DataFrame:
    """hash, author, email, timestamp, message, file of the latest commits, one row per touched file."""
    if not os.path.isdir(repo):
        raise FileNotFoundError(repo)
    out = subprocess.run(["git", "-C", repo, "log", f"-{limit}", "--name-only", "--format=%x1e%H%x1f%an%x1f%ae%x1f%at%x1f%s"], capture_output=True, text=True, check=True).stdout
    rows = []
    for entry in out.split("\x1e")[1:]:
        head, *files = entry.split("\n")
        h, author, email, at, message = head.split("\x1f")
        rows += [(h, author, email, int(at), message, f) for f in files if f] or [(h, author, email, int(at), message, None)]
    return spark.createDataFrame(rows, "hash string, author string, email string, timestamp bigint, message string, file string")


def file_commits(commits: DataFrame, file: str, limit: int) -> DataFrame:
    """The latest commits that touch a file, newest first."""
    return commits.where(F.col("file") == file).orderBy(F.desc("timestamp"), "hash").limit(limit)


def current_branch(repo: str) -> str | None:
    """The branch that is checked out; None when none is."""
    out = subprocess.run(["git", "-C", repo, "symbolic-ref", "--short", "-q", "HEAD"], capture_output=True, text=True)
    return out.stdout.strip() or None


BLAME_COLS = ("file", "line", "commit_hash", "author", "email", "at")
BLAME_SCHEMA = pa.schema(list(zip(BLAME_COLS, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()))))


def blame_rows(repo: str, file: str) -> list[tuple]:
    out = subprocess.run(["git", "-C", repo, "blame", "--line-porcelain", "--", file], capture_output=True, text=True, check=True, errors="replace").stdout
    rows, now = [], {}
    for line in out.split("\n"):
        if line.startswith("\t"):
            rows.append((file, len(rows) + 1, now["hash"], now.get("author"), (now.get("author-mail") or "").strip("<>"), int(now.get("author-time", 0))))
        elif line:
            key, _, value = line.partition(" ")
            if len(key) == 40 and all(c in "0123456789abcdef" for c in key):
                now = {"hash": key}
            else:
                now[key] = value
    return rows


def git_blame(spark: SparkSession, repo: str, file: str) -> DataFrame:
    """file, line, commit_hash, author, email, at of each line."""
    return spark.createDataFrame(blame_rows(repo, file), "file string, line int, commit_hash string, author string, email string, at bigint")


def blame_hunks(lines: DataFrame) -> DataFrame:
    """file, start, lines, commit_hash, author, email, at of each run of lines of one commit."""
    w = W.partitionBy("file").orderBy("line")
    new = F.coalesce((F.lag("commit_hash").over(w) != F.col("commit_hash")).cast("int"), F.lit(1))
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("file", "run", "commit_hash", "author", "email").agg(F.min("line").alias("start"), F.count("*").alias("lines"), F.max("at").alias("at")).drop("run")


def sync_git(spark: SparkSession, catalog, repo: str, limit: int = 500) -> None:
    """Commits and ownership of the tracked files into the tables ``commits`` and ``owners``.

    Blame is asked for file by file where the repository lies: in tasks, so the repository must be readable there.
    """
    from lodegraph.operators.evolution import ownership

    commits = git_commits(spark, repo, limit)
    catalog.upsert("commits", commits, ["hash", "file"])
    listed = subprocess.run(["git", "-C", repo, "ls-files", "-z"], capture_output=True, text=True, check=True).stdout
    files = spark.createDataFrame([(f,) for f in listed.split("\0") if f and f.rsplit(".", 1)[-1] in LANGUAGES], "file string")

    def blamed(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                if rows := blame_rows(repo, name):
                    yield pa.RecordBatch.from_pylist([dict(zip(BLAME_COLS, r)) for r in rows], schema=BLAME_SCHEMA)

    lines = files.repartition(max(1, min(200, files.count() // 8))).mapInArrow(blamed, "file string, line int, commit_hash string, author string, email string, at bigint")
    lines = catalog.replace("blame", lines)
    catalog.upsert("owners", ownership(lines), ["file", "author"])
