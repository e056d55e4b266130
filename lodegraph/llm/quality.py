"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees on labelled rows yield their paths as conjunctive rules; logistic regression
with an L1 penalty weighs the rules, most of them by zero; what remains is compiled into one Spark
column expression over the statistics, so scoring runs in generated code.

The fit uses a bounded sample of labelled rows (``fit_rows``, those of least id hash), and only the
text's statistics: never labels of held-out rows, language, source or id.  Scoring covers all rows.

Defined cases: null and empty texts have statistics of zero and get a score; rows without a label
are scored alike; labels that are null are left out; without labels of both kinds the score is the
share of label 1 (0.5 without any); repeated rows have equal scores; an empty table gives an empty
table; columns whose names clash with the statistics keep their values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import least_hashes, settle, sliced_texts, tidy

STATS = (
    "bytes", "words", "lines", "upper", "lower", "digit", "stop", "bang", "bar", "symbol", "space", "wide",
    "word_len", "longest", "distinct", "repeat", "top", "line_distinct", "line_len",
)
_PREFIX = "__stat_"
_CLASS = np.zeros((256, 9), dtype=np.float64)
for _b in range(256):
    for _k, _on in enumerate((
        65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _b in b".,;:?", _b == 33, _b == 124,
        33 <= _b < 127 and not chr(_b).isalnum() and _b not in b".,;:?!|", _b in b" \t\n\r\x0b\x0c", _b > 127,
    )):
        _CLASS[_b, _k] = _on


@dataclass(frozen=True)
class Params:
    fit_rows: int = 20_000
    trees: int = 24
    depth: int = 3
    rate: float = 0.3
    bins: int = 48
    penalty: float = 0.0008
    rounds: int = 250
    seed: int = 5


def statistics(text: str | None) -> list[float]:
    """The statistics of a text, in the order of ``STATS``; shares are of bytes, words or lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [float(len(raw))] + [0.0] * (len(STATS) - 1)
    kinds = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS) / len(raw)
    n = len(words)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(len(raw)), float(n), float(len(lines)), *kinds.tolist(), sum(map(len, words)) / n, float(max(map(len, words))), len(seen) / n,
        sum(map(eq, words, words[1:])) / n, max(seen.values()) / n, len(set(lines)) / len(lines), len(raw) / len(lines),
    ]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column for each statistic (named with a prefix that is kept free)."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in sliced_texts(batch.column(at)):
                b = batch.slice(start, len(texts))
                rows = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(b.num_rows, len(STATS))
                cols = [*b.columns, *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(STATS)))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *(_PREFIX + s for s in STATS)])
        tidy()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, fields + "".join(f", {_PREFIX}{s} double" for s in STATS))


# --- trees, rules and weights -----------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold)


def tree_rules(x: np.ndarray, y: np.ndarray, p: Params) -> list[Rule]:
    """The paths of boosted trees: each split chosen by the gain of the logistic loss over binned values."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rng = np.random.Generator(np.random.PCG64(p.seed))
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    width = p.bins + 1

    def grow(rows: np.ndarray, path: Rule, depth: int, fs: np.ndarray) -> None:
        g, h = grad[rows], hess[rows]
        if depth < p.depth and len(rows) >= 20:
            best = (1e-6, 0, 0)
            for f in fs:
                sg = np.cumsum(np.bincount(binned[rows, f], g, width))[: len(edges[f])]
                sh = np.cumsum(np.bincount(binned[rows, f], h, width))[: len(edges[f])]
                if len(sg):
                    gain = sg**2 / (sh + 1) + (g.sum() - sg) ** 2 / (h.sum() - sh + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(sh < 1) | (h.sum() - sh < 1)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], int(f), k)
            if best[0] > 1e-6:
                _, f, k = best
                low = binned[rows, f] <= k
                for above, part in ((False, rows[low]), (True, rows[~low])):
                    longer = tuple(sorted({*path, (f, above, float(edges[f][k]))}))
                    rules[longer] = None
                    grow(part, longer, depth + 1, fs)
                return
        margin[rows] += p.rate * -g.sum() / (h.sum() + 1)

    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        grow(np.arange(len(y)), (), 0, rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)])
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) == above for f, above, t in rule])


def lasso(on: np.ndarray, y: np.ndarray, p: Params) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal steps."""
    a = on.astype(np.float32)
    n = len(y)
    v = np.random.Generator(np.random.PCG64(1)).random(a.shape[1]).astype(np.float32)
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = a.T @ (a @ v)
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-9)
    step = 4.0 / (top / n + 1.0)
    w, b = np.zeros(a.shape[1], np.float32), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(p.rounds):
        r = 1 / (1 + np.exp(-(a @ zw + zb))) - y
        new = zw - step * (a.T @ r.astype(np.float32)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * p.penalty, 0)
        nb = zb - step * float(r.mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        zw, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new.astype(np.float32), nb, t2
    return b, w


@dataclass(frozen=True)
class Rules:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The ensemble as one column over the statistics."""
        def one(rule: Rule, weight: float) -> Column:
            tests = [(F.col(_PREFIX + STATS[f]) > t) if above else (F.col(_PREFIX + STATS[f]) <= t) for f, above, t in rule]
            return F.when(reduce(lambda a, b: a & b, tests), F.lit(weight)).otherwise(F.lit(0.0))

        total = reduce(lambda a, b: a + b, [one(r, w) for r, w in self.rules], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def fit(stats: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id") -> Rules:
    """Rules learned from the labelled rows of ``stats`` that are not held out."""
    known = labels.select(F.col(id_col).alias("id__"), F.col("quality").alias("y__")).where("y__ is not null").where(~held_out("id__"))
    rows = stats.join(known, stats[id_col] == known["id__"]).select("id__", "y__", *[_PREFIX + s for s in STATS])
    got = least_hashes(rows, known.count(), p.fit_rows, "id__", _PREFIX + STATS[0], "y__").toPandas()
    y = got["y__"].to_numpy(dtype=np.float64)
    x = got[[_PREFIX + s for s in STATS]].to_numpy(dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Rules(float(np.log((share + 1e-6) / (1 - share + 1e-6))), ())
    found = tree_rules(x, y, p)
    intercept, weights = lasso(np.stack([holds(r, x) for r in found], axis=1), y, p)
    return Rules(float(intercept), tuple((r, float(w)) for r, w in zip(found, weights) if w))


def scores(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score, predicted of every row."""
    stats = settle(with_statistics(docs.select(id_col, F.col(text_col).cast("string").alias("text"))).drop("text"), "stats")
    rules = fit(stats, labels, p, id_col)
    scored = stats.select(id_col, held_out(id_col).alias("held_out"), rules.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, unchanged."""
    stats = settle(with_statistics(docs, text_col), "stats")
    rules = fit(stats, labels, p, id_col)
    return stats.where(rules.score() >= least).select(*[f"`{c}`" for c in docs.columns])
