"""Approximate nearest neighbours by largest inner product: inverted file with product-quantised residuals.

The model is fitted on a bounded sample (``fit_rows`` rows of least id hash): coarse centroids, whose
number follows the square root of the table, and codebooks for the residuals' parts.  Every row is
indexed: its list, its codes, its vector.  A query probes the lists whose centroids are nearest to
it; within a list an asymmetric distance table per query scores the codes, the best ``shortlist``
of each block are scored exactly in double precision, and the ``k`` best of all blocks win.

Large lists are cut into chunks of about ``chunk`` rows and the queries into blocks, so no task
holds a whole list, however many equal vectors it has.  What a block returns is cut by a bound:
the (k + spare)-th best score among the sample's rows in the lists that the query visits anyway,
which no neighbour that the search can find is under.

Defined cases: null vectors, zero vectors, vectors with null or non-finite components and vectors
of another length than most of the sample's take no part; fewer candidates than ``k`` are all
returned; equal scores go by the smaller id; repeated ids are rows of their own but never a
neighbour of that id; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodegraph.llm.common import least_hashes, settle, spread


@dataclass(frozen=True)
class Params:
    """probe: share of the lists that a query visits (8 at least); spare: ranks by which the bound is
    lowered; part: dimensions of a code's part; errors: standard errors of a code's score within which
    a row is scored exactly although it isn't on the shortlist."""

    k: int = 20
    every: int = 20
    fit_rows: int = 20_000
    most_lists: int = 1024
    probe: float = 0.85
    spare: int = 10
    part: int = 4
    shortlist: int = 64
    errors: float = 2.5
    chunk: int = 4096
    query_block: int = 4096
    seed: int = 3


def _lloyd(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Model:
    def __init__(self, sample_ids: np.ndarray, sample: np.ndarray, rows: int, p: Params):
        rng = np.random.Generator(np.random.PCG64(p.seed))
        self.p, self.ids, self.sample = p, sample_ids, sample
        x = sample.astype(np.float32)
        self.d = x.shape[1]
        lists = int(min(p.most_lists, max(1, round(math.sqrt(rows))), len(x)))
        self.coarse = _lloyd(x, lists, 8, rng)
        self.parts = np.array_split(np.arange(self.d), max(1, self.d // p.part))
        self.at = self.nearest(x)
        rest = x - self.coarse[self.at]
        self.books = [_lloyd(np.ascontiguousarray(rest[:, s]), min(256, len(x)), 6, rng) for s in self.parts]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.coarse * self.coarse).sum(1)[None, :] - 2 * x @ self.coarse.T, axis=1)

    def codes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[at]
        return np.stack([np.argmin((b * b).sum(1)[None, :] - 2 * rest[:, s] @ b.T, axis=1) for s, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, at: int) -> np.ndarray:
        out = np.repeat(self.coarse[at][None, :].astype(np.float64), len(codes), axis=0)
        for j, (s, b) in enumerate(zip(self.parts, self.books)):
            out[:, s] += b[codes[:, j]]
        return out

    def probes(self, q: np.ndarray) -> np.ndarray:
        n = min(len(self.coarse), max(8, math.ceil(self.p.probe * len(self.coarse))))
        return np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")[:, :n]

    def bound(self, ids: np.ndarray, q: np.ndarray, probes: np.ndarray) -> np.ndarray:
        """A score that the k best of each query's visited lists reach; minus infinity if the sample is too small."""
        k = self.p.k + self.p.spare
        s = q @ self.sample.T
        visited = np.zeros((len(q), len(self.coarse)), bool)
        np.put_along_axis(visited, probes, True, axis=1)
        s[~visited[:, self.at] | (self.ids[None, :] == ids[:, None])] = -np.inf
        if s.shape[1] < k:
            return np.full(len(q), -np.inf)
        low = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return np.where(np.isfinite(low), low - 1e-9 * (1 + np.abs(low)), -np.inf)


def _valid(batch: pa.RecordBatch, d: int | None, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that take part: known ids, ``d`` finite components (by default as many as most rows have), not all zero."""
    v = batch.column(1)
    ok = ~(v.is_null().to_numpy(zero_copy_only=False) | batch.column(0).is_null().to_numpy(zero_copy_only=False))
    off = v.offsets.to_numpy()
    size = np.diff(off)
    if d is None:
        d = int(np.bincount(size[ok & (size > 0)]).argmax()) if (ok & (size > 0)).any() else 0
    rows = np.flatnonzero(ok & (size == d) & (d > 0))
    flat = v.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)  # null components become NaN
    x = flat[off[rows][:, None] + np.arange(d)] if len(rows) else np.empty((0, d), dtype)
    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
    ids = batch.column(0).to_numpy(zero_copy_only=False)[rows[good]]
    return ids.astype(np.int64), np.ascontiguousarray(x[good])


def fit(rows: DataFrame, p: Params, dtype) -> Model | None:
    """The model of the rows (id, v); the sample is all that reaches the driver."""
    n = rows.count()
    sample = least_hashes(rows.where("v is not null and id is not null"), n, p.fit_rows, "id").toArrow()
    table = sample.combine_chunks().to_batches()
    if not table:
        return None
    ids, x = _valid(table[0], None, dtype)
    return Model(ids, x.astype(np.float64), n, p) if len(ids) else None


def neighbours(table: DataFrame, p: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of every row whose id is divisible by ``every``."""
    spark = table.sparkSession
    element = table.schema[vector_col].dataType.elementType.simpleString()
    dtype = np.dtype("<f4" if element == "float" else "<f8")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    model = fit(rows, p, dtype)
    if model is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = spark.sparkContext.broadcast(model)  # the sample and the codebooks, bounded by fit_rows and most_lists

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ids, x = _valid(b, m.d, dtype)
            if len(ids):
                f = x.astype(np.float32)
                at = m.nearest(f)
                rec = np.concatenate((m.codes(f, at), x.view(np.uint8).reshape(len(x), -1)), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in rec], pa.binary())], names=["id", "list", "rec"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 512):
                ids, x = _valid(b.slice(start, 512), m.d, dtype)
                if len(ids):
                    q = x.astype(np.float64)
                    at = m.probes(q.astype(np.float32))
                    rec = np.concatenate((m.bound(ids, q, at)[:, None].view(np.uint8).reshape(len(x), -1), x.view(np.uint8).reshape(len(x), -1)), axis=1)
                    recs = [r.tobytes() for r in rec]
                    n = at.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(at.reshape(-1).astype(np.int32)), pa.array([r for r in recs for _ in range(n)], pa.binary())], names=["id", "list", "rec"])

    schema = "id bigint, list int, rec binary"
    indexed = settle(rows.mapInArrow(index, schema), "index")
    asked = settle(rows.where(F.col("id") % p.every == 0).mapInArrow(probe, schema), "queries")
    blocks = max(1, math.ceil(rows.where(F.col("id") % p.every == 0).count() / p.query_block))
    # one row per list
    sizes = indexed.groupBy("list").agg(F.ceil(F.count("*") / p.chunk).cast("int").alias("chunks"))
    left = indexed.join(F.broadcast(sizes), "list").select(
        "list", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "rec"
    )
    right = asked.join(F.broadcast(sizes), "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "rec"
    )
    key = ["list", "chunk", "block"]
    work = left.unionByName(right).repartition(spread(spark), *key).sortWithinPartitions(*key, "kind", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        parts = len(m.parts)
        now, q_ids, q_recs, c_ids, c_recs = None, [], [], [], []

        def scores():
            if not q_ids or not c_ids:
                return
            raw = np.frombuffer(b"".join(c_recs), np.uint8).reshape(len(c_ids), -1)
            # equal vectors are scored once; of each only the k + 1 smallest ids can be wanted
            _, head, group = np.unique(raw.view(f"V{raw.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
            by_group = np.lexsort((np.array(c_ids), group))
            first = np.searchsorted(group[by_group], np.arange(len(head)))
            count = np.minimum(np.diff(np.append(first, len(group))), p.k + 1)
            cand = np.array(c_ids)[by_group]
            codes, vec = raw[head, :parts], np.ascontiguousarray(raw[head, parts:]).view(dtype).astype(np.float64)
            off = np.linalg.norm(vec - m.decoded(codes, now[0]), axis=1).astype(np.float32)
            r = min(len(head), p.shortlist)
            for s in range(0, len(q_ids), 256):
                ask = np.array(q_ids[s : s + 256])
                raw_q = np.frombuffer(b"".join(q_recs[s : s + 256]), np.uint8).reshape(len(ask), -1)
                bound = np.ascontiguousarray(raw_q[:, :8]).view(np.float64)[:, 0]
                q = np.ascontiguousarray(raw_q[:, 8:]).view(dtype).astype(np.float64)
                f = q.astype(np.float32)
                near = np.repeat((f @ m.coarse[now[0]])[:, None], len(head), axis=1)
                for j, (dims, book) in enumerate(zip(m.parts, m.books)):
                    near += np.take(f[:, dims] @ book.T, codes[:, j], axis=1)
                # the best of the block, and all that may reach the bound for all their codes' error
                slack = p.errors * np.sqrt((q * q).sum(axis=1) / m.d)[:, None] * off[None, :]
                maybe = (near + slack >= bound[:, None]) & np.isfinite(bound)[:, None]
                np.put_along_axis(maybe, np.argpartition(-near, r - 1, axis=1)[:, :r], True, axis=1)
                row, g = np.nonzero(maybe)
                exact = np.concatenate([np.einsum("nd,nd->n", q[row[i : i + 65536]], vec[g[i : i + 65536]]) for i in range(0, len(row), 65536)])
                good = exact >= bound[row]
                row, g, exact = row[good], g[good], exact[good]
                if not len(row):
                    continue
                n = count[g]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, score, ids = np.repeat(row, n), np.repeat(exact, n), cand[np.repeat(first[g], n) + step]
                other = ids != ask[row]
                row, score, ids = row[other], score[other], ids[other]
                order = np.lexsort((ids, -score, row))
                row, score, ids = row[order], score[order], ids[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                top = rank < p.k
                yield pa.RecordBatch.from_arrays([pa.array(ask[row[top]]), pa.array(ids[top]), pa.array(score[top])], names=["query_id", "vec_id", "score"])

        for b in batches:
            for l, c, k, kind, i, rec in zip(*(x.to_pylist() for x in b.columns)):
                if (l, c, k) != now:
                    yield from scores()
                    now, q_ids, q_recs, c_ids, c_recs = (l, c, k), [], [], [], []
                if kind == 0:
                    q_ids.append(i)
                    q_recs.append(rec)
                elif q_ids:
                    c_ids.append(i)
                    c_recs.append(rec)
                    if len(c_ids) >= p.chunk:
                        yield from scores()
                        c_ids, c_recs = [], []
        yield from scores()

    found = work.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
