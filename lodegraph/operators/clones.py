"""Exact clones by hash, near clones by cosine, and the clones of one symbol."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.expressions import cosine

#: Vectors of a tile, groups that a table is dealt into once it has so many tiles, most vectors of a group.
BLOCK, GROUPS, MOST = 2048, 32, 65536


def exact_groups(symbols: DataFrame) -> DataFrame:
    """body_hash, members, files: bodies that stand in more than one file (a class each, not its pairs)."""
    return symbols.groupBy("body_hash").agg(F.count("*").alias("members"), F.count_distinct("file").alias("files"), F.min("id").alias("first_id")).where("files > 1")


def exact_pairs(symbols: DataFrame) -> DataFrame:
    """first_id, id: each member of a class of equal bodies with the first member in another file."""
    firsts = symbols.groupBy("body_hash").agg(F.min(F.struct("id", "file")).alias("f"))
    return symbols.join(firsts, "body_hash").where((F.col("id") > F.col("f.id")) & (F.col("file") != F.col("f.file"))).select(F.col("f.id").alias("first_id"), "id")


def near_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """a, b, score of the pairs (a < b) from different files with a cosine of at least ``least``.

    All pairs are looked at: vectors are dealt into groups, and a task holds two groups, multiplies them in tiles of
    ``BLOCK`` and gives away the pairs of each tile.  A vector is copied once for each group: up to ``GROUPS * MOST``
    vectors there are ``GROUPS`` copies at most, so what is shuffled grows with the table; beyond, groups stay at
    ``MOST`` and copies grow.  Pairs that may reach ``least`` are scored in the task by the very sums of ``cosine``, one
    after the other along the vectors, so no vector travels again.
    """
    count = vectors.count()
    n = max(1, min(-(-count // BLOCK), GROUPS), -(-count // MOST))
    kind = vectors.schema["id"].dataType.simpleString()
    rows = vectors.where("v is not null").select("id", F.col("file").cast("string").alias("file"), "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select("*", other.alias("k")).select("id", "file", "v", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(frames, ignore_index=True)
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        v = np.array(frame["v"].tolist(), np.float64)
        size = np.sqrt(_summed(v, v))
        x = np.divide(v, size[:, None], out=np.zeros_like(v), where=size[:, None] > 0).astype(np.float32)
        near = least - 1e-5 - 1.5e-7 * v.shape[1]  # what single precision may lose
        own, ids, files = frame["own"].to_numpy(), frame["id"].to_numpy(), pd.factorize(frame["file"], use_na_sentinel=True)[0]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for a in range(0, len(left), BLOCK):
            for b in range(0, len(right), BLOCK):
                p, q = left[a : a + BLOCK], right[b : b + BLOCK]
                at, to = np.nonzero(x[p] @ x[q].T >= near)
                p, q = p[at], q[to]
                keep = (files[p] != files[q]) & (files[p] >= 0) & (files[q] >= 0) & ((ids[p] < ids[q]) if i == j else (ids[p] != ids[q]))
                p, q = p[keep], q[keep]
                p, q = np.where(ids[p] < ids[q], p, q), np.where(ids[p] < ids[q], q, p)
                sizes = size[p] * size[q]
                yield pd.DataFrame({"a": ids[p], "b": ids[q], "raw": np.divide(_summed(v[p], v[q]), sizes, out=np.zeros(len(p)), where=sizes > 0)})

    found = dealt.groupBy("i", "j").applyInPandas(meet, f"a {kind}, b {kind}, raw double")
    return found.select("a", "b", F.round("raw", 6).alias("score")).where(F.col("score") >= least)


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of rows, added in the order of ``expressions.dot``."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def similar_to(symbols: DataFrame, vectors: DataFrame, one: int, least: float, k: int) -> DataFrame:
    """id, score, clone_type: equal bodies in other files (1.0), then near vectors that are not among them."""
    me = symbols.where(F.col("id") == one).select(F.col("body_hash").alias("h"), F.col("file").alias("f"))
    exact = symbols.join(F.broadcast(me.limit(1)), F.col("body_hash") == F.col("h")).where((F.col("file") != F.col("f")) & (F.col("id") != one)).select("id", F.lit(1.0).alias("score"), F.lit("Exact").alias("clone_type"))
    q = vectors.where(F.col("id") == one).select(F.col("v").alias("q")).limit(1)
    near = vectors.where(F.col("id") != one).crossJoin(F.broadcast(q)).select("id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score")).where(F.col("score") >= least)
    near = near.join(exact.select("id"), "id", "left_anti").withColumn("clone_type", F.lit("Near"))
    return exact.unionByName(near).orderBy(F.desc("score"), "id").limit(k)
