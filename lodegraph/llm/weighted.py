"""Document fingerprints by consistent weighted sampling.

The terms of a text (its words) are weighted by their counts.  For each of the K coordinates a
term draws r, c from Gamma(2, 1) and b from [0, 1), all fixed by the term; with weight S it has
t = floor(ln S / r + b) and the rank ln c - r (t - b + 1).  The coordinate is the term of least
rank together with its t, so two texts agree in a coordinate with probability equal to their
generalised Jaccard similarity (sum of lesser weights over sum of greater ones).

The draws come from three tables, each entered with its own part of the term's hash, so they need
no memory that grows with the vocabulary.

Defined cases: null texts are empty; texts without terms share the fingerprint of all ones, alike
to each other by 1 and to any other text by 0; equal texts have equal fingerprints; repeated rows
are neighbours in the order; null ids come last in the descending order; a table of one row is its
own next document; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.common import least_hashes, sliced_texts, spread, tidy

K = 128
TABLE_BITS = 11
_EMPTY = np.full(K, 0xFFFF, dtype=np.uint16)
_STATE: dict = {}


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, 1)
        return h


_WORDS = _Hashes()


def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of r, 1 / r, ln c and b: one row for each value of a part of the hash."""
    if "t" not in _STATE:
        rng = np.random.Generator(np.random.PCG64(20240))
        shape = (1 << TABLE_BITS, K)
        r = rng.gamma(2.0, 1.0, shape).astype(np.float32) + np.float32(1e-6)
        lnc = np.log(rng.gamma(2.0, 1.0, shape) + 1e-12).astype(np.float32)
        _STATE["t"] = r, (1 / r).astype(np.float32), lnc, rng.random(shape).astype(np.float32)
    return _STATE["t"]


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the distinct words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    return np.unique(h, return_counts=True)


def sample(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """K coordinates of 16 bits."""
    if not len(h):
        return _EMPTY
    r_t, inv_t, lnc_t, b_t = draws()
    mask = np.uint64((1 << TABLE_BITS) - 1)
    best = np.full(K, np.inf, dtype=np.float32)
    who = np.zeros(K, dtype=np.uint64)
    for i in range(0, len(h), 512):
        x, lns = h[i : i + 512], np.log(weights[i : i + 512]).astype(np.float32)[:, None]
        one, two, three = ((x >> np.uint64(s) & mask).astype(np.int64) for s in (3, 19, 37))
        r, b = r_t[one], b_t[three]
        t = np.floor(lns * inv_t[one] + b)
        rank = lnc_t[two] - r * (t - b + np.float32(1))
        at = rank.argmin(axis=0)
        k = np.arange(K)
        low = rank[at, k]
        better = low < best
        best = np.where(better, low, best)
        mix = (x[at] ^ (t[at, k].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        who = np.where(better, mix, who)
    return (who >> np.uint64(48)).astype(np.uint16)


def fingerprint(text: str) -> np.ndarray:
    return sample(*terms(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal coordinates; an empty text is like empty texts alone."""
    if (a is _EMPTY) != (b is _EMPTY):
        return 0.0
    return float(np.count_nonzero(a == b)) / K


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to as many from the start of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


#: Ids that are sampled for each range of ids.
SAMPLED = 50


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt by ranges of the id, with the first row of the next range beside them.

    Columns: id, text, part, extra.  In descending order of id each document needs the one behind
    it.  The ranges' bounds are quantiles of a sample of the ids (some for each of as many ranges as there
    are shuffle partitions), so a range holds a bounded share; the greatest row of each range goes to the
    range above as well.  A row finds its range among about sqrt(ranges) heads and then as many bounds.
    """
    spark = docs.sparkSession
    n = spread(spark)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType
    ids = least_hashes(src.select("id").where("id is not null"), src.count(), SAMPLED * n, "id") if n > 1 else src.select("id").limit(0)
    known = sorted(r.id for r in ids.collect())  # bounded by the number of ranges
    bounds = sorted({known[len(known) * i // n] for i in range(1, n)}) if known else []
    # number of bounds that the id exceeds, and one more; null ids stand below all others
    part = F.lit(0)
    if bounds:
        width = math.isqrt(len(bounds)) + 1
        groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
        listed = lambda x: F.array(*[F.lit(v).cast(kind) for v in x])
        above = lambda x: F.size(F.filter(x, lambda v: F.col("id") > v))
        group = above(listed([g[-1] for g in groups[:-1]])) if len(groups) > 1 else F.lit(0)
        inner = F.array(*[listed(g) for g in groups])[group]
        part = F.when(F.col("id").isNull(), 0).otherwise(group * width + above(inner) + 1)
    src = src.withColumn("part", part.cast("int"))
    first = sorted((r.part, r.id) for r in src.groupBy("part").agg(F.max("id").alias("id")).collect())  # a row per range
    heads = [(p, i, first[(k + 1) % len(first)][0]) for k, (p, i) in enumerate(first)]
    shape = T.StructType([T.StructField("head_part", T.IntegerType()), T.StructField("head", kind), T.StructField("to", T.IntegerType())])
    heads = F.broadcast(spark.createDataFrame(heads, shape))
    src = src.join(heads, (F.col("part") == F.col("head_part")) & F.col("id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))
    # the greatest id may stand in several rows: all of them go along, the first in order counts
    more = F.struct(F.col("to").alias("part"), F.lit(True).alias("extra"))
    goes = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, more))
    dealt = src.select("id", "text", F.explode(goes).alias("g")).select("id", "text", "g.part", "g.extra")
    # the range's number is the partition's: no two ranges meet in a task
    return dealt.repartitionById(n + 1, F.col("part")).sortWithinPartitions("part", F.col("extra").asc(), F.col("id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def row(doc_id, text, fp, after, after_fp):
        new = edited(text, after)
        fp2 = fingerprint(new)
        return (
            doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
            fp.astype(">u2").tobytes().hex(), fp2.astype(">u2").tobytes().hex(), likeness(fp, fp2), likeness(fp, after_fp),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            (id_col, id_type(kind)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ])
        held, part, closed = None, None, False  # the row that waits for its next document
        for whole in batches:
            for start, texts in sliced_texts(whole.column(1)):
                batch, out = whole.slice(start, len(texts)), []
                for doc_id, text, p, extra in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if p != part:
                        part, held, closed = p, None, False
                    if extra and closed:
                        continue
                    fp = fingerprint(text)
                    if held is not None:
                        out.append(row(*held, text, fp))
                    held = None if extra else (doc_id, text, fp)
                    closed = extra
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        tidy()

    out = f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, out)


def id_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
