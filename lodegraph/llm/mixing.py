"""Mixing sources to target weights, in blocks of words.

Each source's documents are laid end to end and cut into blocks of a fixed number of words.  Every
output shard draws how many of its slots each source fills: a multinomial draw, given the slots that
each source fills in all shards together (see ``Draws``), so shards vary as drawn and the whole mix meets its
targets.  The slots of a source, numbered through all shards, are mapped to its blocks by a pseudorandom
permutation of the block numbers (a Feistel network with cycle walking), starting over when all blocks
are used; slots and blocks are joined by block number.  Since a target never exceeds three times its
source, no block is used more than three times.

Only sizes and numbers are shuffled, never texts.  A source that holds a third of all rows is laid
out in many lanes (by a hash of the document, about ``lane_rows`` rows of the table in each), each
numbered on its own and shifted by the sizes of the lanes before it.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of
its own, the last in order; a source without words has target 0; documents with equal ids are laid
out by their size; repeated rows each have their own words; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodegraph.llm.common import free_name, settle, sliced_texts, tidy

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    """block: words of a block; slots: of an output shard; weights: repeated over the sources in order; lane_rows: see above."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    block: int = 32
    slots: int = 4096
    lane_rows: int = 20_000
    seed: int = 11


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, src, size, twin of each row: the number of words is counted where the text is read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in sliced_texts(batch.column(2)):
                b = batch.slice(start, len(texts))
                n = [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), b.column(3)], names=["id", "src", "size", "twin"])

    cols = [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.col(text_col).cast("string").alias("text")]
    return docs.select(*cols, F.xxhash64(F.col(text_col)).alias("twin")).mapInArrow(run, f"id {kind}, src string, size bigint, twin bigint")


def targets(sizes: DataFrame, p: Params) -> DataFrame:
    """src, source_size, number, target: one row per source (the mixture's own dimension).

    Sources reach their limit in the order of limit over weight, so the level at which the rest is
    shared follows from running sums.
    """
    w = F.array(*[F.lit(x) for x in p.weights])
    rank = F.row_number().over(W.orderBy(F.col("src").asc_nulls_last())) - 1
    s = sizes.groupBy("src").agg(F.sum("size").alias("source_size")).withColumn("number", rank)
    s = s.withColumn("weight", w[F.col("number") % len(p.weights)].cast("double"))
    limit = F.col("source_size") * p.most
    order = W.orderBy(limit / F.col("weight"), "number").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = s.withColumn("all", F.sum("source_size").over(every)).withColumn("all_w", F.sum("weight").over(every))
    s = s.withColumn("left", F.col("all") - F.coalesce(F.sum(limit).over(order), F.lit(0)))
    s = s.withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    s = s.withColumn("full", limit * F.col("left_w") <= F.col("left") * F.col("weight"))
    # the shared rest: what the sources under their limit find
    s = s.withColumn("rest", F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), limit)).over(every), F.lit(0)))
    s = s.withColumn("rest_w", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(every))
    share = F.when(F.col("full"), limit.cast("double")).otherwise(F.col("rest") * F.col("weight") / F.col("rest_w"))
    return s.select("src", "source_size", "number", share.alias("target"))


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position of j under the permutation of range(n) that belongs to key, element by element."""
    bits = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = j.astype(np.uint64), np.arange(len(j))
    limit, key = n.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        b, m, k, x = bits[todo], mask[todo], key[todo], out[todo]
        left, right = x >> b, x & m
        for r in range(4):
            f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(31)
            f *= np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & m)
        x = left << b | right
        out[todo] = x
        todo = todo[x >= limit[todo]]
    return out.astype(np.int64)


class Draws:
    """Multinomial source counts of every output shard, given the sums over all shards.

    The shards are the leaves of a tree.  A node hands its slots of every source to its halves by a
    multivariate hypergeometric draw of its own seed, which is the multinomial draw of the halves given
    their sum; so any shard's counts, and the slots of each source in the shards before it, follow
    from one walk from the root.  Above 10^9 slots, where the draw's spread is below 1 in 30,000, a node
    splits in proportion.
    """

    def __init__(self, want: np.ndarray, most: np.ndarray, p: Params):
        total = max(1, round(float(want.sum())))
        whole = np.minimum(np.floor(want).astype(np.int64), most)
        # the slots that flooring leaves go by the largest remainder to sources that have room
        order = np.argsort(-(want - whole), kind="stable")
        for k in order[whole[order] < most[order]][: max(0, total - int(whole.sum()))]:
            whole[k] += 1
        self.counts, self.total, self.p = whole, int(whole.sum()), p
        self.shards = -(-self.total // p.slots)

    def shard(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots of each source in the shards before it, slots of each source in it)."""
        ahead, counts, lo, hi = np.zeros_like(self.counts), self.counts, 0, self.shards
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = min(mid * self.p.slots, self.total) - lo * self.p.slots
            rng = np.random.Generator(np.random.PCG64([self.p.seed, lo, hi]))
            if (n := int(counts.sum())) < 10**9:
                part = rng.multivariate_hypergeometric(counts, left, method="marginals")
            else:
                ends = np.cumsum(counts)
                part = np.diff(np.array([int(e) * left // n for e in ends], np.int64), prepend=0)
            if shard < mid:
                hi, counts = mid, part
            else:
                lo, ahead, counts = mid, ahead + part, counts - part
        return ahead, counts


def block_uses(sources: DataFrame, p: Params) -> DataFrame:
    """number, block, uses: how often the mix takes each block of each source.

    The sources' rows (one per source) are collected: they are the mixture's parameters.
    """
    spark = sources.sparkSession
    rows = sources.where("source_size > 0").orderBy("number").collect()
    if not rows:
        return spark.createDataFrame([], "number int, block bigint, uses bigint")
    number = [r.number for r in rows]
    blocks = np.array([-(-r.source_size // p.block) for r in rows], dtype=np.int64)
    want = np.array([r.target for r in rows]) * blocks / np.array([r.source_size for r in rows])
    draws = Draws(want, p.most * blocks, p)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, np.ndarray] = {}
        for b in batches:
            for shard in b.column(0).to_pylist():
                for k, (first, n) in enumerate(zip(*(x.tolist() for x in draws.shard(shard)))):
                    if not n:
                        continue
                    if k not in keys:  # one permutation for each time that the source starts over
                        names = [f"{p.seed}:{number[k]}:{e}".encode() for e in range(p.most)]
                        keys[k] = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big") for x in names], dtype=np.uint64)
                    j, nb = np.arange(first, first + n, dtype=np.int64), int(blocks[k])
                    at = permuted(j % nb, np.full(n, nb), keys[k][j // nb])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number[k]), pa.int32()), pa.array(at, pa.int64())], names=["number", "block"])

    placed = spark.range(draws.shards).mapInArrow(place, "number int, block bigint")
    return placed.groupBy("number", "block").agg(F.count("*").alias("uses"))


def laid_out(sizes: DataFrame, sources: DataFrame, p: Params) -> DataFrame:
    """id, src, size, twin, number, source_size, target, start: place of each row in its source's words."""
    lanes = max(256, -(-sizes.count() // p.lane_rows))
    rows = sizes.withColumn("lane", F.pmod(F.xxhash64("id", "twin"), F.lit(lanes)))
    lanes = rows.groupBy("src", "lane").agg(F.sum("size").alias("ls"))
    ahead = W.partitionBy("src").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    lanes = lanes.withColumn("ahead", F.coalesce(F.sum("ls").over(ahead), F.lit(0))).drop("ls")
    named = sources.select(F.col("src").alias("src2"), "number", "source_size", "target")  # a row per source
    lanes = lanes.join(F.broadcast(named), F.col("src").eqNullSafe(F.col("src2"))).drop("src2")
    run = W.partitionBy("src", "lane").orderBy("id", "twin", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("in_lane", F.coalesce(F.sum("size").over(run), F.lit(0)))
    key = [F.coalesce("src", F.lit("")), F.col("src").isNull(), F.col("lane")]
    names = ["k0", "k1", "k2"]
    left = rows.select("*", *[c.alias(n) for c, n in zip(key, names)])
    right = lanes.select("number", "source_size", "target", "ahead", *[c.alias(n) for c, n in zip(key, names)])
    return left.join(right, names).select(
        "id", "src", "size", "twin", "number", "source_size", "target", (F.col("ahead") + F.col("in_lane")).alias("start")
    )


def taken_blocks(laid: DataFrame, uses: DataFrame, p: Params) -> DataFrame:
    """The rows' words by block: id, twin, start, lo, n, uses (lo, n: words of the row in the block)."""
    first, last = F.floor(F.col("start") / p.block), F.floor((F.col("start") + F.col("size") - 1) / p.block)
    parts = laid.where("size > 0").select("id", "twin", "number", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * p.block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * p.block)
    # the planner takes the unfolded slots for few rows: neither side has a bound, so neither is broadcast
    return parts.join(uses.hint("merge"), ["number", "block"]).select("id", "twin", "number", "start", (lo - F.col("start")).alias("lo"), (hi - lo).alias("n"), "uses")


def mix(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, size, source_size, target, taken of every row."""
    sizes = settle(sized(docs, id_col, text_col, source_col), "sizes")
    sources = settle(targets(sizes, p), "sources")
    laid = settle(laid_out(sizes, sources, p), "laid")
    # a row is known by its source and the place where its words start
    got = taken_blocks(laid, block_uses(sources, p), p).groupBy("number", "start").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    some = laid.where("size > 0").join(got.hint("merge"), ["number", "start"], "left")
    none = laid.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = [F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")]
    return some.select(*cols).unionAll(none.select(*cols))


_WORD = re.compile(WORDS)


def pick(text: str, pieces: list[dict], most: int) -> list[str]:
    """The texts that the mix takes of a document: one for each time it is used, of the words taken that time."""
    out, spans = [], None
    pieces = sorted(pieces, key=lambda x: x["lo"])
    for k in range(most):
        runs: list[list[int]] = []
        for x in pieces:
            if x["uses"] > k:
                if runs and runs[-1][1] == x["lo"]:
                    runs[-1][1] += x["n"]
                else:
                    runs.append([x["lo"], x["lo"] + x["n"]])
        if not runs:
            break
        if spans is None:
            spans = [m.span() for m in _WORD.finditer(text)]
        whole = runs == [[0, len(spans)]]
        out.append(text if whole else " ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs))
    return out


def mixed(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mixture as rows of ``docs``: each document as often as it is used, with the words taken each time.

    Documents without words are taken by none; repeated rows each give the words of their own place.
    """
    sizes = settle(sized(docs, id_col, text_col, source_col), "sizes")
    sources = settle(targets(sizes, p), "sources")
    laid = settle(laid_out(sizes, sources, p), "laid")
    parts = taken_blocks(laid, block_uses(sources, p), p)
    lists = parts.groupBy("id", "twin", "number", "start").agg(F.collect_list(F.struct("lo", "n", "uses")).alias("pieces"))
    # the pieces of every row of a repeated id and text, in the order of their places
    places = laid.where("size > 0").groupBy(F.col("id").alias("id2"), F.col("twin").alias("twin2"), F.col("number").alias("number2")).agg(F.sort_array(F.collect_list("start")).alias("starts"))
    lists = lists.groupBy("id", "twin", "number").agg(F.map_from_entries(F.collect_list(F.struct("start", "pieces"))).alias("by_start"))
    lists = lists.join(places.hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("twin") == F.col("twin2")) & (F.col("number") == F.col("number2")))
    id_, twin_, number_, pieces_ = (free_name(docs, x) for x in ("id", "twin", "number", "pieces"))
    found = F.transform("starts", lambda x: F.col("by_start")[x])
    lists = settle(lists.select(F.col("id").alias(id_), F.col("twin").alias(twin_), F.col("number").alias(number_), found.alias(pieces_)), "pieces")
    names = docs.columns
    at = {c: names.index(c) for c in (text_col, *([length_col] if length_col in names else []))}
    most = p.most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in sliced_texts(batch.column(at[text_col]), 4_000_000):
                b = batch.slice(start, len(texts))
                rows, new = [], []
                for i, (t, x) in enumerate(zip(texts, b.column(len(names)).to_pylist())):
                    for part in pick(t, x or [], most):
                        rows.append(i)
                        new.append(part)
                take = pa.array(rows, pa.int64())
                cols = [b.column(k).take(take) for k in range(len(names))]
                cols[at[text_col]] = pa.array(new, cols[at[text_col]].type)
                if length_col in at:
                    cols[at[length_col]] = pa.array([len(t) for t in new], cols[at[length_col]].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)
        tidy()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    own = [F.col(f"`{c}`") for c in names]
    src_, n_ = free_name(docs, "src"), free_name(docs, "n")
    source = sources.select(F.col("src").alias(src_), F.col("number").alias(n_))  # a row per source
    numbered = docs.join(F.broadcast(source), F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(src_)))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(twin_)) & (F.col(n_) == F.col(number_))
    keyed = numbered.join(lists, same)
    one = keyed.where(F.size(pieces_) == 1).select(*own, F.col(pieces_)[0].alias(pieces_))
    if not lists.where(F.size(pieces_) > 1).isEmpty():
        order = W.partitionBy(id_, twin_, number_).orderBy(F.xxhash64(*own))
        again = keyed.where(F.size(pieces_) > 1).withColumn(n_, F.row_number().over(order))
        one = one.unionAll(again.select(*own, F.col(pieces_)[F.col(n_) - 1].alias(pieces_)))
    return one.mapInArrow(run, fields)
