"""Near-duplicate detection by circulant MinHash.

Two permutations of a hash universe give all coordinates of a signature: the first scatters the
shingles over the universe, the second is shifted circularly by k places for coordinate k, and
the coordinate is the least value over a document's shingles.  Bands of the signature make
candidates; every candidate is confirmed by the exact Jaccard similarity of the full sets.

Documents with one and the same set form a class that is represented by its smallest id, so
copies never meet in pairs.  In a bucket (one band value) every member is compared with one
hub; verified links are merged into components, and a bucket whose members are all in one
component needs no more comparisons.  The documents of the other buckets, which may share no more
than a common passage, are dealt into buckets of a rare shared shingle: two sets that are alike
enough have one in common among their rarest few (see ``rare_buckets``), so none of their links
is lost.  There every member meets a few hubs, which leave for the next ones until every pair of a
bucket that may still join two components has been compared.  No bucket is expanded into all its pairs.

Defined cases: null or empty texts, and texts without words, have no shingles, are linked with
nothing and are kept; fewer words than a shingle make one shingle of the whole sequence; repeated
rows fall into one class; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import discard, settle, sliced_texts, tidy

UNIVERSE_BITS = 20
#: Hubs of a bucket in one round, so that a row that meets them stays small.
MOST_HUBS = 1024
#: Tasks over which the rows of one frequent bucket or hub are dealt out.
SALTS = 16


@dataclass(frozen=True)
class Params:
    """words: of a shingle; alike: least similarity in hundredths; bands x rows: of a signature.

    80 bands of 8 rows miss a pair of similarity 0.8 with probability 4e-7, and meet a pair of
    similarity 0.1 with probability 8e-7, so chance meetings stay few as the corpus grows.
    """

    words: int = 5
    alike: int = 80
    bands: int = 80
    rows: int = 8
    seed: int = 7


_STATE: dict = {}


def permutations(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The scatter (as keys of a bijective mix) and the windows of the circular permutation."""
    key = (p.bands * p.rows, p.seed)
    if key not in _STATE:
        _STATE.clear()
        size, k = 1 << UNIVERSE_BITS, p.bands * p.rows
        rng = np.random.Generator(np.random.PCG64(p.seed))
        sigma = rng.permutation(size).astype(np.int32)
        pi = rng.permutation(size).astype(np.int32)
        _STATE[key] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[:k])), k)
    return _STATE[key]


class WordHashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def forget() -> None:
    """Drop what a task has gathered, so that a reused worker starts the next stage small."""
    _WORDS.clear()
    _STATE.clear()
    tidy()


_MIX, _ROT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased, ASCII white space)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
        out ^= out >> _ROT
    return np.unique(out)


def signature(items: np.ndarray, p: Params) -> np.ndarray:
    """All bands x rows coordinates of one set."""
    sigma, windows = permutations(p)
    at = sigma[(items >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    best = windows[at[:256]].min(axis=0)
    for i in range(256, len(at), 256):
        np.minimum(best, windows[at[i : i + 256]].min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, p: Params) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = sig.reshape(p.bands, p.rows).astype(np.uint64)
    key = np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(p.rows):
        key = (key ^ rows[:, j]) * _MIX
        key ^= key >> _ROT
    return key.view(np.int64)


def sketches(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, digest of the set and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in sliced_texts(batch.column(1)):
                ns, digests, bands, off = [], [], [], [0]
                for text in texts:
                    items = shingle_set(text, p.words)
                    ns.append(len(items))
                    digests.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                    if len(items):
                        bands.append(band_keys(signature(items, p), p))
                    off.append(off[-1] + p.bands * bool(len(items)))
                flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat)],
                    names=["id", "n_shingles", "digest", "bands"],
                )
        forget()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_shingles bigint, digest binary, bands array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """id, n, items (the whole set) of the ``wanted`` (id, digest); no other document's set is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in sliced_texts(batch.column(1), 2_000_000):
                part = batch.slice(start, len(texts))
                ids, sets, off = [], [], [0]
                for key, text, digest in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist()):
                    items = shingle_set(text, p.words)
                    if len(items) and xxhash.xxh3_128_digest(items.tobytes()) == digest:
                        ids.append(key)
                        sets.append(items.view(np.int64))
                        off.append(off[-1] + len(items))
                flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, part.column(0).type), pa.array(np.diff(off), pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat)],
                    names=["id", "n", "items"],
                )
        forget()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, "id")
    return rows.select("id", "text", "digest").mapInArrow(run, f"id {kind}, n bigint, items array<bigint>")


def components(links: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): root is the least id that can be reached.

    Large-star and small-star in turn; each step is a grouped minimum and an equi-join, written
    to the shared folder.  Nothing is collected but two counts a round.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    for _ in range(most):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large, name)
        discard(edges)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        edges = settle(small.where("a <> b").distinct(), name)
        discard(large)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).head()
        if (row[0], row[1]) == before and row[0] == row[2]:
            break
        before = row[0], row[1]
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def spread_join(rows: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``other`` (at most one row a key), with a frequent key's rows dealt out over ``SALTS`` tasks.

    The other side is copied to the (key, salt) that do occur: at most ``SALTS`` copies, and never more than rows.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    wanted = salted.select(key, "salt").distinct().join(other, key)
    return salted.join(wanted, [key, "salt"]).drop("salt")


def verify(pairs: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= alike * union."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        spread_join(spread_join(pairs, left, "a", "b"), right, "b", "a")
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
        .where(F.col("both") * 100 >= F.col("either") * alike)
        .select("a", "b")
    )


def with_roots(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows of ``buckets`` with the root of each id: itself where it has no link yet."""
    if roots is None:
        return buckets.withColumn("root", F.col("id"))
    return buckets.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def rare_buckets(buckets: DataFrame, roots: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """(id, n, rest, band) of the documents whose buckets still hold two components; band is a rare shingle.

    Sets a and b with 100 * intersection >= alike * union share at least ceil(alike / 100 * n) items
    for the n of either.  In any order of all items, the first n - ceil(alike / 100 * n) + 1 of a and
    of b then have an item in common.  The order here is from rare to frequent, so that a passage
    common to many documents is in no prefix unless it is nearly the whole document.  ``rest`` counts
    the items from this one on: the first item that a and b have in common has their whole intersection
    after it, so a pair that no bucket gives rest enough for is none.  Rows that have too little rest
    for even the least set of their bucket go at once.
    """
    state = with_roots(buckets, roots)
    live = state.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    ids = settle(spread_join(state, live.select("band"), "band", "id").select("id").distinct(), "live")
    items = sets.join(ids, "id", "left_semi").select("id", "n", F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    shared = items.join(often, "item").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("s"))
    first = F.col("n") - F.ceil(F.col("n") * p.alike / 100) + 1 - (F.col("n") - F.size("s"))
    place = F.explode(F.transform(F.slice("s", F.lit(1), F.col("first")), lambda x, i: F.struct(x["item"].alias("band"), i.alias("i"))))
    rows = shared.withColumn("first", first.cast("int")).where("first > 0").select("id", "n", F.size("s").alias("common"), place.alias("x"))
    rows = settle(rows.select("id", "n", (F.col("common") - F.col("x.i")).cast("bigint").alias("rest"), F.col("x.band").alias("band")), "rare")
    least = rows.groupBy("band").agg(F.min("n").alias("least"), F.count("*").alias("members")).where("members > 1").select("band", "least")
    other = F.greatest("least", F.ceil(F.col("n") * p.alike / 100))
    able = F.col("rest") * (100 + p.alike) >= (F.col("n") + other) * p.alike
    found = settle(spread_join(rows, least, "band", "id").where(able).select("id", "n", "rest", "band"), "buckets")
    discard(rows)
    discard(ids)
    return found


def link_classes(docs: DataFrame, sketched: DataFrame, p: Params, id_col: str, text_col: str) -> tuple[DataFrame | None, DataFrame]:
    """(id, root) of the representatives that have links, and (digest, rep) of all classes."""
    reps = settle(sketched.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep")), "reps")
    own = reps.select("digest", F.col("rep").alias("id"))
    rows = sketched.select("digest", "id", "bands").join(own, ["digest", "id"], "left_semi").select("id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    buckets = settle(rows.join(shared.select("band"), "band"), "buckets")
    wanted = own.join(buckets.select("id").distinct(), "id", "left_semi")
    sets = settle(full_sets(docs, wanted, p, id_col, text_col), "sets")
    shared_buckets, buckets = buckets, buckets.join(sets.select("id", "n", F.col("n").alias("rest")), "id")
    roots, links, hubs = None, None, 1
    while True:
        state = with_roots(buckets, roots)
        # hubs come by hash: a large component, which most likely holds one, then meets the rest of the
        # bucket before the rest is compared within itself
        live = state.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band")
        work = settle(spread_join(state, live, "band", "id"), "work")
        if hubs == 1:
            picked = work.groupBy("band").agg(F.array(F.min(F.struct("id", "n", "rest", "root"))).alias("hubs"))
        else:
            turn = Window.partitionBy("band").orderBy(F.xxhash64("id", "band"), "id")
            picked = work.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= hubs)
            picked = picked.groupBy("band").agg(F.collect_set(F.struct("id", "n", "rest", "root")).alias("hubs"))
        met = spread_join(work, picked, "band", "id")
        discard(shared_buckets if roots is None else buckets)
        if work.isEmpty():
            discard(work)
            return roots, reps
        near = lambda h: (h["root"] != F.col("root")) & (F.least("rest", h["rest"]) * (100 + p.alike) >= (F.col("n") + h["n"]) * p.alike)
        pairs = met.select("id", F.explode(F.filter("hubs", near)).alias("hub"))
        pairs = pairs.select(F.least("id", "hub.id").alias("b"), F.greatest("id", "hub.id").alias("a")).distinct()
        new = settle(verify(pairs, sets.select("id", "items"), p.alike), "links")
        old = None
        if roots is None or not new.isEmpty():
            links = new if links is None else links.unionAll(new)
            old, roots = roots, settle(components(links), "roots")
        if hubs == 1:
            buckets, hubs = rare_buckets(work.drop("root"), roots, sets, p), 64
        else:
            is_hub = F.exists("hubs", lambda h: h["id"] == F.col("id"))
            buckets, hubs = settle(met.where(~is_hub).select("id", "n", "rest", "band"), "buckets"), MOST_HUBS
        discard(old, work)


def near_duplicates(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id, kept for every row."""
    sketched = settle(sketches(docs, p, id_col, text_col), "sketches")
    roots, reps = link_classes(docs, sketched, p, id_col, text_col)
    if roots is None:
        classes = reps.select("digest", F.col("rep").alias("root"))
    else:
        classes = reps.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    full = sketched.select("id", "n_shingles", "digest").join(classes, "digest", "left")
    comp = F.coalesce("root", "id")
    return full.select(
        F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), comp.eqNullSafe(F.col("id")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose component they represent, unchanged.

    An id goes if one of its rows is like a document of smaller id; of repeated rows one stays.
    """
    found = settle(near_duplicates(docs, p, id_col, text_col), "members")
    gone = found.where(~F.col("kept")).select(id_col).distinct()
    rest = docs.join(gone, id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    again = found.where(f"`{id_col}` is not null").groupBy(id_col).count().where("count > 1")
    return rest if again.isEmpty() else rest.dropDuplicates()
