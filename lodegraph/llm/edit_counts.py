"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: leaves are short runs of pre-tokens with
their lengths and token counts, inner nodes hold the sums of their subtrees.  An edit finds its
leaf by the lengths; pre-tokens are cut anew from the first one that the edit can reach (the one
that ends at or behind the character before the edit: a cut looks two characters ahead) until a new
bound falls on an old one behind the edit, and only those are encoded.  The touched leaf's sums are
carried up to the root.

``build_trees`` encodes texts and gives their trees as a table to be written (leaf sizes, lengths and counts of the
pre-tokens beside the text); ``update_trees`` takes later edits and gives the next version of the edited
documents' rows alone, from the stored leaves and without encoding anything but the touched regions.

Defined cases: null texts are empty; edits beyond the end are cut to the text; an edit may empty a
text; repeated rows are edited each on their own; documents without edits keep their counts; edits
of unknown documents have no effect; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm import bpe
from lodegraph.llm.common import settle, sliced_texts, tidy

LEAF = 32
#: Characters behind a pre-token that decide on its end: white space before a character that isn't gives
#: its last one away, and ' is a pre-token of its own unless ve, re or ll follow.
AHEAD = 2


def leaf_sizes(n: int) -> np.ndarray:
    """Sizes of the leaves of a new tree over so many pre-tokens."""
    return np.diff(np.append(np.arange(0, n, LEAF), n)).astype(np.int32)


class TokenTree:
    """Pre-token lengths and token counts in leaves, with a binary tree of sums above them."""

    def __init__(self, lens: np.ndarray, counts: np.ndarray, sizes: np.ndarray | None = None):
        ends = np.cumsum(leaf_sizes(len(lens)) if sizes is None else sizes).tolist()
        self.leaves = [[lens[i:j].tolist(), counts[i:j].tolist()] for i, j in zip([0, *ends], ends)] or [[[], []]]
        self.rebuild()

    def parts(self) -> tuple[list[int], list[int], list[int]]:
        """Lengths, counts and leaf sizes, as they are stored."""
        return [n for x, _ in self.leaves for n in x], [n for _, x in self.leaves for n in x], [len(x) for x, _ in self.leaves]

    def rebuild(self) -> None:
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, (lens, counts) in enumerate(self.leaves):
            self.chars[self.base + i], self.tokens[self.base + i] = sum(lens), sum(counts)
        for i in range(self.base - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int, int]:
        """(leaf, place in it, start) of the first pre-token that ends at or behind character ``at``."""
        if at > self.chars[1]:
            at = self.chars[1]
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if before + self.chars[node] < at:
                before += self.chars[node]
                node += 1
        leaf = min(node - self.base, len(self.leaves) - 1)
        for k, n in enumerate(self.leaves[leaf][0]):
            if before + n >= at:
                return leaf, k, before
            before += n
        return leaf, len(self.leaves[leaf][0]), before

    def replace(self, leaf: int, k: int, n_old: int, lens: list[int], counts: list[int]) -> None:
        """Put new pre-tokens in the place of ``n_old`` from place ``k`` of a leaf on, and mend the sums."""
        first, touched = leaf, {leaf}
        while n_old:
            room = min(n_old, len(self.leaves[leaf][0]) - k)
            for part in self.leaves[leaf]:
                del part[k : k + room]
            touched.add(leaf)
            n_old -= room
            if n_old:
                leaf, k = leaf + 1, 0
        if leaf > first:
            k = len(self.leaves[first][0])
        self.leaves[first][0][k:k] = lens
        self.leaves[first][1][k:k] = counts
        if len(self.leaves[first][0]) > 4 * LEAF:
            a, b = self.leaves[first]
            self.leaves[first : first + 1] = [[a[i : i + LEAF], b[i : i + LEAF]] for i in range(0, len(a), LEAF)]
            self.rebuild()
            return
        for leaf in touched:
            i = self.base + leaf
            self.chars[i], self.tokens[i] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
            while i > 1:
                i //= 2
                self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def bounds_from(self, leaf: int, k: int, start: int) -> Iterator[int]:
        """Ends of the pre-tokens from a place on."""
        while leaf < len(self.leaves):
            for n in self.leaves[leaf][0][k:]:
                start += n
                yield start
            leaf, k = leaf + 1, 0


def plan_edit(tree: TokenTree, text: str, start: int, end: int, new: str, cut: bpe.PreTokens):
    """The edited text and what to replace: (text, leaf, place, number of old pre-tokens, new pre-tokens)."""
    start = min(max(0, start), len(text))
    end = min(max(start, end), len(text))
    edited = text[:start] + new + text[end:]
    leaf, k, at = tree.find(max(0, start - AHEAD + 1))
    shift, old = len(new) - (end - start), tree.bounds_from(leaf, k, at)
    pieces, n_old, here = [], 0, at
    old_end = at
    for m in cut.exact.finditer(edited, at):
        pieces.append(m[0])
        here = m.end()
        while old_end + shift < here or old_end < end:
            nxt = next(old, None)
            if nxt is None:
                break
            old_end, n_old = nxt, n_old + 1
        if old_end >= end and here == old_end + shift and here >= start + len(new):
            break
    else:
        n_old += sum(1 for _ in old)
    return edited, leaf, k, n_old, pieces


def sample_edits(doc_id, text: str, n: int) -> list[tuple[int, int, str]]:
    """Edits as an editor might leave them, fixed by the id and the text: a replacement by a piece of the
    same text, a removal, an insertion."""
    out, size = [], len(text)
    for k in range(n):
        h = xxhash.xxh3_64_intdigest(f"{doc_id}:{k}".encode())
        at = h % (size + 1)
        span = (h >> 20) % 40
        put = text[(h >> 30) % (size + 1) :][: (h >> 50) % 30] if k % 3 != 1 else ""
        out.append((at, at if k % 3 == 2 else at + span, put))
        size += len(put) - (min(out[-1][1], size) - at)
    return out


TREE = "text string, lens array<int>, counts array<int>, sizes array<int>"


def build_trees(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """``id_col``, text and tree (lens, counts, sizes) of every row, and its edits where a column holds them."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [id_col, *[edits_col] * bool(edits_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(shipped.value, pattern)
        for batch in batches:
            for start, texts in sliced_texts(batch.column(0), 4_000_000):
                numbers, lens, per_text = enc.rows(texts)
                off = pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32())
                sizes = [leaf_sizes(n) for n in per_text.tolist()]
                cols = [pa.array(texts, pa.string())] + [pa.ListArray.from_arrays(off, pa.array(x, pa.int32())) for x in (lens, enc.count[numbers])]
                cols += [pa.array(sizes, pa.list_(pa.int32())), *(c.slice(start, len(texts)) for c in batch.columns[1:])]
                yield pa.RecordBatch.from_arrays(cols, names=["text", "lens", "counts", "sizes", *kept])
        tidy()

    fields = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(F.col(text_col).cast("string").alias("text__"), *[f"`{c}`" for c in kept]).mapInArrow(run, TREE + fields)


def apply_edits(trees: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", edits_col: str | None = None, edits: int = 3, with_trees: bool = False) -> DataFrame:
    """The counts of ``edited_counts`` from stored trees, and the edited texts and trees if asked for."""
    shipped = trees.sparkSession.sparkContext.broadcast(vocabulary)
    kind = trees.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(shipped.value, pattern)
        for batch in batches:
            for start, now in sliced_texts(batch.column(0), 4_000_000):
                b = batch.slice(start, len(now))
                ids = b.column(4).to_pylist()
                flat = []
                for k in (1, 2, 3):
                    values, off = b.column(k).flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(b.column(k)).to_numpy())))
                    flat.append([values[i:j] for i, j in zip(off.tolist(), off[1:].tolist())])
                trees_ = [TokenTree(*x) for x in zip(*flat)]
                before, pieces, again = [t.total for t in trees_], [len(x) for x in flat[0]], [0] * len(now)
                if edits_col:
                    todo = [[(e["start"] or 0, e["end"] or 0, e["put"] or "") for e in x or [] if e] for x in b.column(5).to_pylist()]
                else:
                    todo = [sample_edits(i, t, edits) for i, t in zip(ids, now)]
                for k in range(max(map(len, todo), default=0)):
                    rows = [i for i in range(len(now)) if k < len(todo[i])]
                    plans = [plan_edit(trees_[i], now[i], *todo[i][k], enc.cut) for i in rows]
                    for i, (text, leaf, at, n_old, new), n in zip(rows, plans, enc.counts_of([x[4] for x in plans])):
                        trees_[i].replace(leaf, at, n_old, list(map(len, new)), n.tolist())
                        now[i], again[i] = text, again[i] + len(new)
                cols = [b.column(4), *(pa.array(x, pa.int64()) for x in (before, [t.total for t in trees_], pieces, again))]
                cols.append(pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in now], pa.string()))
                names = [id_col, "n_tokens", "edited_tokens", "pretokens", "reencoded", "edited_sha256"]
                if with_trees:
                    cols += [pa.array(now, pa.string()), *(pa.array(x, pa.list_(pa.int32())) for x in zip(*(t.parts() for t in trees_)))]
                    names += ["text", "lens", "counts", "sizes"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        tidy()

    schema = f"`{id_col}` {kind}, n_tokens bigint, edited_tokens bigint, pretokens bigint, reencoded bigint, edited_sha256 string" + f", {TREE}" * with_trees
    return trees.select("text", "lens", "counts", "sizes", f"`{id_col}`", *[edits_col] * bool(edits_col)).mapInArrow(run, schema)


def update_trees(trees: DataFrame, edits: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """The rows that replace those of the edited documents in ``trees``: id, counts, text and tree.

    ``edits``: ``id_col``, seq, start, end, put; those of a document are applied by ``seq``.  Documents without edits
    have no row here, and none of their texts or leaves reaches a Python worker; edits of unknown documents go.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "put"))), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["put"].alias("put")))
    todo = edits.groupBy(F.col(id_col).alias("id__")).agg(steps.alias("edits__"))
    met = trees.join(todo, F.col(f"`{id_col}`").eqNullSafe(F.col("id__")))
    return apply_edits(met, vocabulary, pattern, id_col, "edits__", with_trees=True)


def edited_counts(docs: DataFrame, vocabulary: bytes, pattern: str, edits: int = 3, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """``id_col``, n_tokens, edited_tokens, pretokens, reencoded, edited_sha256 of every row, from trees that are written first.

    ``edits_col``: array of struct (start, end, put), applied one after another; without it every
    document gets ``edits`` edits from ``sample_edits``.
    """
    trees = settle(build_trees(docs, vocabulary, pattern, id_col, text_col, edits_col), "trees", compression="zstd")
    return apply_edits(trees, vocabulary, pattern, id_col, edits_col, edits)
