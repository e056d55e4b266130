"""Byte-level BPE by corpus-level merge replay.

All texts of a batch (a large part of a partition) are cut into pre-tokens; each distinct
pre-token is kept once.  The bytes of the distinct pre-tokens form one long symbol array with
links to the neighbours.  An inverted index leads from a mergeable pair (named by the rank of
the token that it makes) to the positions where it stands.  Merges are replayed in rank order:
one merge updates all its positions at once and re-indexes only the touched neighbours.

Defined cases: null and empty texts have no ids and decode to no bytes; a text of any length is
encoded whole; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import sliced_texts, tidy

NONE = np.int64(1 << 40)  # rank of a pair that can't be merged

#: Text of these characters alone takes the fast pattern; there both patterns cut alike.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[\\t\\n\\r\\x20-\\x7e{_LATIN}]*")
_FAST = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\\s{_LATIN}0-9]+|\\s+(?!\\S)|\\s+"
)
#: The words and classes of the public pattern that the fast pattern stands for.
PUBLIC_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Classes of Latin-1 bytes: letter, digit, white space, other; 0 ends a text.
_CLASS_OF = np.full(256, 4, np.uint8)
_CLASS_OF[[b for b in range(256) if re.fullmatch(f"[{_LATIN}]", chr(b))]] = 1
_CLASS_OF[list(b"0123456789")] = 2
_CLASS_OF[list(b"\t\n\r ")] = 3
_CLASS_OF[0] = 0
#: Characters that are cut at once; longer plain texts are taken apart before a single space between letters.
PIECE = 500_000
_BETWEEN = re.compile(f"(?<=[{_LATIN}]) (?=[{_LATIN}])")


def pieces_of(text: str) -> list[str]:
    """A plain text in pieces that are cut alike on their own."""
    out, at = [], 0
    while len(text) - at > PIECE and (m := _BETWEEN.search(text, at + PIECE)):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class PreTokens:
    """Cuts a text into the matches of a pattern."""

    def __init__(self, pattern: str):
        # white space is Unicode's property here; the library's class also holds 1C to 1F
        unicode_space = r"[\p{White_Space}]"
        exact = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", unicode_space)
        exact = exact.replace(r"\S", r"[^\p{White_Space}]")
        self.exact = regex.compile(exact)
        self.fast = _FAST if pattern == PUBLIC_PATTERN else None

    def split(self, text: str) -> list[str]:
        if self.fast is not None and _PLAIN.fullmatch(text):
            return self.fast.findall(text)
        return self.exact.findall(text)


class MergeTable:
    """Ranks of a vocabulary and every pair of tokens that makes another token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for b, r in ranks.items():
            self.token[r] = b
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        keys, makes = [], []
        for b, r in ranks.items():
            for i in range(1, len(b)):
                left = ranks.get(b[:i])
                if left is not None:
                    right = ranks.get(b[i:])
                    if right is not None:
                        keys.append(left << 32 | right)
                        makes.append(r)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.makes = np.array(makes, dtype=np.int64)[order]

    @classmethod
    def load(cls, data: bytes) -> MergeTable:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.makes[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first, on one pre-token: the rule that the replay keeps."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words, one after another, and the number of ids of each word."""
        counts = np.ones(len(words), dtype=np.int64)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        todo = np.flatnonzero(whole < 0)
        if not len(todo):
            return whole, counts
        lens = np.fromiter((len(words[i]) for i in todo), dtype=np.int64, count=len(todo))
        buf = np.frombuffer(b"".join(words[i] for i in todo), dtype=np.uint8)
        n = len(buf)
        ends = np.cumsum(lens)
        sym = np.empty(n + 1, dtype=np.int64)
        sym[:n], sym[n] = self.byte_id[buf], self.size  # position n ends every word
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends - 1], prv[ends - lens] = n, n
        at = np.full(n + 1, NONE)
        at[:n] = self.rank(sym[:n], sym[nxt[:n]])
        word_of = np.repeat(np.arange(len(todo)), lens)
        odd: set[int] = set()

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(pos: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            first = rank[np.concatenate(([0], cut))].tolist()
            bounds = [0, *cut.tolist(), len(pos)]
            for k, r in enumerate(first):
                part = pos[bounds[k] : bounds[k + 1]]
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        live = np.flatnonzero(at < NONE)
        if len(live):
            enter(live, at[live])
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            pos = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            pos = pos[at[pos] == r]
            if not len(pos):
                continue
            if len(pos) > 1:  # overlapping places: every second one of a run, from the left
                chained = np.concatenate(([False], nxt[pos[:-1]] == pos[1:]))
                if chained.any():
                    k = np.arange(len(pos))
                    pos = pos[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = r
            at[gone] = NONE
            nxt[pos] = after
            prv[after] = pos
            before = prv[pos]
            prv[n] = nxt[n] = n
            new_right = self.rank(sym[pos], sym[after])
            at[pos] = new_right
            keep = before < n
            before = before[keep]
            new_left = self.rank(sym[before], sym[pos[keep]])
            at[before] = new_left
            # two merged neighbours: the left one's pair was set again as the "before" of the right
            new_pos = np.concatenate((pos, before))
            new_rank = at[new_pos]
            low = new_rank < r
            if low.any():
                odd.update(word_of[new_pos[low]].tolist())
            ok = (new_rank < NONE) & ~low
            if ok.any():
                enter(new_pos[ok], new_rank[ok])
        alive = np.ones(n, dtype=bool)
        # a position lives if its left neighbour leads to it
        alive[:] = False
        starts = ends - lens
        cur = starts
        while len(cur):
            alive[cur] = True
            cur = nxt[cur]
            cur = cur[cur < n]
        n_ids = np.bincount(word_of[alive], minlength=len(todo))
        counts[todo] = n_ids
        out_ids = sym[:n][alive]
        fixed = {w: self.one(words[todo[w]]) for w in odd}
        for w, ids in fixed.items():
            counts[todo[w]] = len(ids)
        offs = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(offs[-1], dtype=np.int64)
        direct = np.flatnonzero(whole >= 0)
        out[offs[direct]] = whole[direct]
        plain = np.array([w not in fixed for w in range(len(todo))]) if fixed else np.ones(len(todo), bool)
        src = np.concatenate(([0], np.cumsum(n_ids)))
        sel = todo[plain]
        length = n_ids[plain]
        if len(sel):
            step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            out[np.repeat(offs[sel], length) + step] = out_ids[np.repeat(src[:-1][plain], length) + step]
        for w, ids in fixed.items():
            out[offs[todo[w]] : offs[todo[w] + 1]] = ids
        return out, counts


class PlainWords:
    """Cuts plain texts into pre-tokens by array operations, and keeps a number for each distinct one.

    The texts stand in one array of Latin-1 bytes with a zero behind each.  A pre-token starts where the class
    of a character changes; a space belongs to what follows it, and the last of several white space
    characters stands apart.  Pre-tokens are known by 64-bit hashes (differences of a running sum of
    random values times powers), kept with their numbers in an open table.
    """

    def __init__(self, keep: int):
        self.table((2 * keep).bit_length())
        rng = np.random.Generator(np.random.PCG64(3))
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def table(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = -(-n // 100_000) * 100_000
            base = 0x9E3779B97F4A7C15
            for name, m in (("up", base), ("down", pow(base, -1, 1 << 64))):
                out = np.full(n, m, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    @staticmethod
    def starts(buf: np.ndarray) -> np.ndarray:
        """Places where a pre-token or a text's closing zero starts."""
        kind = _CLASS_OF[buf]
        white, zero, space = kind == 3, kind == 0, buf == 32
        cut = np.empty(len(buf), bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut[1:] &= ~(space[:-1] & ~white[1:] & ~zero[1:])  # the space before goes with it
        cut[:-1] |= white[:-1] & ~white[1:] & ~zero[1:]
        cut |= zero
        q = np.flatnonzero((buf[:-2] == 39) & cut[:-2] & (kind[1:-1] == 1)) if len(buf) > 2 else np.empty(0, np.int64)
        if len(q):  # contractions; a text's closing zero bounds them
            one, two = buf[q + 1], buf[np.minimum(q + 2, len(buf) - 1)]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            cut[q[short | long] + 1] = False
            cut[q[short] + 2] = True
            cut[q[long] + 3] = True
        return np.flatnonzero(cut)

    def numbers(self, texts: list[str], fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(number of every pre-token, its length, pre-tokens of each text, new ones in the order of their numbers from ``fresh``)."""
        buf = np.frombuffer(b"\0".join([t.encode("latin-1") for t in texts]) + b"\0", np.uint8)
        self.powers(len(buf) + 1)
        at = self.starts(buf)
        ends = np.append(at[1:], len(buf))
        zero = buf[at] == 0
        per_text = np.diff(np.flatnonzero(zero), prepend=-1) - 1
        at, ends = at[~zero], ends[~zero]
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.value[buf] * self.up[: len(buf)], out=run[1:])
        h = (run[ends] - run[at]) * self.down[at]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h |= np.uint64(1)
        found = self.look_up(h)
        missing = np.flatnonzero(found < 0)
        words: list[str] = []
        if len(missing):
            keys, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            order = np.argsort(first, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            raw = buf.tobytes()
            one = missing[first[order]]
            words = [raw[i:j].decode("latin-1") for i, j in zip(at[one].tolist(), ends[one].tolist())]
            self.enter(keys, (fresh + place).astype(np.int32))
            found[missing] = fresh + place[back]
        return found, ends - at, per_text, words

    def look_up(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, self.number[slot], -1).astype(np.int64)
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[left]]
            hit = got == h[left]
            out[left[hit]] = self.number[slot[left[hit]]]
            left = left[~hit & (got != 0)]
        return out

    def enter(self, keys: np.ndarray, number: np.ndarray) -> None:
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, number = np.concatenate((self.keys[old], keys)), np.concatenate((self.number[old], number))
            self.table((2 * len(keys)).bit_length())
        self.used += len(keys)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            mine = free[self.keys[slot[free]] == keys[free]]
            self.number[slot[mine]] = number[mine]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


class Encoder:
    """Pre-tokens seen so far with their ids; forgets all when it holds ``keep`` of them."""

    def __init__(self, data: bytes, pattern: str, keep: int = 300_000):
        self.merges = MergeTable.load(data)
        self.cut = PreTokens(pattern)
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.plain = PlainWords(self.keep)
        self.ids = np.empty(0, dtype=np.uint32)
        self.count = np.empty(0, dtype=np.int64)
        self.start = np.empty(0, dtype=np.int64)

    def numbered(self, cuts: list[list[str]], fresh: int) -> tuple[list[np.ndarray], list[str]]:
        """Numbers of pre-tokens that are given, and the new ones in the order of their numbers from ``fresh``."""
        place, new, out = self.place, [], []
        for words in cuts:
            row = np.empty(len(words), np.int64)
            for i, w in enumerate(words):
                n = place.get(w)
                if n is None:
                    place[w] = n = fresh + len(new)
                    new.append(w)
                row[i] = n
            out.append(row)
        return out, new

    def counts_of(self, cuts: list[list[str]]) -> list[np.ndarray]:
        """Token counts of pre-tokens that are given; the new ones are encoded together."""
        rows, new = self.numbered(cuts, len(self.count))
        self.learn(new)
        return [self.count[r] for r in rows]

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the pre-tokens of all texts, their lengths in characters, pre-tokens of each text).

        The new pre-tokens of all the texts are encoded by one replay.
        """
        if len(self.count) > self.keep:
            self.forget()
        numbers, lens, per_text, at = [], [], np.zeros(len(texts), np.int64), 0
        unknown: list[str] = []
        for plain, run in groupby(texts, lambda t: self.cut.fast is not None and _PLAIN.fullmatch(t) is not None):
            pieces, owner = [], []
            for t in run:
                parts = pieces_of(t) if plain else [t]
                pieces += parts
                owner += [at] * len(parts)
                at += 1
            for part in groups_by_bytes(pieces, PIECE):
                if plain:
                    n, size, per, new = self.plain.numbers(pieces[part], len(self.count) + len(unknown))
                else:
                    cut = [self.cut.split(t) for t in pieces[part]]
                    rows, new = self.numbered(cut, len(self.count) + len(unknown))
                    n = np.concatenate(rows)
                    size = np.fromiter(map(len, chain.from_iterable(cut)), np.int64, len(n))
                    per = np.fromiter(map(len, cut), np.int64, len(cut))
                unknown += new
                numbers.append(n.astype(np.int32))
                lens.append(size.astype(np.int32))
                np.add.at(per_text, owner[part], per)
        self.learn(unknown)
        none = [np.empty(0, np.int32)]
        return np.concatenate(numbers or none), np.concatenate(lens or none), per_text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, by one replay over the pre-tokens that are new."""
        numbers, _, per_text = self.rows(texts)
        parts, sizes = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        for k in range(0, len(numbers), 100_000):
            some = numbers[k : k + 100_000]
            c = self.count[some]
            ends = np.cumsum(c)
            parts.append(self.ids[np.repeat(self.start[some] - (ends - c), c) + np.arange(int(ends[-1]))])
            sizes.append(ends + sizes[-1][-1])
        ids, bounds = np.concatenate(parts), np.concatenate(sizes)[np.concatenate(([0], np.cumsum(per_text)))].tolist()
        return [ids[i:j] for i, j in zip(bounds, bounds[1:])]

    def learn(self, words: list[str]) -> None:
        """Encode new pre-tokens; they get the next numbers."""
        if not words:
            return
        ids, counts = self.merges.replay([w.encode() for w in words])
        base = len(self.ids)
        self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))
        self.count = np.concatenate((self.count, counts))
        self.start = np.concatenate((self.start, base + np.cumsum(counts) - counts))

    def decode(self, ids: np.ndarray) -> bytes:
        token = self.merges.token
        return b"".join([token[i] for i in ids.tolist()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder per vocabulary in a Python worker; its pre-tokens serve later tasks too."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data, pattern)
    return _ENCODERS[key]


def groups_by_bytes(texts: list[str], most: int) -> Iterator[slice]:
    """Slices of whole texts of about ``most`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(
    docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True, chars: int = 3_000_000,
) -> DataFrame:
    """``id_col``, n_tokens, ids (unless ``with_ids`` is off), ids_sha256, decoded_sha256 of each row.

    The vocabulary (a rank file's bytes, under a few MB) travels once to each executor.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)
    key_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped.value, pattern)
        for batch in batches:
            for start, texts in sliced_texts(batch.column(1), chars):
                n, ids_out, ids_sha, text_sha = [], [], [], []
                for ids in enc.encode(texts):
                    raw = ids.astype("<u4", copy=False).tobytes()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                    if with_ids:
                        ids_out.append(ids.astype(np.int32))
                cols = {id_col: batch.column(0).slice(start, len(texts)), "n_tokens": pa.array(n, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
                cols |= {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)
        tidy()

    kind = key_type.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
