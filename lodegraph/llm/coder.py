"""Token ids in compressed binary blocks: an adaptive context-mixing range coder.

A frame of ids is cut into blocks of ``BLOCK`` ids.  Every block starts from the frame's order-0
frequencies and from empty order-1 and order-2 tables, and carries the CRC-32 of its ids, so with the
frame's model any block can be read alone.  For each id three predictions are mixed into one distribution

    P(x) = a * P0(x) + b * [x is the id last seen behind the previous id]
                     + c * [x is the id last seen behind the two previous ids]

with P0 the frame's frequencies (counts in a total of 2**18, one at least for each id of the frame).  The
weights adapt after every id: b and c are moving averages of how often their predictions held, kept apart
by how often the two had held before and by whether they agree; a takes the rest.  All three are sixty-fourths,
so each id is one interval in a total of 2**24, coded in one step of a range coder with a range of 32 to
48 bits, words of 16 bits, and carries that are added to the words in the end.

All blocks of a frame are read in step: one NumPy operation serves one decision of every block.  The writer
knows the ids ahead, so it takes what the orders foresee from sorts and keeps only weights and ranges in step.
Both use whole numbers alone, so the reader repeats the writer's model exactly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
MOST_ID = (1 << 23) - 1
_FINE = 18  # bits of the order-0 total; weights take six more
_BITS = 11  # of the places of an order's table, for each block
_TOP = np.uint32(32 - _BITS)
_MUL1, _MUL2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_16, _24, _32 = (np.uint64(k) for k in (16, 24, 32))
_FLOOR, _MASK, _LAST = np.uint64(1 << 32), np.uint64((1 << 32) - 1), np.uint64((1 << 24) - 1)
#: Moving averages of 16 bits, c above b in one word; each step takes a 32nd away and adds the gain of a hit.
_PARTS = np.uint32(0x07FF07FF)
_GAINS = np.array([0, 2015, 2015 << 16, 2015 << 16], np.uint32)
#: First weights by how often order 2 and order 1 have held (0 to 3; 0: nothing seen).
_FIRST = np.array([min(c, 62) << 26 | min(b, 62 - c) << 10 for c in (0, 20, 40, 54) for b in (0, 8, 24, 40)], np.uint32)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a total of 2**18, at least one for each id that occurs."""
    total, out = 1 << _FINE, np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    room = total - len(seen)
    if room < 0:
        raise ValueError(f"a frame holds more than {total} different ids")
    share = counts[seen] * (room / counts[seen].sum()) if len(seen) else np.empty(0)
    out[seen] = 1 + np.floor(share).astype(np.int64)
    if len(seen):  # what flooring leaves goes to the most frequent id
        out[seen[np.argmax(counts[seen])]] += total - out.sum()
    return out


def pack_model(freq: np.ndarray) -> bytes:
    """The order-0 frequencies as bytes: gaps between the ids that occur, then their frequencies."""
    seen = np.flatnonzero(freq)
    gaps = np.diff(seen, prepend=-1).astype("<u4")
    return zlib.compress(struct.pack("<I", len(seen)) + b"".join(p.view(np.uint8).reshape(-1, 4).T.tobytes() for p in (gaps, freq[seen].astype("<u4"))), 6)


def unpack_model(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    planes = np.frombuffer(raw, np.uint8, 8 * n, 4).reshape(2, 4, n)
    gaps, freq = (np.ascontiguousarray(p.T).view("<u4").reshape(-1).astype(np.int64) for p in planes)
    out = np.zeros(int(gaps.sum()) if n else 0, np.int64)
    out[np.cumsum(gaps) - 1] = freq
    return out


class _Reader:
    """Decodes all blocks of a frame in step, longest block first.

    ``grid`` gets the ids by step and lane, behind two rows of zeros; ``words`` holds the coder's words by lane.
    Arrays of two rows hold what orders 1 and 2 say, so one operation serves both.
    """

    def __init__(self, lens: np.ndarray, freq: np.ndarray, words: np.ndarray):
        freq = freq if len(freq) else np.zeros(1, np.int64)
        self.lens, n = lens, len(lens)
        self.end, self.freq = np.cumsum(freq).astype(np.int32), freq.astype(np.int32)
        self.start = self.end - self.freq
        self.slots = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        self.grid = np.zeros((2 + int(lens[0]), n), np.int32)
        self.table = np.zeros(2 * n << _BITS, np.int32)  # id << 4 | times held: 1 to 3, for order 2 times 4
        self.weights = np.tile(_FIRST, 2 * n)
        self.words, self.pos = words.reshape(-1), np.arange(n, dtype=np.int64) * words.shape[1]
        self.low, self.rng = np.zeros(n, np.uint64), np.full(n, 1 << 48, np.uint64)
        for _ in range(3):
            self.low = self.low << _16 | self.words[self.pos]
            self.pos += 1

    def run(self) -> None:
        """All steps; blocks that end leave from the back."""
        bounds = np.unique(np.concatenate(([0], self.lens)))
        for t0, t1 in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            self.steps(int(np.searchsorted(-self.lens, -t0, side="left")), t0, t1)

    def steps(self, n: int, t0: int, t1: int) -> None:
        """The ids ``t0`` to ``t1`` of the first ``n`` blocks."""
        add, sub, mul, shl, shr, both, copy = np.add, np.subtract, np.multiply, np.left_shift, np.right_shift, np.bitwise_and, np.copyto
        grid, table, weights, words, pos, low, rng = self.grid, self.table, self.weights, self.words, self.pos[:n], self.low[:n], self.rng[:n]
        look, weigh, word_at = table.take, weights.take, words.take
        end_of, start_of, freq_of, id_at, gain_of = self.end.take, self.start.take, self.freq.take, self.slots.take, _GAINS.take
        # numbers as arrays are dearer to make than to use
        i32 = lambda v: np.array(v, np.int32)
        u32, u64 = (lambda v: np.array(v, np.uint32)), (lambda v: np.array(v, np.uint64))
        i0, i1, i4, i15, i18, whole, ones, caps = i32(0), i32(1), i32(4), i32(15), i32(_FINE), i32(64 << _FINE), i32([[1], [4]]), i32([[3], [12]])
        u5, u8, top, mul1, mul2, parts, masses = (u32(int(k)) for k in (5, 8, _TOP, _MUL1, _MUL2, _PARTS, 63 << _FINE))
        s4, s16, s24, s63, floor, last = (u64(int(k)) for k in (4, 16, 24, 63, _FLOOR, _LAST))
        two = (2, n)
        base_t = (np.arange(2, dtype=np.int64)[:, None] * len(self.lens) + np.arange(n)) << _BITS
        base_w = np.arange(n, dtype=np.int64) << 5
        hash_, mass_u = np.empty(two, np.uint32), np.empty(two, np.uint32)
        h1, h2 = hash_
        place, far, cx, xi, gi = np.empty(two, np.int64), np.empty(two, np.int64), *(np.empty(n, np.int64) for _ in range(3))
        e, p, k, edge, part, iv = (np.empty(two, np.int32) for _ in range(6))
        (p1, p2), (k1, k2), (d1, d2), (y, size) = p, k, part, iv
        mass = mass_u.view(np.int32)
        b, c = mass
        other = mass[::-1]
        v, a, z = (np.empty(n, np.int32) for _ in range(3))
        w, h, gain = (np.empty(n, np.uint32) for _ in range(3))
        kind, s, f, r, need, by = np.empty(n, np.uint8), *(np.empty(n, np.uint64) for _ in range(5))
        needed, span = need.view(np.int64), np.empty(two, np.uint64)
        hit, above, order = (np.empty(two, bool) for _ in range(3))
        same = np.empty(n, bool)
        same_8, (hit1_8, hit2_8), (after, before) = same.view(np.uint8), hit.view(np.uint8), order
        for t in range(t0, t1):
            # what orders 1 and 2 foresee, and the weights of the mixture
            mul(grid[t + 1, :n].view(np.uint32), mul1, h1)
            mul(grid[t, :n].view(np.uint32), mul2, h2)
            add(h2, h1, h2)
            shr(hash_, top, hash_)
            add(base_t, hash_, place)
            look(place, None, e, "clip")
            shr(e, i4, p)
            both(e, i15, k)
            np.equal(p1, p2, same)
            shl(same_8, 4, kind)
            add(k1, k2, z)
            add(z, kind, z)
            add(base_w, z, cx)
            weigh(cx, None, w, "clip")
            shl(w, u8, mass_u[0])
            shr(w, u8, mass_u[1])
            both(mass_u, masses, mass_u)
            sub(whole, b, a)
            sub(a, c, a)
            shr(a, i18, a)
            # the value in the mixture, then without the extra masses behind the two ids' order-0 intervals
            shr(rng, s24, r)
            np.floor_divide(low, r, s)
            np.minimum(s, last, s)
            copy(v, s, casting="unsafe")
            copy(far, p)
            end_of(far, None, edge, "clip")
            mul(edge, a, edge)
            np.less(p2, p1, after)
            np.logical_not(after, before)
            mul(other, order, part)
            add(edge, part, edge)
            sub(v, edge, part)
            add(part, i1, part)
            np.maximum(part, i0, part)
            np.minimum(part, mass, part)
            sub(v, d1, v)
            sub(v, d2, v)
            np.floor_divide(v, a, v)
            copy(xi, v)
            x = grid[t + 2, :n]
            id_at(xi, None, x, "clip")
            # its interval
            copy(xi, x)
            start_of(xi, None, y, "clip")
            freq_of(xi, None, size, "clip")
            mul(iv, a, iv)
            np.greater(x, p, above)
            np.equal(x, p, hit)
            mul(mass, above, part)
            add(y, d1, y)
            add(y, d2, y)
            mul(mass, hit, part)
            add(size, d1, size)
            add(size, d2, size)
            copy(span, iv, casting="unsafe")
            mul(span[0], r, s)
            mul(span[1], r, rng)
            sub(low, s, low)
            # the lanes that need it move on by one word, a few by a second one
            for _ in range(2):
                sub(rng, floor, need)
                shr(need, s63, need)
                shl(need, s4, by)
                shl(low, by, low)
                shl(rng, by, rng)
                word_at(pos, None, f, "clip")
                mul(f, need, f)
                add(low, f, low)
                add(pos, needed, pos)
                if int(rng.min()) >= 1 << 32:
                    break
            # what has been seen
            shl(hit2_8, 1, kind)
            np.bitwise_or(kind, hit1_8, kind)
            copy(gi, kind)
            gain_of(gi, None, gain, "clip")
            shr(w, u5, h)
            both(h, parts, h)
            sub(w, h, w)
            add(w, gain, w)
            weights[cx] = w
            mul(k, hit, k)
            add(k, ones, k)
            np.minimum(k, caps, k)
            shl(x, i4, z)
            add(k, z, k)
            table[place] = k


def _foreseen(x: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """What an order's table holds for every id before it is coded (id << 8 | times held, 0 to 3), for blocks by row.

    An entry is the last id of its place and how long that id has come in a row, so sorting a block by place and
    time tells all of them at once.
    """
    n, steps = x.shape
    bits = max(1, (steps - 1).bit_length())
    key = slot << np.uint32(bits)
    key |= np.arange(steps, dtype=np.uint32)
    key.sort(axis=1)
    at = (key & np.uint32((1 << bits) - 1)).astype(np.int64)
    at += (np.arange(n, dtype=np.int64) * steps)[:, None]
    at = at.reshape(-1)
    ids = np.take(x.reshape(-1), at, mode="clip")
    key >>= np.uint32(bits)
    seen = np.zeros((n, steps), bool)
    np.equal(key[:, 1:], key[:, :-1], out=seen[:, 1:])
    seen = seen.reshape(-1)
    again = np.zeros(n * steps + 2, np.int8)  # two ahead of the first
    np.logical_and(seen[1:], ids[1:] == ids[:-1], out=again[3:], casting="unsafe")
    held = again[:-2] & again[1:-1]
    held += again[1:-1]
    held += 1
    entry = np.zeros(n * steps, np.int32)
    np.left_shift(ids[:-1], 8, out=entry[1:])
    entry |= held
    entry *= seen
    out = np.empty(n * steps, np.int32)
    out[at] = entry
    return out.reshape(n, steps)


def _kinds(x: np.ndarray) -> np.ndarray:
    """All that the mixture takes from orders 1 and 2, in the bits of a number for each id of blocks by row: the context of
    the weights (5 bits), whether each of the two holds, and whether the id stands behind theirs."""
    h, g = np.zeros(x.shape, np.uint32), np.zeros(x.shape, np.uint32)
    np.multiply(x[:, :-1].view(np.uint32), _MUL1, out=h[:, 1:])
    np.multiply(x[:, :-2].view(np.uint32), _MUL2, out=g[:, 2:])
    g += h
    e1, e2 = _foreseen(x, h >> _TOP), _foreseen(x, g >> _TOP)
    p1, p2 = e1 >> 8, e2 >> 8
    out = ((e1 & 3) + ((e2 & 3) << 2)).astype(np.uint16)
    for k, flag in enumerate((p1 == p2, x == p1, x == p2, x > p1, x > p2)):
        out |= flag.astype(np.uint16) << np.uint16(4 + k)
    return out


class _Writer:
    """Codes all blocks of a frame, longest block first.

    The writer knows the ids, so what orders 1 and 2 foresee comes from sorts; only weights and ranges go in
    step.  The code of a block is the sum of its intervals' lower ends, each at the word where its range
    stands: these are added up by place, and carries are settled in the end.
    """

    STEPS = 32  # that are prepared at once
    LANES = 64

    def __init__(self, grid: np.ndarray, lens: np.ndarray, freq: np.ndarray):
        self.grid, self.lens = grid, lens
        self.end, self.freq = np.cumsum(freq).astype(np.int32), freq.astype(np.int32)
        n, steps = grid.shape
        self.kinds = np.empty((steps, n), np.uint16)
        for k in range(0, n, self.LANES):
            self.kinds[:, k : k + self.LANES] = _kinds(grid[k : k + self.LANES]).T
        self.weights = np.tile(_FIRST, 2 * n)
        self.words = np.zeros((n, 13 * steps // 8 + 8), np.uint32)
        self.pos, self.rng = np.zeros(n, np.int64), np.full(n, 1 << 48, np.uint64)

    def run(self) -> None:
        bounds = np.unique(np.concatenate(([0], self.lens, np.arange(0, self.grid.shape[1], self.STEPS))))
        for t0, t1 in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            self.steps(int(np.searchsorted(-self.lens, -t0, side="left")), t0, t1)

    def steps(self, n: int, t0: int, t1: int) -> None:
        """The ids ``t0`` to ``t1`` of the first ``n`` blocks."""
        kinds, x = self.kinds[t0:t1, :n], np.ascontiguousarray(self.grid[:n, t0:t1].T)
        at = (np.arange(n, dtype=np.int64) << 5) + (kinds & 31)
        gains = np.take(_GAINS, kinds >> 5 & 3)
        w, weights, h = np.empty((t1 - t0, n), np.uint32), self.weights, np.empty(n, np.uint32)
        for place, now, gain in zip(at, w, gains):
            np.take(weights, place, out=now, mode="clip")
            np.right_shift(now, 5, out=h)
            np.bitwise_and(h, _PARTS, out=h)
            np.subtract(now, h, out=h)
            np.add(h, gain, out=h)
            weights[place] = h
        # the intervals in the mixture
        c = (w >> 26).view(np.int32)
        b = (w >> 10 & 63).view(np.int32)
        a = 64 - b - c
        size = np.take(self.freq, x)
        low = np.take(self.end, x)
        low -= size
        low *= a
        size *= a
        for k, mass in enumerate((b, c)):
            mass <<= _FINE
            size += mass * (kinds >> (5 + k) & 1).astype(np.int32)
            low += mass * (kinds >> (7 + k) & 1).astype(np.int32)
        self.narrow(n, low.astype(np.uint64), size.astype(np.uint64))

    def narrow(self, n: int, low: np.ndarray, size: np.ndarray) -> None:
        """Ranges of the first ``n`` blocks over some steps, and the words that the lower ends add to."""
        rng, by = self.rng[:n], np.empty(n, np.uint64)
        unit, moved, far = np.empty(low.shape, np.uint64), np.empty(low.shape, bool), np.empty(low.shape, bool)
        moves = moved.view(np.uint8)
        for f, r, one, two, both in zip(size, unit, moved, far, moves):
            np.right_shift(rng, _24, out=r)
            np.multiply(f, r, out=rng)
            np.less(rng, _FLOOR, out=one)
            np.less(rng, _FLOOR >> _16, out=two)
            np.add(both, two.view(np.uint8), out=both)
            np.left_shift(both, 4, out=by)
            np.left_shift(rng, by, out=rng)
        low *= unit
        ends = np.cumsum(moves, axis=0, dtype=np.int64)
        last = ends[-1].copy()
        ends -= moves
        wide = int(last.max()) + 1
        ends += np.arange(n, dtype=np.int64) * wide
        # ends of one place lie within one range, so their sum is below 2**48
        sums = np.bincount(ends.reshape(-1), low.reshape(-1), n * wide).astype(np.uint64).reshape(n, wide)
        width = self.words.shape[1]
        at = (np.arange(n, dtype=np.int64) * width + self.pos[:n])[:, None] + np.arange(wide + 2)
        words = self.words.reshape(-1)
        parts = np.zeros((n, wide + 2), np.uint32)
        for k, part in enumerate((sums >> _32, sums >> _16, sums)):
            parts[:, k : k + wide] += (part & np.uint64(0xFFFF)).astype(np.uint32)
        words[at] += parts
        self.pos[:n] += last

    def finish(self) -> np.ndarray:
        """Settles the carries and ends each lane at a word behind which zeros stand for the rest; returns the words of each lane."""
        n, width = self.words.shape
        words, end = self.words.reshape(-1), np.arange(n) * width + self.pos
        self.settle(np.flatnonzero(words >> 16))
        words[end] += (words[end + 1] | words[end + 2]) > 0
        words[end + 1] = words[end + 2] = 0
        self.settle(end)
        return self.pos + 1

    def settle(self, places: np.ndarray) -> None:
        """Carries of the words at ``places`` and of those that they reach."""
        words = self.words.reshape(-1)
        while (over := places[words[places] >> 16 > 0]).size:
            up = words[over] >> 16
            words[over] &= 0xFFFF
            places = over - 1
            words[places] += up


def encode_frame(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """The order-0 model and the blocks of a run of ids.  A block: its number of ids, their checksum, words."""
    ids = np.asarray(ids)
    if not len(ids):
        return pack_model(np.zeros(0, np.int64)), []
    if int(ids.min()) < 0 or int(ids.max()) > MOST_ID:
        raise ValueError(f"token ids must lie between 0 and {MOST_ID}")
    freq = frequencies(np.bincount(ids))
    lens = np.full(-(-len(ids) // BLOCK), min(BLOCK, len(ids)))
    lens[-1] = len(ids) - (len(lens) - 1) * BLOCK
    grid = np.zeros((len(lens), int(lens[0])), np.int32)
    grid.reshape(-1)[: len(ids)] = ids
    walk = _Writer(grid, lens, freq)
    walk.run()
    used = walk.finish()
    raw = np.asarray(ids, "<u4")
    out = []
    for k, n in enumerate(lens.tolist()):
        head = struct.pack("<II", n, zlib.crc32(raw[k * BLOCK : k * BLOCK + n].tobytes()))
        out.append(head + walk.words[k, : used[k]].astype("<u2").tobytes())
    return pack_model(freq), out


def decode_frame(model: bytes, blocks: list[bytes]) -> np.ndarray:
    """The ids of some blocks of a frame, one block after another; a wrong checksum is an error."""
    if not blocks:
        return np.empty(0, np.uint32)
    head = np.array([struct.unpack_from("<II", b) for b in blocks], dtype=np.int64)
    order = np.argsort(-head[:, 0], kind="stable")
    parts = [np.frombuffer(blocks[k], "<u2", offset=8) for k in order]
    words = np.zeros((len(blocks), max(map(len, parts)) + 4), np.uint64)
    for row, w in zip(words, parts):
        row[: len(w)] = w
    lens = head[order, 0]
    walk = _Reader(lens, unpack_model(model), words)
    walk.run()
    grid, out = np.ascontiguousarray(walk.grid[2:].T), [None] * len(blocks)
    for row, k in zip(grid, order.tolist()):
        out[k] = row[: head[k, 0]].astype("<u4")
        if zlib.crc32(out[k].tobytes()) != head[k, 1]:
            raise ValueError("a block of token ids fails its checksum")
    return np.concatenate(out)
