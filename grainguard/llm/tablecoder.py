"""A context-mixing coder for segments of token ids: shared tables of orders 0 to 2, chances mixed per block, range ANS.

The tables of a segment are counted from its own ids and go with it: the likeliest successor of one id (order 1) and of
two ids (order 2), each with a class of how sure it is, how often candidates of a class come, and the frequencies of the
ids that no candidate foretold (order 0). The chance that the first candidate comes is mixed from what both orders' classes
say, by a weight of each block's own that moves towards the order that predicts better. One step codes one id: first
candidate, second candidate, or an id of order 0. All blocks of a segment are coded side by side, one id of each at a time,
as numpy arrays; a block needs the tables and its own payload, no other block.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
STATES = 64  # 16 classes of sureness, times which orders have a candidate and whether they agree
SCALE, PLAIN = 12, 18  # bits of a mixed chance, and of order 0 within what is left of it
TOTAL = SCALE + PLAIN
LEAST = 3  # a candidate came this often
MOVE, FULL = 4, 256  # step and most of a weight
SLICE = 256  # steps whose contexts are found at once
NONE = np.uint32(0xFFF)


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """32 bits of the last id and the one before (uint32): slot in the upper half, tag in the lowest 12 bits."""
    return one * np.uint32(0x9E3779B1) + two * np.uint32(0x85EBCA6B)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys and how often each comes."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def successors(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each context's likeliest next id, how often it came, and its class from 1 to 15; keys are context << 16 | id."""
    keys, counts = runs(np.sort(keys))
    context = keys >> np.uint64(16)
    start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    every, most = np.add.reduceat(counts, start), np.maximum.reduceat(counts, start)
    best = np.flatnonzero(counts == np.repeat(most, np.diff(np.append(start, len(counts)))))
    best = best[np.concatenate([[True], context[best[1:]] != context[best[:-1]]])]  # the smallest of equals
    keep = most >= LEAST
    best, every, most = best[keep], every[keep], most[keep]
    return context[best], keys[best] & np.uint64(0xFFFF), most, np.maximum(most * 15 // every, 1)


class Tables:
    """What all blocks of a segment share. Entries are id << 16 | class << 12, of order 2 with a tag below."""

    def __init__(self, one: np.ndarray, two: np.ndarray, often: int):
        self.one = np.full(1 << 16, often << 16, np.uint32)
        self.two = np.full(1 << 16, NONE, np.uint32)  # no pair hashed to slot 0 has this tag, others are checked on writing
        self.one[one[0]] = one[1]
        self.two[two[0]] = two[1]
        self.often, self.parts = often, (*one, *two)
        self.chances = np.zeros((3, STATES), np.int32)

    @classmethod
    def counted(cls, ids: np.ndarray) -> Tables:
        wide = ids.astype(np.uint64)
        empty = (np.zeros(0, np.uint16), np.zeros(0, np.uint32))
        one = two = empty
        often = int(np.bincount(ids).argmax())
        if len(ids) > 1:
            at, best, _, sure = successors(wide[:-1] << np.uint64(16) | wide[1:])
            one = (at.astype(np.uint16), (best << np.uint64(16) | sure.astype(np.uint64) << np.uint64(12)).astype(np.uint32))
        if len(ids) > 2:
            pairs, best, most, sure = successors(wide[:-2] << np.uint64(32) | wide[1:-1] << np.uint64(16) | wide[2:])
            entry = (best << np.uint64(16) | sure.astype(np.uint64) << np.uint64(12)).astype(np.uint32)
            plain = np.full(1 << 16, often << 16, np.uint32)
            plain[one[0]] = one[1]
            last, before = (pairs & np.uint64(0xFFFF)).astype(np.uint32), (pairs >> np.uint64(16)).astype(np.uint32)
            news = np.flatnonzero(entry != plain[last])  # the rest is what order 1 says
            news = news[np.argsort(most[news], kind="stable")]
            h = pair_hash(last[news], before[news])
            slots = np.full(1 << 16, -1)
            slots[h >> np.uint32(16)] = np.arange(len(h))  # of those in one slot the most frequent stays
            used = np.flatnonzero(slots >= 0)
            two = (used.astype(np.uint16), entry[news][slots[used]] | (h[slots[used]] & np.uint32(0xFFF)))
        return cls(one, two, often)

    def candidates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second candidate after the ids ``a`` (last) and ``b``, and the states of orders 2 and 1."""
        h = pair_hash(a, b)
        second = self.one.take(a)
        first = self.two.take(h >> np.uint32(16))
        h ^= first
        h &= np.uint32(0xFFF)
        known = h == 0
        first = np.where(known, first, second)
        id1, id2 = second >> np.uint32(16), first >> np.uint32(16)
        state = (id1 == id2) + (known.view(np.uint8) << 1)
        first >>= np.uint32(10)
        second >>= np.uint32(10)
        first &= np.uint32(60)
        second &= np.uint32(60)
        first |= state
        second |= state
        return id2, id1, first, second

    def plain(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Frequencies of order 0: ``ids`` in ascending order, ``counts`` with the sum 1 << PLAIN."""
        self.rest = (ids, counts)
        self.width = np.zeros(1 << 16, np.int64)
        self.width[ids] = counts
        self.start = np.zeros(1 << 16, np.int64)
        self.start[ids] = np.cumsum(counts) - counts
        self.symbol = np.repeat(ids, counts).astype(np.uint32)

    def count_plain(self, ids: np.ndarray) -> None:
        """Order 0 of the ids that no candidate foretold."""
        counts = np.bincount(ids, minlength=1)
        seen = np.flatnonzero(counts) if len(ids) else np.zeros(1, np.int64)
        share = 1 + counts[seen] * ((1 << PLAIN) - len(seen)) // max(len(ids), 1)
        share[share.argmax()] += (1 << PLAIN) - share.sum()
        self.plain(seen, share)

    def to_bytes(self) -> bytes:
        """Counts, then slots as distances, entries, chances and order 0; compressed, and so checksummed."""
        at1, entry1, at2, entry2 = self.parts
        ids, counts = self.rest
        head = np.array([len(at1), len(at2), len(ids), self.often], "<u4").tobytes()
        steps = [np.diff(x.astype(np.int64), prepend=0).astype("<u2").tobytes() for x in (at1, at2, ids)]
        return zlib.compress(b"".join([head, *steps, entry1.astype("<u4").tobytes(), entry2.astype("<u4").tobytes(),
                                       counts.astype("<u4").tobytes(), self.chances.astype("<u2").tobytes()]), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> Tables:
        data = zlib.decompress(data)
        n1, n2, n0, often = np.frombuffer(data, "<u4", 4).tolist()
        place = 16

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal place
            part = np.frombuffer(data, kind, n, place)
            place += part.nbytes
            return part

        at1, at2, ids = (np.cumsum(take("<u2", n).astype(np.int64)) for n in (n1, n2, n0))
        entry1, entry2, counts = (take("<u4", n) for n in (n1, n2, n0))
        own = cls((at1, entry1), (at2, entry2), often)
        own.plain(ids, counts.astype(np.int64))
        own.chances[:] = take("<u2", 3 * STATES).reshape(3, STATES)
        return own


def active(lengths: np.ndarray) -> np.ndarray:
    """How many blocks have an id at each step; blocks are ordered by length, longest first."""
    return np.searchsorted(-lengths, -np.arange(lengths[0]), "left")


def rate(hits: np.ndarray, every: np.ndarray) -> np.ndarray:
    """How often a state's candidate came, in 16 bits, never 0 or all."""
    return np.clip((hits + 0.4) * 65536 / (every + 0.8), 32, 65504).astype(np.int32)


def contexts(ids: np.ndarray, tables: Tables, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States of orders 2 and 1 of all ids, and what came: 0 the first candidate, 1 the second, 2 neither, 3 no id there."""
    steps, rows = ids.shape
    last = np.zeros((steps + 2, rows), np.uint32)
    last[2:] = ids
    at2, at1, came = (np.empty(ids.shape, np.uint8) for _ in range(3))
    for t in range(0, steps, SLICE):
        end = min(t + SLICE, steps)
        id2, id1, at2[t:end], at1[t:end] = tables.candidates(last[t + 1 : end + 1], last[t:end])
        own = last[t + 2 : end + 2]
        came[t:end] = np.where(own == id2, 0, np.where(own == id1, 1, 2))
    came[np.arange(steps)[:, None] >= lengths] = 3
    return at2, at1, came


def counts(states: np.ndarray, came: np.ndarray) -> np.ndarray:
    """How often the first candidate, the second and neither came in each state."""
    return np.bincount((states << 2 | came).reshape(-1), minlength=4 * STATES).reshape(STATES, 4).T[:3]


def encode_segment(ids: np.ndarray) -> list[bytes]:
    """The tables' bytes, then a payload for each ``BLOCK`` ids. Ids have 16 bits; there is at least one."""
    if ids.min() < 0 or ids.max() >= 1 << 16:
        raise ValueError("ids beyond 65,535 can't be coded")
    rows, width = -(-len(ids) // BLOCK), min(BLOCK, len(ids))
    lengths = np.minimum(len(ids) - np.arange(rows) * BLOCK, BLOCK)
    own = np.zeros((rows, width), np.uint16)
    own.reshape(-1)[: len(ids)] = ids
    own = np.ascontiguousarray(own.T)
    tables = Tables.counted(ids)
    at2, at1, came = contexts(own, tables, lengths)
    tables.count_plain(own[came == 2])
    first2, *rest2 = counts(at2, came)
    first1, second1, none1 = counts(at1, came)
    tables.chances[0], tables.chances[1] = rate(first2, first2 + sum(rest2)), rate(first1, first1 + second1 + none1)
    tables.chances[2] = np.where(np.arange(STATES) & 1, 0, rate(second1, second1 + none1))

    # Weights of all steps first, then the chances of all ids, then the coder from the last id to the first.
    start, size = np.empty(own.shape, np.uint32), np.empty(own.shape, np.uint32)
    weight = np.full(rows, FULL // 2, np.int32)
    for t in range(0, width, SLICE):
        part = slice(t, min(t + SLICE, width))
        p2, p1, other = (tables.chances[k].take(at[part]) for k, at in ((0, at2), (1, at1), (2, at1)))
        hit = came[part] == 0
        moves = np.where((p2 > p1) == hit, np.int32(MOVE), np.int32(-MOVE))
        weights = np.empty_like(moves)
        for k, move in enumerate(moves):
            weights[k] = weight
            weight += move
            np.minimum(np.maximum(weight, 0, out=weight), FULL, out=weight)
        p, q, left = split(p2, p1, other, weights)
        mine = own[part]
        second = came[part] == 1
        size[part] = np.where(hit, p << PLAIN, np.where(second, q << PLAIN, left * tables.width.take(mine)))
        start[part] = np.where(hit, 0, np.where(second, p << PLAIN, ((p + q) << PLAIN) + left * tables.start.take(mine)))
    words, at, state = np.empty((rows, width + 1), np.uint32), np.zeros(rows, np.int64), np.full(rows, 1 << 31, np.uint64)
    line = np.arange(rows) * words.shape[1]
    flat = words.reshape(-1)
    for t, n in zip(range(width - 1, -1, -1), active(lengths)[::-1].tolist()):
        f, x = size[t, :n].astype(np.uint64), state[:n]
        full = np.flatnonzero(x >= f << np.uint64(33))
        if len(full):
            high = x[full]
            flat[line[full] + at[full]] = high.astype(np.uint32)
            at[full] += 1
            x[full] = high >> np.uint64(32)
        times = x // f
        state[:n] = (times << np.uint64(TOTAL)) + (x - times * f) + start[t, :n]
    return [tables.to_bytes()] + [
        int(x).to_bytes(8, "little") + words[i, :n][::-1].astype("<u4").tobytes() for i, (x, n) in enumerate(zip(state, at.tolist()))
    ]


def split(p2: np.ndarray, p1: np.ndarray, other: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of 1 << SCALE for the first candidate, the second and all else; only the second's is empty, where ``other`` is 0."""
    p = (p1 + ((p2 - p1) * weight >> 8)) >> (16 - SCALE)
    left = (1 << SCALE) - p
    q = np.maximum(left * other >> 16, other > 0)
    return p, q, left - q


def decode_segment(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """All ids of the blocks, one block after the other; ``payloads`` begin with the tables, lengths with the longest."""
    tables, payloads = Tables.from_bytes(payloads[0]), payloads[1:]
    rows, steps = len(payloads), int(lengths[0])
    wide = max(map(len, payloads)) // 4 * 4 + 8
    data = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in payloads), "<u4").reshape(rows, wide // 4)
    state = data[:, 0] | data[:, 1].astype(np.uint64) << np.uint64(32)
    data = data.reshape(-1)
    at = np.arange(rows) * (wide // 4) + 2
    weight = np.full(rows, FULL // 2, np.int32)
    out = np.zeros((steps + 2, rows), np.uint32)
    chance2, chance1, chance0 = tables.chances
    span, offset = tables.width, tables.start
    for t, n in enumerate(active(lengths).tolist()):
        if n < len(state):
            state, at, weight = state[:n], at[:n], weight[:n]
        id2, id1, at2, at1 = tables.candidates(out[t + 1, :n], out[t, :n])
        p2, p1 = chance2.take(at2), chance1.take(at1)
        p, q, left = split(p2, p1, chance0.take(at1), weight)
        value = (state & np.uint64((1 << TOTAL) - 1)).astype(np.int64)
        begin = p << PLAIN
        second = (p + q) << PLAIN
        hit, plain = value < begin, value >= second
        plain_id = tables.symbol.take(((value - second) / left).astype(np.int64), mode="clip")  # exact: 30 bits by 12
        own = np.where(hit, id2, np.where(plain, plain_id, id1))
        size = np.where(hit, begin, np.where(plain, left * span.take(plain_id), q << PLAIN))
        value -= np.where(hit, 0, np.where(plain, second + left * offset.take(plain_id), begin))
        state >>= np.uint64(TOTAL)
        state *= size.view(np.uint64)
        state += value.view(np.uint64)
        low = np.flatnonzero(state < np.uint64(1 << 31))
        if len(low):
            place = at[low]
            state[low] = state[low] << np.uint64(32) | data.take(place, mode="clip")
            at[low] = place + 1
        out[t + 2, :n] = own
        weight += np.where((p2 > p1) == hit, np.int32(MOVE), np.int32(-MOVE))
        np.minimum(np.maximum(weight, 0, out=weight), FULL, out=weight)
    return np.ascontiguousarray(out[2:].T).reshape(-1)[: int(lengths.sum())]
