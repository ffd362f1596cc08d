"""Triangles counted between blocks of vertices, on arrays: the steps that a distributed count hands to Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs made or looked up at a time.
CHUNK = 1 << 21
#: Words of bits read at a time, and bytes of bit maps a count may hold.
WORDS, MOST_BITS = 1 << 16, 256 << 20

Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def ints(data: bytes, size: int = 8) -> np.ndarray:
    return np.frombuffer(data, np.int64 if size == 8 else f"u{size}")


def sorted_groups(group: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (group, member) once, in their order."""
    order = np.lexsort((member, group))
    g, m = group[order], member[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (m[1:] != m[:-1])
    return g[new], m[new]


def sizes(group: np.ndarray) -> np.ndarray:
    """Lengths of the runs of ``group``."""
    ends = np.flatnonzero(np.append(group[1:] != group[:-1], len(group) > 0))
    return np.diff(ends, prepend=-1)


def pairs(member: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``member`` of every two members of a group, the earlier one first; groups lie one after the other, ``size`` are their sizes."""
    later = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(member))
    upto = np.cumsum(later)
    low = 0
    while low < len(member):
        base = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, base + CHUNK, "right")))
        n = later[low:high]
        left = np.repeat(np.arange(low, high), n)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        low = high


def block(ids: np.ndarray, k: int) -> np.ndarray:
    return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(k)).astype(np.int32)


def deal(u: np.ndarray, v: np.ndarray, w: np.ndarray | None, a: np.ndarray, b: np.ndarray, k: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Edges by the pair of their ends' blocks ``a`` and ``b``, the end in the smaller block first."""
    turn = a > b
    u, v, a, b = np.where(turn, v, u), np.where(turn, u, v), np.where(turn, b, a), np.where(turn, a, b)
    two = a * k + b
    order = np.argsort(two.astype(np.uint16) if k <= 256 else two, kind="stable")
    u, v, two = u[order], v[order], two[order]
    w = w if w is None else w[order]
    end = 0
    for n in sizes(two):
        low, end = end, end + n
        yield int(two[low]), u[low:end].tobytes(), v[low:end].tobytes(), b"" if w is None else w[low:end].tobytes()


def tie(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes, bytes, bytes, int, bytes, int]:
    """Edges with parallel ones summed, in few bytes: ids of the first and of the second ends, how many edges each first end has, the place of the second end and its bytes, the weight and its bytes."""
    us, vs = np.unique(u), np.unique(v)
    key = np.searchsorted(us, u) * len(vs) + np.searchsorted(vs, v)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    w, key = np.add.reduceat(w[order], first), key[first]
    few = lambda x: x.astype(np.min_scalar_type(int(x.max()))) if x.min() >= 0 and x.max() < 1 << 32 else x.astype(np.int64)
    n, at, w = np.bincount(key // len(vs), minlength=len(us)), few(key % len(vs)), few(w)
    return us.tobytes(), vs.tobytes(), n.tobytes(), at.tobytes(), at.itemsize, w.tobytes(), w.itemsize


class Near:
    """The neighbours in one block of the vertices of another: ``cols[ptr[r]:ptr[r + 1]]``, in their order."""

    def __init__(self, r: np.ndarray, c: np.ndarray, rows: int, cols: int) -> None:
        self.key = np.sort(r * cols + c)
        self.rows, self.width, self.cols = rows, cols, self.key % cols
        self.ptr = np.append(0, np.cumsum(np.bincount(r, minlength=rows)))
        self.n = np.diff(self.ptr)
        has = self.n > 0
        self.low, self.high = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        self.low[has], self.high[has] = self.cols[self.ptr[:-1][has]] >> 6, (self.cols[self.ptr[1:][has] - 1] >> 6) + 1
        self.words = (cols + 63) >> 6

    def bits(self) -> np.ndarray:
        out = np.empty((self.rows, self.words), np.uint64)
        step = max(1, (32 << 20) // (self.words * 64))
        for low in range(0, self.rows, step):
            high = min(self.rows, low + step)
            one = np.zeros((high - low, self.words * 64), bool)
            at = slice(self.ptr[low], self.ptr[high])
            one[self.key[at] // self.width - low, self.cols[at]] = True
            out[low:high] = np.packbits(one, axis=1, bitorder="little").view("<u8")
        return out


def common(eu: np.ndarray, ev: np.ndarray, p: Near, q: Near) -> np.ndarray:
    """For each edge of ``eu`` (in order) and ``ev`` how many neighbours its ends have in common, those of ``eu`` in ``p``, of ``ev`` in ``q``.

    Bit maps, over the words that the neighbours of ``eu`` span, or a look-up of each neighbour of the end that has fewer, whichever takes less.
    """
    out = np.zeros(len(eu), np.int64)
    live = np.flatnonzero((p.n[eu] > 0) & (q.n[ev] > 0))
    if not len(live):
        return out
    eu, ev = eu[live], ev[live]
    span, few = (p.high - p.low)[eu], np.minimum(p.n[eu], q.n[ev])
    starts = np.append(np.flatnonzero(np.append(True, eu[1:] != eu[:-1])), len(eu))
    dense = 3 * int(span.sum()) + 15_000 * len(starts) + (p.rows + q.rows) * p.width // 2  # about nanoseconds
    if (p.rows + q.rows) * p.words * 8 <= MOST_BITS and dense < 120 * int(few.sum()):
        out[live] = _by_bits(eu, ev, starts, p, q)
    else:
        out[live] = _by_look_up(eu, ev, few, p, q)
    return out


def _by_bits(eu: np.ndarray, ev: np.ndarray, starts: np.ndarray, p: Near, q: Near) -> np.ndarray:
    out = np.empty(len(eu), np.int64)
    mine, theirs = p.bits(), q.bits() if q is not p else None
    theirs = mine if theirs is None else theirs
    if len(eu) < 16 * len(starts):  # few edges a vertex: both ends' bits are fetched
        step = max(1, WORDS // p.words)
        for low in range(0, len(eu), step):
            x = mine.take(eu[low : low + step], 0)
            x &= theirs.take(ev[low : low + step], 0)
            out[low : low + step] = np.bitwise_count(x).sum(axis=1, dtype=np.uint32)
        return out
    for low, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        u = eu[low]
        a, b = p.low[u], p.high[u]
        step = max(1, WORDS // int(b - a))
        row = mine[u, a:b]
        for at in range(low, end, step):
            to = min(end, at + step)
            x = theirs.take(ev[at:to], 0) if b - a == p.words else theirs[ev[at:to], a:b]
            x &= row
            out[at:to] = np.bitwise_count(x).sum(axis=1, dtype=np.uint32)
    return out


def _by_look_up(eu: np.ndarray, ev: np.ndarray, few: np.ndarray, p: Near, q: Near) -> np.ndarray:
    out = np.zeros(len(eu), np.int64)
    first = p.n[eu] <= q.n[ev]
    for mine, theirs, x, y, at in ((p, q, eu, ev, np.flatnonzero(first)), (q, p, ev, eu, np.flatnonzero(~first))):
        upto, low = np.cumsum(few[at]), 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + CHUNK, "right")))
            some = at[low:high]
            n = few[some]
            edge = np.repeat(np.arange(len(some)), n)
            z = mine.cols[np.repeat(mine.ptr[x[some]] - (np.cumsum(n) - n), n) + np.arange(len(edge))]
            key = y[some][edge] * theirs.width + z
            found = np.searchsorted(theirs.key, key)
            hit = theirs.key[np.minimum(found, len(theirs.key) - 1)] == key
            out[some] = np.bincount(edge[hit], minlength=len(some))
            low = high
    return out


def totals(three: tuple[int, int, int], tied: dict[tuple[int, int], tuple]) -> tuple[int, int]:
    """Number and weight of the triangles with a corner in each of the blocks ``three`` (in order; a block may come twice or three times), of what :func:`tie` gave for each pair of them.

    Number: the common neighbours of the edges between two of the blocks.  Weight: three a triangle, and what an edge weighs more than one for
    each triangle it is in, so that edges of weight one are looked at from one side only.
    """
    a, b, c = three
    sides = sorted({((a, b), c), ((a, c), b), ((b, c), a)})
    if any(two not in tied for two, _ in sides):
        return 0, 0
    ids = {x: np.unique(np.concatenate([ints(t[end]) for two, t in tied.items() for end in (0, 1) if two[end] == x])) for x in three}
    edges: dict[tuple[int, int], Edges] = {}
    for (x, y), (us, vs, n, at, wide, w, heavy) in tied.items():
        u = np.repeat(np.searchsorted(ids[x], ints(us)), ints(n))
        edges[x, y] = u, np.searchsorted(ids[y], ints(vs))[ints(at, wide)], ints(w, heavy).astype(np.int64)
    near: dict[tuple[int, int], Near] = {}

    def around(x: int, y: int) -> Near:
        if (x, y) not in near:
            u, v, _ = edges[min(x, y), max(x, y)]
            r, c = (u, v) if x < y else (v, u) if x > y else (np.concatenate([u, v]), np.concatenate([v, u]))
            near[x, y] = Near(r, c, len(ids[x]), len(ids[y]))
        return near[x, y]

    # of two blocks, edges inside the one that comes twice see each triangle once; of one, each triangle is seen three times
    whole = min(sides, key=lambda s: (s[0][0] != s[0][1] and len(sides) < 3, len(edges[s[0]][0])))
    number = weight = 0
    for side in sides:
        (x, y), z = side
        u, v, w = edges[x, y]
        if side != whole:
            more = w != 1
            u, v, w = u[more], v[more], w[more]
        t = common(u, v, around(x, z), around(y, z)) if len(u) else np.zeros(0, np.int64)
        number += int(t.sum()) if side == whole else 0
        weight += int(((w - 1) * t).sum())
    number //= 3 if a == c else 1
    return number, weight + 3 * number
