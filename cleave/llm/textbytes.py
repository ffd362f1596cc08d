"""Vectorised work on batches of UTF-8 texts: one byte array and offsets, no per-row Python."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled whole, alone.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_LUT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Tables of base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([[U64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _BASE_INV))
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class SpanHash:
    """64-bit hashes of any spans of one buffer of bytes or code points, from one prefix sum."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = _POWERS.get(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            symbol = _LUT[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) + U64(_BASE))
            symbol *= self.up[: len(data)]
            np.cumsum(symbol, out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal spans have equal hashes; the length takes part."""
        with np.errstate(over="ignore"):
            return mix(self.raw(start, end) + (np.asarray(end) - np.asarray(start)).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


class Texts:
    """A run of texts: ``data`` (uint8) and ``offs`` (int64, one more than texts)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        self.data, self.offs, self.n = data, offs, len(offs) - 1
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._hash: SpanHash | None = None

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """From an Arrow string or binary array; a null counts as an empty text."""
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
        return cls(data, offs - offs[0])

    @property
    def hash(self) -> SpanHash:
        if self._hash is None:
            self._hash = SpanHash(self.data)
        return self._hash

    def per_text(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Counts (or sums of weights) by text index."""
        return np.bincount(at, weights, self.n)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        total = np.zeros(len(flags) + 1, np.int64 if flags.dtype != np.float32 and flags.dtype != np.float64 else np.float64)
        np.cumsum(flags, out=total[1:], dtype=total.dtype)
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of each word ``[^\\x20\\x09-\\x0D]+``."""
        if self._words is None:
            inside = ~SPACE[self.data]
            before = np.zeros(len(inside), bool)
            before[1:] = inside[:-1]
            first = self.offs[:-1]
            before[first[first < len(inside)]] = False
            start = np.flatnonzero(inside & ~before)
            after = np.zeros(len(inside), bool)
            after[:-1] = inside[1:]
            last = self.offs[1:] - 1
            after[last[last >= 0]] = False
            end = np.flatnonzero(inside & ~after) + 1
            self._words = start, end, np.searchsorted(self.offs, start, "right") - 1
        return self._words

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of each \\n-split line (the break is left out)."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.offs[:-1], breaks + 1])
        text = np.concatenate([np.arange(self.n), np.searchsorted(self.offs, breaks, "right") - 1])
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        end = np.append(start[1:] - 1, len(self.data))
        last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
        end[last] = self.offs[text[last] + 1]
        return start, end, text

    def shingles(self, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and text indexes of all k-word shingles, repeats included.

        With ``whole_if_short`` a text of 1 to k-1 words has its whole sequence as one.
        """
        start, end, text = self.words()
        w = self.hash.spans(start, end)
        n = max(0, len(w) - k + 1)
        same = text[:n] == text[k - 1 :] if n else np.zeros(0, bool)
        with np.errstate(over="ignore"):
            h = np.full(n, k, np.uint64)
            for i in range(k):
                h = mix(h * U64(0xD1342543DE82EF95) + w[i : n + i])
            out, at = h[same], text[:n][same]
            if whole_if_short and len(text):
                count = np.bincount(text, minlength=self.n)
                short = np.flatnonzero((count > 0) & (count < k))
                if len(short):
                    lo = np.searchsorted(text, short)
                    hs = np.zeros(len(short), np.uint64)
                    for j, (a, c) in enumerate(zip(lo, count[short], strict=True)):
                        x = np.full(1, c, np.uint64)
                        for i in range(c):
                            x = mix(x * U64(0xD1342543DE82EF95) + w[a + i : a + i + 1])
                        hs[j] = x[0]
                    out, at = np.concatenate([out, hs]), np.concatenate([at, short])
        return out, at


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Row slices of at most ``most`` text bytes (one row at least), with their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = Texts.of(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(whole.offs, whole.offs[lo] + most, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            a, b = whole.offs[lo], whole.offs[hi]
            yield batch.slice(lo, hi - lo), Texts(whole.data[a:b], whole.offs[lo : hi + 1] - a)
            lo = hi
        del whole
    give_back()


def give_back() -> None:
    """Return freed memory to the system at a task's end: the process goes on to other tasks, beside an executor with a limit for both."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
