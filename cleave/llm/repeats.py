"""Suffix-array dedup: passages of ``width`` bytes that occurred earlier, by merging Burrows-Wheeler transforms of shards.

Method.
1. Every window of ``width`` bytes has one anchor, its k-gram of smallest hash.  Equal windows have equal anchors at equal
   places, so windows whose anchor is unique in the corpus are unique, and the corpus falls apart by anchor.  Windows in a row with
   one anchor are a context.  A task keeps the first of its equal contexts; the others repeat it, whole.
2. Contexts meet by anchor (one shuffle of hashes, no texts).  The first of equal contexts stays, the others repeat it.  An anchor
with a single context is done; contexts of the others are contested.
3. Contested contexts get their bytes and are cut in three by where in a window the anchor stands; windows of one part have more in
common than the anchor, by the hash of which they meet once more, as in 2.  What stays contested differs in a few bytes about a long
common core.
4. Those contexts meet by core.  A task cuts them into shards, makes each shard's
suffix array and Burrows-Wheeler transform, and merges the transforms by refining the interleave: one pass sorts the rows stably by
their transform symbol, which after h passes orders all suffixes by h symbols without sorting suffixes anew; where a pass first parts two
rows gives their common prefix.  Runs of rows with a common prefix of ``width`` are the repeated intervals; in each, all but the
first in (doc_id, text hash, start) repeat it.  Cores with more than HOT contexts (a passage that very many documents share, and what
stands before and after it) would fill one task: their windows, 23 a context at most, are spread by their own hash and settled as in 2.
5. A document loses the bytes that its repeating windows cover.

Edge cases.  A null text is empty; texts below ``width`` bytes lose nothing.  A null doc_id orders before all others.  Rows that
repeat a doc_id with the same text are one document and get the same result; rows of one doc_id (or of none) with different texts are documents of
their own, in the order of the texts' 64-bit hashes.  Extra columns are not read by :func:`repeated_spans`.
A text longer than a chunk is held whole by its task, with some 60 bytes of arrays a byte.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.llm.textbytes import Texts, chunks, mix, to_signed
from cleave.session import bounded_batches, materialise

U64 = np.uint64
NO_ID = -(1 << 63)
#: Bytes of contexts that a task merges at once, and shards they are cut into.
MERGE_BYTES, SHARDS = 512 << 10, 2
#: Parts of the places that an anchor can have in a window, and contexts under one key above which windows are told apart one by one.
THIRDS, HOT = 3, 2048


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` values in a row."""
    n = len(v) - w + 1
    padded = np.full((len(v) + w - 1) // w * w, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def contexts(t: Texts, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window start, windows, anchor hash and context hash of every context."""
    size = len(t.data)
    none = np.zeros(0, np.int64)
    if size < width:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = np.arange(size - k + 1)
    grams = t.hash.spans(at, at + k)
    bits = U64(max(24, int(size).bit_length()))
    least = sliding_min((grams >> bits << bits) | at.astype(np.uint64), width - k + 1)
    end = np.repeat(t.offs[1:], np.diff(t.offs))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + width <= end)
    anchor = (least[start] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    lo = start[first]
    text = np.searchsorted(t.offs, lo, "right") - 1
    return text, lo, n, grams[anchor[first]], t.hash.spans(lo, lo + n + width - 1)


def _candidates(docs: DataFrame, width: int, k: int) -> DataFrame:
    """``anchor, context, id, own, lo, n, done``: the contexts of all texts; ``done`` (with a scattered anchor) where an equal one comes earlier in the task's chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in chunks(batches, "_text"):
            text, lo, n, anchor, context = contexts(t, width, k)
            ids, own = (rows.column(i).to_numpy(zero_copy_only=False)[text] for i in (0, 1))
            lo = lo - t.offs[text]
            with np.errstate(over="ignore"):
                key = mix(anchor + mix(context))
            order = np.lexsort((lo, own, ids, key))
            same = np.zeros(len(key), bool)
            a, b = order[1:], order[:-1]
            same[1:] = key[a] == key[b]
            leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))  # the first of each run of equal contexts
            done = np.zeros(len(key), bool)
            lead = order[leader]
            done[order] = same & ((ids[lead] != ids[order]) | (own[lead] != own[order]) | (lo[lead] != lo[order]))
            with np.errstate(over="ignore"):  # what is done needs no meeting; it goes anywhere
                anchor = np.where(done, mix(ids.astype(np.uint64) + mix(lo.astype(np.uint64))), anchor)
            yield pa.RecordBatch.from_arrays([pa.array(to_signed(anchor)), pa.array(to_signed(context)), pa.array(ids), pa.array(own), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(done)], names=["anchor", "context", "id", "own", "lo", "n", "done"])

    return _keyed(docs).mapInArrow(run, "anchor long, context long, id long, own long, lo int, n int, done boolean")


def _keyed(docs: DataFrame, *cols: F.Column) -> DataFrame:
    """``_id, _own, _text``: a row's place in the order (null ids first; then the text's hash, which tells rows of one id apart) and its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("_id"), F.xxhash64(text).alias("_own"), text.alias("_text"), *cols)


FOUND = "id long, own long, lo int, n int, anchor long, bytes binary"


def _resolve(candidates: DataFrame) -> DataFrame:
    """FOUND: repeating windows (no anchor) and contested contexts (with theirs, and their bytes where ``candidates`` has them).

    Each task reads its rows in the order of (anchor, context, id, own, lo), batch by batch, and keeps one row of state.
    """
    if "bytes" not in candidates.columns:
        candidates = candidates.withColumn("bytes", F.lit(None).cast("binary"))
    rows = candidates.select("anchor", "context", "id", "own", "lo", "n", "done", "bytes").repartition("anchor").sortWithinPartitions("anchor", "context", "id", "own", "lo")
    names = ["id", "own", "lo", "n", "anchor", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the first context of the last anchor while it has no other
        last: tuple | None = None  # anchor, context, and the first row (id, own, lo) of the last class
        told = False  # whether the last anchor is contested
        for b in batches:
            if not b.num_rows:
                continue
            *cols, done = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            if done.any():
                at = np.flatnonzero(done)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in cols[2:]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())], names=names)
            open_ = np.flatnonzero(~done)
            anchor, context, ids, own, lo, n = (c[open_] for c in cols)
            size = len(anchor)
            if not size:
                continue
            fresh_anchor, fresh = np.ones(size, bool), np.ones(size, bool)
            fresh_anchor[1:] = anchor[1:] != anchor[:-1]
            fresh[1:] = fresh_anchor[1:] | (context[1:] != context[:-1])
            if last is not None and anchor[0] == last[0]:
                fresh_anchor[0] = False
                fresh[0] = context[0] != last[1]
            # the first row of each class
            lead = np.maximum.accumulate(np.where(fresh, np.arange(size), -1))
            firsts = [x[lead] for x in (ids, own, lo)]
            if not fresh[0]:
                carried = lead < 0
                for x, v in zip(firsts, last[2:], strict=True):
                    x[carried] = v
            repeat = ~fresh & ((firsts[0] != ids) | (firsts[1] != own) | (firsts[2] != lo))
            # classes of each anchor in this batch
            group = np.cumsum(fresh_anchor) - (1 if fresh_anchor[0] else 0)
            count = np.bincount(group, fresh, minlength=group[-1] + 1)
            if not fresh_anchor[0]:
                count[0] += 1  # the class that was held
            contested = np.flatnonzero(fresh & (count[group] > 1))
            at = np.flatnonzero(repeat)
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in (ids, own, lo, n)), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())], names=names)
            if held is not None and not fresh_anchor[0] and not told and count[0] > 1:
                yield held
                told = True
            row = lambda at: pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in (ids, own, lo, n, anchor)), b.column(7).take(pa.array(open_[at]))], names=names)  # noqa: E731, B023
            if len(contested):
                yield row(contested)
            where = np.flatnonzero(fresh_anchor)
            if len(where):
                held, told = row(where[-1:]), bool(count[group[-1]] > 1)
            last = (anchor[-1], context[-1], *(x[-1] for x in firsts))

    return rows.mapInArrow(run, FOUND)


def suffix_array(symbols: np.ndarray, string: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of all strings (each ends with symbol 0) in the order of their first ``depth`` symbols or more, then of position."""
    size = len(symbols)
    h = 8 if symbols.dtype == np.uint8 else 1
    key = symbols.astype(np.uint64)
    for j in range(1, h):  # the first symbols side by side in one number
        key <<= U64(8)
        inside = string[j:] == string[:-j]
        key[: size - j] |= np.where(inside, symbols[j:], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.empty(size, np.int64)
    while True:
        key = key[order]
        new = key[1:] != key[:-1]
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        if h >= depth or new.all():
            return order
        second = np.zeros(size, np.int64)
        if size > h:
            inside = string[h:] == string[:-h]
            second[:-h][inside] = rank[h:][inside] + 1
        key = rank * (size + 2) + second
        order = np.argsort(key, kind="stable")
        h *= 2


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' transforms (symbol 0 ends a string) and the common prefix of each row with the row before.

    Common prefixes are exact below ``depth`` and ``depth`` from there on.
    """
    z = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(x) for x in transforms])
    head = np.repeat(np.arange(len(transforms), dtype=np.uint8), [np.count_nonzero(x == 0) for x in transforms])  # rows of the strings' ends stay in shard order
    m, size = len(head), len(z)
    common = np.full(size, depth, np.uint8)
    common[0] = 0
    block = np.zeros(size, np.int32)
    symbol = np.empty(size, transforms[0].dtype)
    parted = np.ones(size, bool)
    for h in range(depth):
        for s, own in enumerate(transforms):
            symbol[z == s] = own
        order = np.argsort(symbol, kind="stable")
        first, under = symbol[order], block[order]
        z = z[order]
        z[:m] = head
        np.not_equal(under[1:], under[:-1], out=parted[1:])
        parted[1:] |= first[1:] != first[:-1]
        parted[1:m] = h > 0  # an end equals nothing beyond itself
        common[parted & (common == depth)] = h
        np.cumsum(parted, dtype=np.int32, out=block)
        if h and block[-1] == size:
            break
    return z, common


def repeating_windows(strings: list[bytes], windows: np.ndarray, ids: np.ndarray, lo: np.ndarray, width: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Id and start of each window that an earlier one of the strings' windows equals."""
    length = np.array([len(s) + 1 for s in strings])
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    used = np.bincount(raw, minlength=256) > 0  # UTF-8 leaves byte values unused, so the end and all symbols fit in a byte
    data = np.cumsum(used).astype(np.uint8 if np.count_nonzero(used) < 256 else np.uint16)[raw]
    ends = np.cumsum(length)
    data[ends - 1] = 0
    cut = np.unique(np.linspace(0, len(strings), min(shards, len(strings)) + 1).astype(int))
    arrays, transforms = [], []
    string = np.repeat(np.arange(len(strings)), length)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        start, end = ends[a] - length[a], ends[b - 1]
        part, own = data[start:end], string[start:end]
        sa = suffix_array(part, own, width)
        before = part[sa - 1].copy()
        before[np.isin(sa, ends[a:b] - length[a:b] - start)] = 0
        arrays.append(sa + start)
        transforms.append(before)
    z, common = merge_transforms(transforms, width)
    position = np.empty(len(data), np.int64)
    position[np.argsort(z, kind="stable")] = np.concatenate(arrays)
    interval = np.cumsum(common < width)
    which = string[position]
    offset = position - (ends[which] - length[which])
    valid = np.flatnonzero(offset < windows[which])
    interval, who, start = interval[valid], ids[which[valid]], lo[which[valid]] + offset[valid]
    order = np.lexsort((start, who, interval))
    interval, who, start = interval[order], who[order], start[order]
    again = np.zeros(len(order), bool)
    again[1:] = interval[1:] == interval[:-1]
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    again &= (who != who[lead]) | (start != start[lead])
    return who[again], start[again]


def _spans_of(who: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in a row as (id, first start, number)."""
    order = np.lexsort((start, who))
    who, start = who[order], start[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return who[first], start[first], np.diff(np.append(first, len(who)))


def _refined(contested: DataFrame, docs: DataFrame, width: int, k: int) -> DataFrame:
    """The contested contexts as candidates again, with their bytes: windows in which the anchor stands in the same third of the
    possible places share more than the anchor, and meet under the hash of all that such windows have in common around it."""
    wanted = contested.groupBy("id", "own").agg(F.collect_list(F.struct("anchor", "lo", "n")).alias("at"))  # bounded by the text's length
    joined = _keyed(docs).join(wanted, (F.col("id") == F.col("_id")) & (F.col("own") == F.col("_own"))).select("id", "own", "_text", "at")
    places = width - k + 1
    part = -(-places // THIRDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in chunks(batches, "_text"):
            at = rows.column(3)
            text = np.repeat(np.arange(t.n), at.value_lengths().to_numpy(zero_copy_only=False))
            anchor, lo, n = (c.to_numpy(zero_copy_only=False) for c in at.flatten().flatten())
            lo = lo + t.offs[text]
            # the anchor's place: its first occurrence in the context's bytes
            span = n + width - k
            first = np.concatenate([[0], np.cumsum(span)])
            spot = np.repeat(lo - first[:-1], span) + np.arange(first[-1])
            is_anchor = t.hash.spans(spot, spot + k).view(np.int64) == np.repeat(anchor, span)
            hit = np.flatnonzero(is_anchor)
            place = spot[hit[np.searchsorted(hit, first[:-1])]]
            out = []
            for j in range(THIRDS):  # windows that start where the anchor's offset is in part j
                low, high = j * part, min((j + 1) * part, places) - 1
                a, b = np.maximum(lo, place - high), np.minimum(lo + n - 1, place - low)
                some = np.flatnonzero(a <= b)
                a, b, p = a[some], b[some], place[some]
                core = t.hash.spans(p - low, p + width - high)
                with np.errstate(over="ignore"):
                    key = mix(core + mix(anchor[some].view(np.uint64) + U64(j)))
                out.append((key, t.hash.spans(a, b + width), some, a, b + 1 - a))
            key, context, some, a, m = (np.concatenate(x) for x in zip(*out, strict=True))
            who = text[some]
            size = m + width - 1
            offs = np.concatenate([[0], np.cumsum(size)])
            data = t.data[np.repeat(a - offs[:-1], size) + np.arange(offs[-1])]
            raw = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])
            ids, own = (rows.column(i).to_numpy(zero_copy_only=False)[who] for i in (0, 1))
            whole = pa.RecordBatch.from_arrays([pa.array(to_signed(key)), pa.array(to_signed(context)), pa.array(ids), pa.array(own), pa.array((a - t.offs[who]).astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(np.zeros(len(a), bool)), raw], names=["anchor", "context", "id", "own", "lo", "n", "done", "bytes"])
            yield from (whole.slice(x, 1 << 15) for x in range(0, len(whole), 1 << 15))

    return joined.mapInArrow(run, "anchor long, context long, id long, own long, lo int, n int, done boolean, bytes binary")


def _single_windows(contested: DataFrame, width: int) -> DataFrame:
    """Candidates again, of one window each, under the window's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Texts.of(b.column(5))
            ids, own, lo, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = t.offs[row] + step
            h = t.hash.spans(at, at + width)
            yield pa.RecordBatch.from_arrays([pa.array(to_signed(h)), pa.array(to_signed(mix(h))), pa.array(ids[row]), pa.array(own[row]), pa.array((lo[row] + step).astype(np.int32)), pa.array(np.ones(len(row), np.int32)), pa.array(np.zeros(len(row), bool))], names=["anchor", "context", "id", "own", "lo", "n", "done"])

    return contested.select("id", "own", "lo", "n", "anchor", "bytes").mapInArrow(run, "anchor long, context long, id long, own long, lo int, n int, done boolean")


def _merge(contested: DataFrame, width: int) -> DataFrame:
    """``id, own, lo, n``: the repeating windows of contested contexts, which meet by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, anchor = 0, None

        def done() -> pa.RecordBatch:
            ids, own, lo, n = (np.array(x) for x in list(zip(*held, strict=True))[:4])
            order = np.lexsort((own, ids))
            new = np.ones(len(ids), bool)
            new[1:] = (ids[order][1:] != ids[order][:-1]) | (own[order][1:] != own[order][:-1])
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.cumsum(new) - 1
            who, start, many = _spans_of(*repeating_windows([x[4] for x in held], n, rank, lo, width))
            row = order[new][who]
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own[row]), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32))], names=["id", "own", "lo", "n"])

        for b in batches:
            for a, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if a != anchor and size > MERGE_BYTES:
                    yield done()
                    held, size = [], 0
                anchor = a
                held.append(tuple(row))
                size += len(row[4])
        if held:
            yield done()

    pieces = contested.select("anchor", "id", "own", "lo", "n", "bytes")
    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "id long, own long, lo int, n int")


def repeated_spans(docs: DataFrame, width: int = 100, k: int = 32) -> DataFrame:
    """``id, own, at``: the repeating windows of each document (null id as NO_ID; ``own``: the text's hash), as runs of starts."""
    bounded_batches(docs.sparkSession)
    found = materialise(_resolve(_candidates(docs, width, k)), "repeats-found")
    near = materialise(_resolve(_refined(found.where("anchor is not null"), docs, width, k)), "repeats-near")
    contested = near.where("anchor is not null")
    hot = contested.groupBy("anchor").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT).select("anchor")  # counts combine before the shuffle
    hot = materialise(hot, "repeats-hot")
    merged = materialise(_merge(contested.join(hot, "anchor", "left_anti"), width), "repeats-merged")
    singles = _resolve(_single_windows(contested.join(hot, "anchor", "left_semi"), width)).where("anchor is null")
    parts = [found.where("anchor is null"), near.where("anchor is null"), merged, singles]
    windows = parts[0].select("id", "own", "lo", "n")
    for x in parts[1:]:
        windows = windows.union(x.select("id", "own", "lo", "n"))
    return windows.groupBy("id", "own").agg(F.collect_list(F.struct("lo", "n")).alias("at"))


def covered(size: int, at: list[dict] | None, width: int) -> np.ndarray:
    """Which of ``size`` bytes the windows cover."""
    if not at:
        return np.zeros(size, bool)
    change = np.zeros(size + 1, np.int32)
    lo = np.array([x["lo"] for x in at])
    np.add.at(change, lo, 1)
    np.add.at(change, np.minimum(lo + [x["n"] + width - 1 for x in at], size), -1)
    return np.cumsum(change[:-1]) > 0


def _with_spans(docs: DataFrame, width: int, k: int, *cols: F.Column) -> DataFrame:
    """``cols`` of every row, and ``at`` (null where nothing repeats)."""
    spans = repeated_spans(docs, width, k)
    rows = _keyed(docs, *cols).drop("_text")
    return rows.join(spans, (F.col("_id") == F.col("id")) & (F.col("_own") == F.col("own")), "left")


def removed(docs: DataFrame, width: int = 100, k: int = 32) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    rows = _with_spans(docs, width, k, F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).cast("binary").alias("_bytes")).select("_doc", "_bytes", "at")
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, at in zip(b.column(1), b.column(2), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                gone = covered(len(raw), at.as_py(), width)
                starts = np.count_nonzero(gone[1:] & ~gone[:-1]) + (1 if len(gone) and gone[0] else 0)
                for c, v in zip(out, (len(raw), int(gone.sum()), int(starts), hashlib.sha256(raw[~gone].tobytes()).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, width: int = 100, k: int = 32) -> DataFrame:
    """``docs`` with the repeating bytes taken out of ``text`` (a character cut in part goes whole) and ``n_chars`` counted anew."""
    rows = _with_spans(docs, width, k, F.struct(*docs.columns).alias("row"))
    kept = F.pandas_udf(lambda text, at: _cut_texts(text, at, width), "string")
    some = F.col("at").isNotNull()
    text = F.when(some, kept(F.when(some, F.col("row.text").cast("binary")), F.coalesce("at", F.array().cast("array<struct<lo:int,n:int>>")))).otherwise(F.col("row.text"))
    out = rows.withColumn("_new", text)
    cols = [F.col("_new").alias(c) if c == "text" else F.char_length("_new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*cols)


def _cut_texts(text, at, width):  # noqa: ANN001, ANN202
    import pandas as pd

    out = []
    for raw, spans in zip(text, at, strict=True):
        if raw is None:  # nothing repeats in it
            out.append(None)
            continue
        x = np.frombuffer(raw, np.uint8)
        gone = covered(len(x), list(spans) if spans is not None else None, width)
        out.append(x[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else raw.decode("utf-8", "ignore"))
    return pd.Series(out)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Windows as hexadecimal text, which DuckDB can cut; 128-bit hashes stand for them.
SQL = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, n - 99)) AS p, x FROM t WHERE n >= 100
), h AS (
  SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS h FROM w
), f AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM h
), s AS (
  SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM f WHERE k > 1
), r AS (
  SELECT doc_id, p, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s
), g AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY doc_id, run
), c AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM g GROUP BY doc_id
), k AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS u, a AS v FROM g
  UNION ALL SELECT doc_id, max(b), (SELECT n FROM t WHERE t.doc_id = g.doc_id) FROM g GROUP BY doc_id
), z AS (
  SELECT k.doc_id, string_agg(substr(x, 2 * u + 1, 2 * (v - u)), '' ORDER BY u) AS kept FROM k JOIN t USING (doc_id) GROUP BY k.doc_id
)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN z USING (doc_id)
"""
