"""SentencePiece encoding and decoding by suffix-array matching over batches of text.

Method.  A batch's texts are put into the model's surface form and cut where a space mark follows another character, which no piece
crosses; equal units are encoded once.  All different units form one text with a suffix array (sorted to the longest
piece's length).  Every vocabulary piece is found in it by binary search, for all pieces at once: the ranges give all
occurrences, which are the edges of every unit's lattice.  Edges are sorted by where they end in their unit and relaxed in
that order: a merge-order (BPE) model has exactly one encoding of each prefix, and an edge continues the prefix that it starts at when
its piece and that prefix's last piece stay apart if encoded together.  Characters outside the vocabulary are edges of their own and become byte pieces.
Decoding joins piece bytes by table.

Units of which a batch has many are relaxed side by side as arrays; where only a few long ones (unbroken text) go on, edge by edge.

Edge cases.  An empty table gives an empty result; extra columns are not read; encodings have no ties.  A null text has null ids; an empty text has none.  The text's own U+2581 decodes to a space, as in the format.
Repeated rows are encoded each.  Only models without a normaliser, with a leading space mark, byte fallback and merge order are read;
others raise ValueError.  Texts of any length are encoded whole, an unbroken one with some 150 bytes of arrays a code point.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleave.llm.textbytes import SpanHash, Texts, chunks
from cleave.session import bounded_batches

SPACE = 0x2581
#: Ids of characters outside the vocabulary inside a lattice: this plus the code point.
OUTSIDE = 1 << 24
#: Closes a unit in the joined text; beyond all code points.
CLOSE = 0x110000
BATCH_BYTES = 1 << 20
#: Steps with fewer edges or units than this go through plain loops instead of arrays.
FEW = 24
#: Piece pairs that a process keeps in mind; beyond it starts anew.
MOST_PAIRS = 300_000
#: A process keeps the encodings of units it has met until they hold this many ids, then starts anew.
MET_IDS = 4_000_000


class Codec:
    """A model's pieces and tables."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]) -> None:
        self.byte_ids = np.array(byte_ids)
        special = {i for i, p in enumerate(pieces) if i < 3 or i in set(byte_ids)}
        self.id_of = {p: i for i, p in enumerate(pieces) if i not in special}
        self.score = {p: scores[i] for p, i in self.id_of.items()}
        self.pieces = pieces
        self.length = np.array([0 if i in special else len(p) for i, p in enumerate(pieces)])
        self.longest = int(self.length.max())
        used = sorted(self.id_of.values())
        self.ids = np.array(used)
        self.chars = np.zeros((len(used), self.longest), np.uint32)
        for row, i in enumerate(used):
            self.chars[row, : len(pieces[i])] = [ord(c) for c in pieces[i]]
        raw = [p.replace("▁", " ").encode() if i not in special else b"" for i, p in enumerate(pieces)]
        for value, i in enumerate(byte_ids):
            raw[i] = bytes([value])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_end = np.cumsum([len(x) for x in raw])
        self.raw_size = np.array([len(x) for x in raw])
        self.pairs: dict[int, bool] = {}  # piece pairs met so far, and whether they stay apart
        self._forget()

    @classmethod
    def load(cls, model: bytes) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if sp.encode("ﬁ  a", out_type=str)[:2] != ["▁", "ﬁ"] or any("▁" in p.lstrip("▁") for p in pieces) or sum(map(sp.is_byte, range(len(pieces)))) != 256:
            raise ValueError("not a model of the kind that is read here")
        return cls(pieces, [sp.get_score(i) for i in range(len(pieces))], [i for i in range(len(pieces)) if sp.is_byte(i)])

    def merged(self, parts: list[str]) -> list[str]:
        """Merge neighbours, best score first and leftmost of equals, until none is a piece."""
        parts = list(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether ``left`` and ``right``, encoded together, give just the two (-1: nothing on the left)."""
        out = (left >= OUTSIDE) | (right >= OUTSIDE)
        ask = np.flatnonzero(~out)
        keys, back = np.unique((left[ask].astype(np.int64) + 1) << 32 | right[ask], return_inverse=True)
        out[ask] = np.fromiter(map(self.pair, keys.tolist()), bool, len(keys))[back]
        return out

    def pair(self, key: int) -> bool:
        """Whether two pieces (left + 1 in the upper half, 0 for nothing; right in the lower) stay apart."""
        good = self.pairs.get(key)
        if good is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            a, b = (key >> 32) - 1, key & 0xFFFFFFFF
            q = self.pieces[b]
            good = self.pairs[key] = self.merged([*q]) == [q] if a < 0 else self.merged([*self.pieces[a], *q]) == [self.pieces[a], q]
        return good

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and piece id of every occurrence of a piece in ``text`` (code points)."""
        n, depth = len(text), self.longest
        rank, h = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while h < depth:
            second = np.zeros(n, np.int64)
            second[:-h] = rank[h:] + 1
            key = rank * (n + 2) + second
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            h *= 2
        padded = np.concatenate([text, np.full(depth, CLOSE, np.uint32)])
        size = self.length[self.ids]

        def search(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n)
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, n - 1)
                start = order[mid]
                state = np.zeros(len(self.ids), np.int8)  # sign of suffix minus piece at the first difference
                for d in range(depth):
                    open_ = np.flatnonzero((state == 0) & (size > d))
                    if not len(open_):
                        break
                    a, b = padded[start[open_] + d], self.chars[open_, d]
                    state[open_] = (a > b).astype(np.int8) - (a < b)
                left = (state < 0) | (after & (state == 0))
                active = lo < hi
                lo, hi = np.where(active & left, mid + 1, lo), np.where(active & ~left, mid, hi)
            return lo

        first, last = search(False), search(True)
        count = last - first
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return order[at], np.repeat(self.ids, count)

    def encode_units(self, text: np.ndarray, unit_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units of ``text`` (each closed by CLOSE) one after the other, and how many each has."""
        place, piece = self.occurrences(text)
        unit_start = np.concatenate([[0], unit_end[:-1] + 1])
        single = np.zeros(len(text), bool)
        single[place[self.length[piece] == 1]] = True
        rest = np.flatnonzero(~single & (text != CLOSE))
        place = np.concatenate([place, rest])
        piece = np.concatenate([piece, OUTSIDE + text[rest].astype(np.int64)])
        size = np.where(piece < OUTSIDE, self.length[np.minimum(piece, len(self.length) - 1)], 1)
        origin = unit_start[np.searchsorted(unit_end, place)]
        reach = place + size - origin
        order = np.argsort(reach.astype(np.int32), kind="stable")
        place, piece, size, origin, reach = (x[order] for x in (place, piece, size, origin, reach))
        last = np.full(len(text) + 1, -2, np.int64)  # last piece of the prefix that ends before this place
        step = np.searchsorted(reach, np.arange(1, reach.max(initial=0) + 2))
        few = np.flatnonzero(np.diff(step) < FEW)
        broad = int(few[0]) if len(few) else len(step) - 1  # from there on only a few units are left: edge by edge
        for a, b in zip(step[:broad], step[1 : broad + 1], strict=True):
            p, t, o = place[a:b], piece[a:b], origin[a:b]
            before = np.where(p == o, -1, last[p])
            open_ = np.flatnonzero(before != -2)
            good = open_[self.stay_apart(before[open_], t[open_])]
            last[p[good] + size[a:b][good]] = t[good]
        tail = slice(step[broad], None)
        if len(place[tail]):
            best, pair = last.tolist(), self.pair
            for p, t, o, z in zip(place[tail].tolist(), piece[tail].tolist(), origin[tail].tolist(), size[tail].tolist(), strict=True):
                before = -1 if p == o else best[p]
                if before != -2 and (t >= OUTSIDE or before >= OUTSIDE or pair(before + 1 << 32 | t)):
                    best[p + z] = t
            last = np.array(best, np.int64)
        out_place, out_id = [], []
        cursor, at = unit_end.copy(), np.flatnonzero(unit_end > unit_start)
        while len(at) >= FEW:  # back from the ends, all units at once
            t = last[cursor[at]]
            if (t < 0).any():
                raise ValueError("a unit has no encoding")
            cursor[at] -= np.where(t < OUTSIDE, self.length[np.minimum(t, len(self.length) - 1)], 1)
            out_place.append(cursor[at].copy())
            out_id.append(t)
            at = at[cursor[at] > unit_start[at]]
        if len(at):
            best, length, places, ids = last.tolist(), self.length.tolist(), [], []
            for c, o in zip(cursor[at].tolist(), unit_start[at].tolist(), strict=True):
                while c > o:
                    t = best[c]
                    if t < 0:
                        raise ValueError("a unit has no encoding")
                    c -= length[t] if t < OUTSIDE else 1
                    places.append(c)
                    ids.append(t)
            out_place.append(np.array(places, np.int64))
            out_id.append(np.array(ids, np.int64))
        if not out_id:
            return np.zeros(0, np.int64), np.zeros(len(unit_end), np.int64)
        where, ids = np.concatenate(out_place), np.concatenate(out_id)
        order = np.argsort(where)
        where, ids = where[order], ids[order]
        outside = np.flatnonzero(ids >= OUTSIDE)
        many = np.ones(len(ids), np.int64)
        if len(outside):
            code = ids[outside] - OUTSIDE
            many[outside] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        count = np.bincount(np.searchsorted(unit_end, where), many, len(unit_end)).astype(np.int64)
        flat = np.repeat(ids, many)
        if len(outside):
            raw = np.frombuffer("".join(map(chr, code)).encode("utf-8", "surrogatepass"), np.uint8)
            flat[np.repeat(np.isin(np.arange(len(ids)), outside), many)] = self.byte_ids[raw]
        return flat, count

    def forget(self) -> None:
        """Let go of the units and pairs met; what stays is the model."""
        self.pairs.clear()
        self._forget()

    def _forget(self) -> None:
        self.met_key, self.met_begin, self.met_count, self.met_ids = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _met(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each unit stands among those of earlier batches, and whether it does."""
        at = np.minimum(np.searchsorted(self.met_key, key), max(len(self.met_key) - 1, 0))
        return at, (self.met_key[at] == key if len(self.met_key) else np.zeros(len(key), bool))

    def _encode_new(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Append the ids of the units to ``met_ids``; where each begins among the new ones."""
        size = end - start
        closed = np.cumsum(size + 1) - 1
        units = np.full(int(size.sum()) + len(size), CLOSE, np.uint32)
        inside = np.delete(np.arange(len(units)), closed)
        units[inside] = text[np.repeat(start - (closed - size), size) + inside]
        flat, count = self.encode_units(units, closed)
        self.met_ids = np.concatenate([self.met_ids, flat])
        return np.cumsum(count) - count

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each."""
        points = np.frombuffer(t.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
        offs = lead[t.offs]
        filled = np.flatnonzero(np.diff(offs) > 0)
        if not len(filled):
            return np.zeros(0, np.int64), np.zeros(t.n + 1, np.int64)
        text = np.insert(np.where(points == 32, SPACE, points).astype(np.uint32), offs[filled], SPACE)
        heads = offs[filled] + np.arange(len(filled))
        mark = text == SPACE
        starts = mark.copy()
        starts[1:] &= ~mark[:-1]
        starts[heads] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(text))
        key, first, kind = np.unique(SpanHash(text).spans(start, end), return_index=True, return_inverse=True)
        at, met = self._met(key)
        begin, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        begin[met], count[met] = self.met_begin[at[met]], self.met_count[at[met]]
        fresh = np.flatnonzero(~met)
        if len(fresh):
            held = len(self.met_ids)
            begin[fresh] = held + self._encode_new(text, start[first[fresh]], end[first[fresh]])
            count[fresh] = np.diff(np.append(begin[fresh], len(self.met_ids)))
        many = count[kind]
        ids = self.met_ids[np.repeat(begin[kind] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        if len(self.met_ids) < MET_IDS:
            order = np.argsort(both := np.concatenate([self.met_key, key[fresh]]))
            self.met_key, self.met_begin, self.met_count = both[order], np.concatenate([self.met_begin, begin[fresh]])[order], np.concatenate([self.met_count, count[fresh]])[order]
        else:
            self._forget()
        per_text = np.bincount(filled[np.searchsorted(heads, start, "right") - 1], many, t.n).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> Texts:
        """The bytes of each text; the leading space of a text is the model's own and goes."""
        size = self.raw_size[ids]
        at = np.repeat(self.raw_end[ids] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())
        data = self.raw[at]
        ends = np.concatenate([[0], np.cumsum(size)])[offs]
        first = ends[:-1][np.diff(ends) > 0]
        own = first[data[first] == 0x20]
        gone = np.zeros(len(data) + 1, np.int64)
        gone[own + 1] = 1
        return Texts(np.delete(data, own), ends - np.cumsum(gone)[ends])


_CODECS: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """The model's tables, built once in a process."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = Codec.load(model)
    return _CODECS[key]


def read_model(path: str) -> bytes:
    """The model file, which the driver reads; executors get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def default_model() -> str:
    """The merge-order model among the public tokenizer files of the machine."""
    return os.environ.get("CLEAVE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip`` of every row; ``round_trip``: decoding gives the text's bytes back."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model or default_model()))  # a vocabulary file
    bounded_batches(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(shared.value)
        for rows, t in chunks(batches, "_text", BATCH_BYTES):
            ids, offs = tables.encode(t)
            back = tables.decode(ids, offs)
            null = rows.column(1).is_null().to_numpy(zero_copy_only=False)
            same = np.diff(back.offs) == np.diff(t.offs)
            if same.all():
                same &= t.sums(back.data != t.data) == 0
            else:
                same = np.array([x and np.array_equal(back.data[back.offs[i] : back.offs[i + 1]], t.data[t.offs[i] : t.offs[i + 1]]) for i, x in enumerate(same)])
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32), mask=np.append(null, False)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(np.diff(offs), mask=null), pa.array(same, mask=null)], names=schema.names)
        tables.forget()  # the process may go on to tasks of other kinds

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model or default_model()))  # a vocabulary file
    schema = encoded.select("doc_id").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(shared.value)
        for b in batches:
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            lists = b.column(1).fill_null([])
            offs = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            t = tables.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offs)
            raw = t.data.tobytes()
            text = [None if z else raw[x:y].decode("utf-8", "replace") for z, x, y in zip(null, t.offs[:-1], t.offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def op9_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
