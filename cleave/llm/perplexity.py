"""Quality rules: base counts of words and repeats, and perplexity under a Spark-counted modified Kneser-Ney model.

Method.  Texts are sequences of full code points; the model has every 5-gram of the corpus, as a table that grows with it.
Tasks count the 5-grams of their texts, Spark sums the counts, lower orders count in how many different grams of one more
code point they end, and the modified Kneser-Ney probabilities (three discounts an order) come from joins by context and by
suffix, from order 1 up.  A text is not its own evidence: each gram has the smallest and the largest hash of the texts it is in, and one that
is only in one text (exact copies are one text) counts as unseen there and backs off.  The model is a sorted array of gram hashes with their
log-probabilities.  While a count shows at most ``MODEL_GRAMS`` of them, every task holds the array and finds a text's grams by their hash's
leading bits; texts are read where they lie.  A larger model stays a table: documents are dealt by a hash into chunks of about ``CHUNK`` bytes, a chunk's different grams are
joined with the model, and what comes back, sorted by hash, scores the chunk's texts.  Both ways give the same numbers.  A document's perplexity is
the exponential of its mean negative log-probability a code point; each language has its own lower and upper band, from the quartiles
of the log-perplexities of its documents, and documents outside are rejected.  The quartiles of a language with n documents are drawn towards the
corpus' as by ``least`` documents more, at every n.

Edge cases.  A null or empty text has no words, so the base rules reject it; its perplexity is null.  What lies before a text
counts as code points 0.  A null language is a language of its own.  Repeated rows are counted and returned as often as they occur.  Texts of any
length are read whole, a long one with some 150 bytes of arrays a byte.  Extra columns are not read; ties have no part.  An empty table gives an empty result.  Grams are told apart by 64-bit hashes when texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.llm.quality import duplicate_lines, repeated_words
from cleave.llm.textbytes import SpanHash, Texts, chunks
from cleave.session import bounded_batches, materialise, small

#: Code points of a gram, and of the start that lies before a text.
DEPTH = 5
PAD = DEPTH - 1
#: Bytes of text that are scored together, about.
CHUNK = 8 << 20
#: Bytes of text that are cut into grams at once: about 100 bytes of arrays each.
PART = 1 << 20
#: Different grams that a counting task holds before it hands them on.
HELD = 1 << 20
#: Grams of a model that every task holds: 16 bytes each, and 4 to 8 of an index.
MODEL_GRAMS = 4_000_000
#: The model in memory (:func:`fit`), over grams of ORDER symbols of BITS bits.
ORDER, BITS = 4, 6
SYMBOLS = 1 << BITS

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


Counted = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]


class Grams:
    """The span of the gram that ends at each code point, with its hash and text index."""

    def __init__(self, t: Texts) -> None:
        shift = np.arange(1, t.n + 1) * PAD
        self.data = np.zeros(len(t.data) + t.n * PAD, np.uint8)
        self.data[np.arange(len(t.data)) + np.repeat(shift, np.diff(t.offs))] = t.data
        first = np.flatnonzero((self.data & 0xC0) != 0x80)
        text = np.searchsorted(t.offs + np.arange(t.n + 1) * PAD, first, "right") - 1
        own = np.ones(len(first), bool)
        lead = np.searchsorted(text, np.arange(t.n))
        own[(lead[:, None] + np.arange(PAD)).ravel()] = False
        at = np.flatnonzero(own)
        self.text, self.start, self.end = text[at], first[at - PAD], np.append(first, len(self.data))[at + 1]
        self.hash = SpanHash(self.data).spans(self.start, self.end)
        self.of = (t.hash.spans(t.offs[:-1], t.offs[1:]) >> np.uint64(33)).astype(np.int64)

    def counted(self) -> Counted:
        """Of each different gram: hash, count, least and largest text hash, and string."""
        order = np.argsort(self.hash, kind="stable")
        h = self.hash[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        of = self.of[self.text[order]]
        lo, hi = (f.reduceat(of, at) if len(at) else of for f in (np.minimum, np.maximum))
        start, size = self.start[order[at]], (self.end - self.start)[order[at]]
        offs = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=offs[1:])
        raw = self.data[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])]
        return h[at], np.diff(np.append(at, len(h))), lo, hi, pa.StringArray.from_buffers(len(at), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(raw))


def _merged(parts: list[Counted]) -> Counted:
    if len(parts) == 1:
        return parts[0]
    h, n, lo, hi = (np.concatenate([x[i] for x in parts]) for i in range(4))
    order = np.argsort(h, kind="stable")
    h = h[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    n, lo, hi = (f.reduceat(x[order], at) if len(at) else x for f, x in ((np.add, n), (np.minimum, lo), (np.maximum, hi)))
    return h[at], n, lo, hi, pa.concat_arrays([x[4] for x in parts]).take(pa.array(order[at]))


def count_grams(texts: DataFrame) -> DataFrame:
    """``gram string, h long, n long, lo int, hi int`` over all texts (one string column); h is the gram's hash, lo and hi are the least and the largest hash of the texts with the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for _, t in chunks(batches, "_text", PART):
            held.append(Grams(t).counted())
            if len(held) == 9:
                held = [_merged(held)]
            if len(held[0][0]) >= HELD:
                yield from _rows(_merged(held))
                held = []
        if held:
            yield from _rows(_merged(held))

    def _rows(x: Counted) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_arrays([x[4], pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int64)), *(pa.array(c.astype(np.int32)) for c in x[2:4])], names=["gram", "h", "n", "lo", "hi"])
        yield from (whole.slice(lo, 1 << 17) for lo in range(0, len(whole), 1 << 17))

    return texts.toDF("_text").mapInArrow(run, "gram string, h long, n long, lo int, hi int").groupBy("gram").agg(F.first("h").alias("h"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def train(texts: DataFrame) -> DataFrame:
    """``gram, h, log_p`` of every gram of the texts (one string column)."""
    levels = [materialise(count_grams(texts), "grams")]
    for k in range(DEPTH - 1, 0, -1):  # continuation counts: in how many different grams of one more code point
        levels.insert(0, materialise(levels[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "grams"))
    below, shared = None, F.col("lo") < F.col("hi")
    for k, level in enumerate(levels, 1):
        seen = level.agg(F.count("*"), *(F.count_if(F.col("n") == i) for i in range(1, 5))).first()
        d = discounts(list(seen)[1:])
        taken = F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])
        g = level.select("gram", "n", "lo", "hi", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"), taken.alias("taken"))
        if below is None:
            total, held = g.agg(F.sum("n"), F.sum("taken")).first()
            left = F.lit(float(held or 0)) / max(seen[0], 1)
            below = g.select("gram", ((F.when(shared, F.col("n") - F.col("taken")).otherwise(0.0) + left) / float(total or 1)).alias("p"))
            continue
        context = g.groupBy("context").agg(F.sum("n").alias("total"), F.sum("taken").alias("held"), (F.min("lo") < F.max("hi")).alias("context_shared"))
        under = below.select(F.col("gram").alias("suffix"), F.col("p").alias("p_suffix"))
        left = F.col("held") * F.col("p_suffix")
        p = F.when(shared, (F.col("n") - F.col("taken") + left) / F.col("total")).when(F.col("context_shared"), left / F.col("total")).otherwise(F.col("p_suffix"))
        below = g.join(context, "context").join(under, "suffix").select("gram", p.alias("p"))
    hashes = levels[-1].select("gram", "h")
    return below.join(hashes, "gram").select("gram", "h", F.log(F.greatest("p", F.lit(1e-300))).alias("log_p"))


@dataclass(frozen=True)
class Level:
    """One order: log-probabilities of its seen grams and log back-offs of its contexts, each by sorted hash."""

    gram: np.ndarray
    log_p: np.ndarray
    context: np.ndarray
    log_backoff: np.ndarray


@dataclass(frozen=True)
class KneserNey:
    """The orders from 1 to ORDER."""

    levels: tuple[Level, ...]

    def log_probability(self, key: np.ndarray) -> np.ndarray:
        """By binary search in the sorted arrays; each different key once."""
        keys, back = np.unique(key, return_inverse=True)
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for k in range(len(self.levels), 0, -1):
            level, own = self.levels[k - 1], keys[open_] & (SYMBOLS**k - 1)
            at, seen = _find(level.gram, own)
            if seen.any():
                out[open_[seen]] += level.log_p[at[seen]]
            open_, own = open_[~seen], own[~seen]
            ctx, known = _find(level.context, own >> BITS)
            out[open_[known]] += level.log_backoff[ctx[known]]
        out[open_] -= np.log(SYMBOLS)
        return out[back]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys if len(table) else np.zeros(len(keys), bool))


def _discounts(n: np.ndarray) -> np.ndarray:
    """The three modified Kneser-Ney discounts from the counts of counts; an absolute 0.5 where those are too few."""
    return discounts([np.count_nonzero(n == i) for i in range(1, 5)])


def discounts(c: list[int]) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and more, from how many grams have the counts 1 to 4."""
    if min(c) == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = c[0] / (c[0] + 2 * c[1])
    d = np.array([0.0] + [i + 1 - (i + 2) * y * c[i + 1] / c[i] for i in range(3)])
    return np.clip(d, [0, 0.1, 0.1, 0.1], [0, 1, 2, 3])  # never 0: each context must leave something to back off to


def fit(gram: np.ndarray, n: np.ndarray) -> KneserNey:
    """The model in memory of all counts of symbol grams (``gram`` sorted)."""
    counts = [(gram.astype(np.int64), n.astype(np.int64))]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many different grams of one more symbol
        counts.insert(0, np.unique(counts[0][0] & (SYMBOLS**k - 1), return_counts=True))
    levels: list[Level] = []
    for k, (key, count) in enumerate(counts):
        d = _discounts(count)
        ctx, at = np.unique(key >> BITS, return_inverse=True)
        total = np.maximum(np.bincount(at, count, len(ctx)), 1)
        taken = d[np.minimum(count, 3)]
        gamma = np.bincount(at, taken, len(ctx)) / total
        below = np.exp(levels[-1].log_p[np.searchsorted(levels[-1].gram, key & (SYMBOLS**k - 1))]) if levels else 1 / SYMBOLS
        p = (count - taken) / total[at] + gamma[at] * below
        levels.append(Level(key, np.log(np.maximum(p, 1e-300)), ctx, np.log(np.maximum(gamma, 1e-12))))
    return KneserNey(tuple(levels))


class HashArray:
    """Values by sorted 64-bit hashes, found through an index of the leading bits."""

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        bits = max(1, int(len(key)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.key, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The values of hashes; ValueError for one that isn't there."""
        if not len(h):
            return np.zeros(0)
        at = self.start[h >> self.shift].astype(np.int64)
        last = len(self.key) - 1
        left = np.flatnonzero(self.key[np.minimum(at, last)] < h) if last >= 0 else np.zeros(0, np.int64)
        while len(left):
            at[left] += 1
            left = left[(at[left] <= last) & (self.key[np.minimum(at[left], last)] < h[left])]
        if last < 0 or at.max() > last or (self.key[at] != h).any():
            raise ValueError("a text has grams that the model was not trained on")
        return self.value[at]


def _scored(batches: Iterator[pa.RecordBatch], model: HashArray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Base counts and log-perplexity of rows ``doc_id, lang, _text``."""
    for part, t in chunks(batches, "_text", PART):
        g = Grams(t)
        logs, size = t.per_text(g.text, model.find(g.hash) if len(g.hash) else None), t.per_text(g.text)
        _, _, text = t.words()
        white = (t.data == 0x20) | ((t.data >= 9) & (t.data <= 13))
        cols = [t.per_text(text), t.sums(((t.data & 0xC0) != 0x80) & ~white), t.sums(_IS_SYMBOL[t.data]), duplicate_lines(t)[0], repeated_words(t)]
        ppl = pa.array(-logs / np.maximum(size, 1), mask=size == 0)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c.astype(np.int64)) for c in cols), ppl], names=names)


def with_counts_and_perplexity(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``doc_id, lang`` and the base counts of every document, with ``log_ppl`` (null for no code points); ``model`` as of :func:`train` on these texts."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = docs.select("doc_id", "lang").schema
    for c in names:
        schema = schema.add(c, "long")
    schema = schema.add("log_ppl", "double")
    text = F.col("text").alias("_text")
    model = materialise(model.select("gram", "h", "log_p"), "perplexity-model")
    if model.count() <= MODEL_GRAMS:
        held = model.select("h", "log_p").toArrow()  # at most MODEL_GRAMS rows
        shared = docs.sparkSession.sparkContext.broadcast(HashArray(held["h"].to_numpy().view(np.uint64), held["log_p"].to_numpy()))
        return docs.select("doc_id", "lang", text).mapInArrow(lambda batches: _scored(batches, shared.value, schema.names), schema)

    def wanted(key: tuple, rows: pa.Table) -> pa.Table:
        found: list = []
        for _, t in chunks(iter(rows.combine_chunks().to_batches()), "_text", PART):
            found.append(Grams(t).counted())
            if len(found) == 9:
                found = [_merged(found)]
        h = _merged(found)[0]
        return pa.table({"_chunk": pa.array(np.full(len(h), key[0].as_py())), "h": pa.array(h.view(np.int64))})

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        table = HashArray(known["h"].to_numpy().view(np.uint64), known["log_p"].to_numpy())
        return pa.Table.from_batches(_scored(iter(rows.select(["doc_id", "lang", "_text"]).combine_chunks().to_batches()), table, schema.names))

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-size // CHUNK) or 1)).alias("_chunk")
    dealt = docs.select(key, "doc_id", "lang", text)
    asked = dealt.groupBy("_chunk").applyInArrow(wanted, "_chunk long, h long")
    known = asked.join(model, "h").select("_chunk", "h", "log_p")
    return dealt.groupBy("_chunk").cogroup(known.groupBy("_chunk")).applyInArrow(score, schema)


def bands(scored: DataFrame, below: float, above: float, least: int) -> DataFrame:
    """``lang, low, high``: the quartiles of the log-perplexity of the language's documents that pass the base rules, drawn towards the corpus' as by ``least`` documents, moved out by multiples of the quartile range."""
    q = F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.75)), 10_000)
    ok = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull())
    edges = lambda c: (F.element_at(c, 1) - below * (F.element_at(c, 2) - F.element_at(c, 1)), F.element_at(c, 2) + above * (F.element_at(c, 2) - F.element_at(c, 1)))
    whole = ok.agg(q.alias("all"))
    by = ok.groupBy("lang").agg(q.alias("own"), F.count("*").alias("n")).crossJoin(F.broadcast(whole))  # one row
    low, high = edges(F.zip_with("own", "all", lambda x, y: (x * F.col("n") + y * least) / (F.col("n") + least)))
    return by.select(F.col("lang").alias("_lang"), low.alias("low"), high.alias("high"))


def quality_rules(docs: DataFrame, below: float = 2.5, above: float = 2.5, least: int = 50) -> DataFrame:
    """Base counts, ``base_failed``, ``perplexity``, the language's band and the verdict ``kept`` of every document."""
    bounded_batches(docs.sparkSession)
    model = train(docs.select("text"))
    counted = materialise(with_counts_and_perplexity(docs, model), "perplexity")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = counted.withColumn("base_failed", failed)
    limits = small(bands(scored, below, above, least), 10_000)
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
        F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"),
    )


def op3_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
