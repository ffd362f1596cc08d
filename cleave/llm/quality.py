"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Method.  Every document becomes a short vector of statistics (symbol, case, digit and mark shares, repeated lines and word
windows, lengths, vocabulary), moved to log-odds or logarithms so that class clouds are nearly Gaussian.  For each class Spark sums
counts, vectors and outer products of the labelled training rows; these moments (two classes, a few hundred numbers) reach
the driver, which shrinks each class covariance towards the pooled covariance and its own diagonal and caches the inverse
Cholesky factors.  A score is the logistic of the difference of the two Mahalanobis log-densities, times words / (words + 20) because
few words are little evidence, plus the log prior ratio.

Edge cases.  Null and empty texts have the statistics of an empty text and are scored like any other.  Rows of ``labels``
with a null id or quality, or with no document, train nothing; repeated label rows count as often as they occur, and a document labelled both
ways trains both classes.  With fewer than two rows of a class, every score is the smoothed share of label 1.  :func:`quality_scores` returns no extra
columns, :func:`keep_good` all.  Texts of any length are read whole, a long one with some 150 bytes of arrays a byte.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleave.llm.textbytes import Texts, chunks, mix
from cleave.session import bounded_batches, materialise

U64 = np.uint64
STATS = ("log_words", "log_word_bytes", "symbols", "upper", "digits", "marks", "stops", "wide", "dup_lines", "dup_windows", "vocabulary", "log_line_words", "long_words")


def _classes() -> np.ndarray:
    """A table from byte to class: 1 symbols, 2 upper, 3 digits, 4 other ASCII marks, 5 sentence marks, 6 non-ASCII lead bytes, 7 upper two-byte letters' lead (none)."""
    table = np.zeros(256, np.uint8)
    table[[ord(c) for c in "#*$%&|<>"]] = 1
    table[65:91] = 2
    table[48:58] = 3
    table[[ord(c) for c in "!?\"'()+-/=@[\\]^_`{}~"]] = 4
    table[[ord(c) for c in ".,;:"]] = 5
    table[0xC0:] = 6
    return table


_CLASS = _classes()


def repeats(key: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more (all its places)."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later_repeats(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the key has occurred earlier in the same text (arrays in reading order)."""
    out = np.ones(len(key), bool)
    if len(key):
        with np.errstate(over="ignore"):
            _, first = np.unique(mix(key + mix(text.astype(np.uint64) * U64(2) + U64(1))), return_index=True)
        out[first] = False
    return out


def repeated_words(t: Texts, k: int = 3) -> np.ndarray:
    """Per text, the words inside k-word windows that occur twice or more in that text."""
    start, end, text = t.words()
    n = max(0, len(start) - k + 1)
    if not n:
        return np.zeros(t.n, np.int64)
    w = t.hash.spans(start, end)
    with np.errstate(over="ignore"):
        h = mix(text[:n].astype(np.uint64) * U64(2) + U64(1))
        for i in range(k):
            h = mix(h * U64(0xD1342543DE82EF95) + w[i : n + i])
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    at = at[repeats(h[at])]
    covered = np.zeros(len(start), bool)
    for i in range(k):
        covered[at + i] = True
    return t.per_text(text[covered])


def duplicate_lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the lines with a word that equal an earlier line, and all lines with a word."""
    start, end, text = t.lines()
    words = t.words()[0]
    some = np.searchsorted(words, start) < np.searchsorted(words, end)
    start, end, text = start[some], end[some], text[some]
    later = later_repeats(text, t.hash.spans(start, end))
    return t.per_text(text[later]), t.per_text(text)


def statistics(t: Texts) -> np.ndarray:
    """The texts' vectors, one row a text, in the order of STATS."""
    start, end, text = t.words()
    words = t.per_text(text).astype(float)
    length = end - start
    in_words = t.per_text(text, length.astype(float)) if len(text) else np.zeros(t.n)
    kind = np.bincount(_CLASS[t.data].astype(np.int64) + 8 * np.repeat(np.arange(t.n), np.diff(t.offs)), minlength=8 * t.n).reshape(t.n, 8).astype(float)
    size = kind.sum(1)
    dup, lines = duplicate_lines(t)
    windows = repeated_words(t)
    known = later_repeats(text, t.hash.spans(start, end)) if len(text) else np.zeros(0, bool)
    fresh = words - t.per_text(text[known])
    long = t.per_text(text[length > 20]) if len(text) else np.zeros(t.n)

    def odds(a: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
        return np.log((a + prior) / (np.maximum(n - a, 0) + 1.0))

    return np.column_stack([
        np.log1p(words), np.log1p(in_words / np.maximum(words, 1)), odds(kind[:, 1], size, 0.1), odds(kind[:, 2], size, 0.1),
        odds(kind[:, 3], size, 0.1), odds(kind[:, 4], size, 0.1), odds(kind[:, 5], size, 0.1), odds(kind[:, 6], size, 0.1),
        odds(dup, lines, 0.1), odds(windows, words, 0.1), np.log1p(fresh) - 0.75 * np.log1p(words), np.log1p(words / np.maximum(lines, 1)), odds(long, words, 0.1),
    ])


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``stats array<double>`` of every row, whole texts."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("stats", T.ArrayType(T.DoubleType()))
    names = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in chunks(batches, "_text"):
            x = statistics(t)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names) - 1)), stats], names=names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Prior log ratio, and per class mean, inverse Cholesky factor of the shrunken covariance and its log-determinant."""

    log_prior: float
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    few_words: float = 20.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.mean.size:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_prior)))
        logs = [-0.5 * (((x - m) @ w.T) ** 2).sum(1) - 0.5 * d for m, w, d in zip(self.mean, self.whiten, self.log_det, strict=True)]
        words = np.expm1(x[:, 0])
        weight = words / (words + self.few_words)  # few words are little evidence against the prior
        return 1 / (1 + np.exp(-np.clip(weight * (logs[1] - logs[0]) + self.log_prior, -500, 500)))


def fit(labelled: DataFrame, pooled: float = 0.1, diagonal: float = 0.1, floor: float = 1e-3) -> Discriminant:
    """Fit on rows ``quality`` (0 or 1) and ``stats``: all of them, as sums of moments.

    ``pooled`` and ``diagonal`` are the shares of the pooled covariance and of the own diagonal in each class
    covariance; ``floor`` is added to every variance.
    """
    d = len(STATS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            q = np.asarray(b.column(0).to_numpy(zero_copy_only=False), int)
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
            for c in (0, 1):
                y = x[q == c]
                total[c] += np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        c, i = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(i.ravel()), pa.array(total.ravel())], names=["c", "i", "v"])

    rows = labelled.where(F.col("quality").isin(0, 1)).select("quality", "stats").mapInArrow(moments, "c long, i long, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for c, i, v in rows:
        total[c, i] = v
    n = total[:, 0]
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Discriminant(prior, np.zeros(0), np.zeros(0), np.zeros(0))
    mean = total[:, 1 : 1 + d] / n[:, None]
    cov = np.array([total[c, 1 + d :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    both = np.tensordot(n / n.sum(), cov, 1)
    whiten, log_det = [], []
    for s in cov:
        s = (1 - pooled - diagonal) * s + pooled * both + diagonal * np.diag(np.diag(s)) + floor * np.eye(d)
        chol = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(chol))
        log_det.append(2 * np.log(np.diag(chol)).sum())
    return Discriminant(prior, mean, np.array(whiten), np.array(log_det))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """All columns of ``stats`` but the vector, and ``score``."""
    keep = [c for c in stats.columns if c != "stats"]
    schema = stats.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(len(keep)).flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(model.scores(x))], names=schema.names)

    return stats.select(*keep, "stats").mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for documents that never train: crc32 of the id's text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _training_rows(labels: DataFrame) -> DataFrame:
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    return rows.where(F.col("quality").isin(0, 1) & ~held_out("_id"))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    One pass over the texts: the vectors are written to the shared folder, fitted on and scored from there.
    """
    stats = materialise(with_statistics(documents, ["doc_id"]), "quality-stats")
    model = fit(stats.join(_training_rows(labels), F.col("doc_id") == F.col("_id")))
    out = score(stats, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return quality_scores(read("documents"), read("labels"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is at least ``threshold``, with their own columns."""
    stats = with_statistics(documents.where(~held_out()), ["doc_id"])
    model = fit(stats.join(_training_rows(labels), F.col("doc_id") == F.col("_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in chunks(batches, "text"):
            yield rows.filter(pa.array(model.scores(statistics(t)) >= threshold))

    return documents.mapInArrow(run, documents.schema)
