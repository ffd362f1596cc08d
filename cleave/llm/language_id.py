"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors.

Method.  Letter trigrams (three code points of lower-cased letters, in hashed bins) of all ``documents`` with a known language are
summed by language into a multinomial text model.  Every page gets a log-likelihood for each language from its visible text,
tempered because neighbouring trigrams depend on each other.  From text alone the pages' posteriors are summed by host, by registered name, by address suffix
and in total; each level is smoothed by the one above (``strength`` pseudo-pages), which gives a hierarchical prior for each host.
How often a declared language is right is estimated from the same posteriors as a smoothed confusion table.
The final posterior of a page is prior x declaration x text; the page's own posterior is taken out of the sums that its prior and its
declaration are weighed by, so no text counts twice.

A host with a third of all pages is summed before the shuffle, and its prior joins its pages by a join that Spark may split.

Edge cases.  Every page row gives one row.  A null html or a page without letters has no text evidence; a null or odd address has the total
prior; ports, user names and a closing dot are no part of a host; numeric addresses and single labels are registered names of their own; an undeclared
language is no evidence.  Repeated rows are identified each, and are evidence for each other.  Ties go to the language that sorts first.  Empty ``pages`` give an
empty result; no labelled documents at all: a column ``lang`` of nulls.  Texts of any length are read whole; extra columns are not read.
More than MOST_LANGUAGES languages are refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleave.llm.textbytes import Texts, chunks, mix
from cleave.session import bounded_batches, materialise

#: Hashed trigram bins, and the most languages that the text model holds: together they bound what is broadcast.
BINS, MOST_LANGUAGES = 1 << 15, 256
#: Second-level labels under which countries register names.
SECOND_LEVEL = "ac|co|com|edu|gob|gov|gouv|ne|net|nom|or|org"
NUMERIC = r"^(?:[0-9.]+|\[.*)$"


def bins(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bin and text index of every three code points with at least two letters in a row; texts don't run together."""
    lead = np.flatnonzero((t.data & 0xC0) != 0x80)
    if len(lead) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(np.append(lead, len(t.data)))
    low = t.data[lead].astype(np.uint64)
    low = np.where((low >= 65) & (low <= 90), low + 32, low).astype(np.uint64)
    second = np.where(size > 1, t.data[np.minimum(lead + 1, len(t.data) - 1)], 0).astype(np.uint64)
    code = low | second << np.uint64(8)
    letter = ((low >= 97) & (low <= 122)) | (low >= 0xC3)
    code = np.where(letter, code, 0x20).astype(np.uint64)
    text = np.searchsorted(t.offs, lead, "right") - 1
    ok = (text[:-2] == text[2:]) & (letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2)
    key = code[:-2] | code[1:-1] << np.uint64(16) | code[2:] << np.uint64(32)
    return (mix(key[ok]) % np.uint64(BINS)).astype(np.int64), text[:-2][ok]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (language x bin) from all rows with ``lang`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for rows, t in chunks(batches, "_text"):
            b, at = bins(t)
            lang = rows.column(0).to_numpy(zero_copy_only=False)
            for name in set(lang):
                mine = (lang == name)[at]
                total.setdefault(name, np.zeros(BINS, np.int64))
                total[name] += np.bincount(b[mine], minlength=BINS)
        for name, n in total.items():
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(n[found])], names=["lang", "bin", "n"])

    known = docs.where("lang is not null and text is not null").select("lang", F.col("text").alias("_text"))
    names = [r[0] for r in known.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.full((len(names), BINS), 0.5)
    place = {n: i for i, n in enumerate(names)}
    rows = known.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most languages x bins
    for name, b, n in zip(rows["lang"], rows["bin"], rows["n"], strict=True):
        counts[place[name], b] += n
    return names, np.log(counts / counts.sum(1, keepdims=True)) if names else counts


def visible(html: Column) -> Column:
    """The text of a page without scripts, styles, comments, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")


def host_of(url: Column) -> Column:
    """The lower-case host without port and closing dot; null where the address has none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def site_of(host: Column) -> Column:
    """The registered name: the last two labels, three below a second-level suffix such as co.uk; numeric addresses and single labels whole."""
    last = F.regexp_extract(host, rf"([^.]+\.(?:(?:{SECOND_LEVEL})\.[a-z]{{2}}|[^.]+))$", 1)
    return F.when(host.rlike(NUMERIC), host).otherwise(F.coalesce(F.nullif(last, F.lit("")), host))


def suffix_of(host: Column) -> Column:
    """The last label; empty for a numeric address."""
    return F.when(host.rlike(NUMERIC), F.lit("")).otherwise(F.regexp_extract(host, r"([^.]+)$", 1))


def text_scores(pages: DataFrame, names: list[str], log_p: np.ndarray, temper: float = 0.2) -> DataFrame:
    """``page_id, host, declared, n_grams, loglik array`` of every page; html isn't kept."""
    shared = pages.sparkSession.sparkContext.broadcast((log_p.T.copy(), len(names)))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    cols = ["page_id", "host", "declared"]
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), F.nullif(declared, F.lit("")).alias("declared"), visible(F.col("html")).alias("_text"))
    schema = rows.select(*cols).schema.add("n_grams", "long").add("loglik", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, k = shared.value
        for rows, t in chunks(batches, "_text"):
            b, at = bins(t)
            n = np.bincount(at, minlength=t.n)
            logs = np.stack([np.bincount(at, table[b, i], t.n) for i in range(k)], 1) * temper if k else np.zeros((t.n, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1, dtype=np.int32) * k), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(cols))), pa.array(n), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def _posterior(logs: Column) -> Column:
    """The array of logs as probabilities."""
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame, strength: float = 10.0) -> DataFrame:
    """``page_id, host, declared, lang, probability, text_lang, n_grams`` of every page."""
    bounded_batches(pages.sparkSession)
    names, log_p = train(docs)
    if not names:
        return pages.select("page_id", host_of(F.col("url")).alias("host"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(0).cast("long").alias("n_grams"))
    k = len(names)
    zero = F.array_repeat(F.lit(0.0), k)
    scored = materialise(text_scores(pages, names, log_p), "language-text").withColumn("p", _posterior(F.col("loglik")))
    scored = scored.withColumn("own", F.when(F.col("n_grams") > 0, F.col("p")).otherwise(zero))  # what the page itself adds to every sum
    sums = lambda rows, col, by: rows.groupBy(*by).agg(F.array(*(F.sum(F.col(col)[i]) for i in range(k))).alias("n"))

    def smooth(n: Column, above: Column) -> Column:
        """The shares of the counts ``n`` without the page's own, with ``strength`` pages of what lies above."""
        rest = F.zip_with(n, F.col("own"), lambda x, o: F.greatest(x - o, F.lit(0.0)))
        total = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(rest, above, lambda x, q: (x + strength * q) / (total + strength))

    # each level is summed from the one below: site and suffix follow from the host
    hosts = materialise(sums(scored.where("host is not null"), "own", ["host"]), "language-hosts").select("host", site_of(F.col("host")).alias("site"), "n")
    sites = sums(hosts, "n", ["site"]).select("site", suffix_of(F.col("site")).alias("suffix"), F.col("n").alias("n_site"))
    suffixes = sums(sites, "n_site", ["suffix"]).withColumnRenamed("n", "n_suffix")
    tree = hosts.join(sites, "site").join(suffixes, "suffix").select(F.col("host").alias("_host"), "n", "n_site", "n_suffix")

    # P(declared | language), smoothed towards how common the declaration is
    said = sums(scored.where("declared is not null"), "own", ["declared"])
    sizes = said.agg(F.array(*(F.sum(F.col("n")[i]) for i in range(k))).alias("n")).first()[0]  # one row of k numbers
    sizes = [float(x or 0.0) for x in sizes or [0.0] * k]
    share = F.aggregate("n_said", F.lit(0.0), lambda a, b: a + b) / F.lit(max(sum(sizes), 1.0))
    left = F.zip_with(F.array(*(F.lit(x) for x in sizes)), "own", lambda t, o: F.greatest(t - o, F.lit(0.0)))
    hits = F.zip_with("n_said", "own", lambda x, o: F.greatest(x - o, F.lit(0.0)))
    says = F.zip_with(hits, left, lambda x, t: F.log((x + strength * share + 1e-9) / (t + strength)))
    said = said.select(F.col("declared").alias("_declared"), F.col("n").alias("n_said"))

    whole = scored.agg(F.array(*(F.sum(F.col("own")[i]) for i in range(k))).alias("n")).first()[0]  # one row of k numbers
    total = F.array(*(F.lit(float(x or 0.0)) for x in whole or [0.0] * k))
    out = scored.join(tree, F.col("host") == F.col("_host"), "left").join(said, F.col("declared") == F.col("_declared"), "left")
    for name, n, above in (("q0", total, F.array_repeat(F.lit(1.0 / k), k)), ("q1", F.coalesce("n_suffix", "own"), F.col("q0")), ("q2", F.coalesce("n_site", "own"), F.col("q1")), ("prior", F.coalesce("n", "own"), F.col("q2"))):
        out = out.withColumn(name, smooth(n, above))
    logs = F.zip_with(F.zip_with(F.col("loglik"), F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b), F.when(F.col("n_said").isNull(), zero).otherwise(says), lambda a, b: a + b)
    final = out.withColumn("q", _posterior(logs))
    label = lambda c: F.array(*map(F.lit, names))[(F.array_position(c, F.array_max(c)) - 1).cast("int")]
    return final.select("page_id", "host", "declared", label(F.col("q")).alias("lang"), F.array_max("q").alias("probability"), F.when(F.col("n_grams") > 0, label(F.col("p"))).alias("text_lang"), "n_grams")


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
