"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Method.  Numbers, units after numbers and capitalised words inside sentences become typed placeholders that keep their value; all
other words are lower-cased without punctuation.  Windows of ``width`` template tokens are hashed and joined with the hashed windows of the
benchmark items, which are broadcast only while a count shows at most ``most`` of them.  Hits of a document and an item on one
diagonal (same distance between places) should map each slot value of the item to one value of the document.  Where a value
is mapped to two, the changed windows that hold it are left out; windows without slots, with unchanged values or with
other values count all the same.  A document is contaminated by an item when the windows that count cover ``share`` of its
windows, or when those of one diagonal cover ``run`` tokens in a row.  Where mapped values differ, the question is
re-parameterised.

Edge cases.  Null and empty texts have no tokens and match nothing, and items without tokens are left out.  An item with fewer than ``width`` tokens
is one window of its own length, and documents are cut into windows of that length too; one with fewer than FEW matches only documents of
as many tokens.  A window of placeholders alone matches the same values only.  Repeated rows of an id
count their hits once; equal items are found each.  Texts of any length are cut whole, as one array of tokens.  Empty tables give an empty result.  Extra columns are not read by :func:`contamination`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "\x01"
#: Items with fewer tokens match only documents that have no others.
FEW = 3
#: Hashes of the placeholders' types (E: no unit); all other tokens hash above them.
TYPES = {kind: -(1 << 63) + i for i, kind in enumerate("NUAE")}
#: Units that are slots after a number.
UNITS = "km|cm|mm|m|kg|mg|g|lbs?|oz|ft|in|mi|miles?|meters?|metres?|l|ml|liters?|litres?|hours?|hrs?|h|minutes?|min|seconds?|secs?|s|days?|weeks?|months?|years?|percent|usd|eur|dollars?|euros?|cents?|mph|kmh|kg|%|°[CF]"


def template_tokens(text: Column) -> Column:
    """The words of a text in order; typed placeholders are MARK, N (number), U (unit, empty after a number without one) or A (name), and the value."""
    number = rf"(?<![\p{{L}}\p{{N}}])([0-9]+(?:[.,:/][0-9]+)*)(?:[ \t]?({UNITS})(?![\p{{L}}\p{{N}}]))?"
    marked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, number, f" {MARK}N$1 {MARK}U$2 ")).otherwise(text)
    named = F.regexp_replace(marked, r"(?<=[\p{L}\p{N},;][ \t\n])(\p{Lu}[\p{Ll}'-]+)(?![\p{L}])", f"{MARK}A$1")
    return F.regexp_extract_all(named, F.lit(rf"{MARK}[NUA][^\s{MARK}]*|[\p{{L}}\p{{N}}]+"), 0)


def _windows(tokens: Column, lengths: list[int]) -> tuple[Column, Column, Column]:
    """Token hashes, whether there are placeholders, and ``pos, hash, slots`` of every window; ``slots`` are the window's tokens where the text has placeholders."""
    last = max(TYPES.values())
    kinds = lambda x: F.when(F.substring(x, 2, 1) == "N", TYPES["N"]).when(x == f"{MARK}U", TYPES["E"]).when(F.substring(x, 2, 1) == "U", TYPES["U"]).otherwise(TYPES["A"]).cast("long")
    shapes = F.transform(tokens, lambda x: F.when(x.startswith(MARK), kinds(x)).otherwise(F.greatest(F.xxhash64(F.lower(x)), F.lit(last + 1))))
    some = F.exists(tokens, lambda x: x.startswith(MARK))

    def cut(n: int) -> Column:
        fits = F.size(tokens) >= n if n >= FEW else F.size(tokens) == n
        starts = F.when(fits, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))

        def hashed(i: Column) -> Column:
            bare = F.col("_some")
            for k in range(n):
                bare = bare & (F.get("_shapes", i + k) <= last)
            # no word in it: such a window stands for its values, else every table of numbers would match every other
            return F.when(bare, F.xxhash64(F.lit(-n), F.slice("_tokens", i + 1, n))).otherwise(F.xxhash64(F.lit(n), *(F.get("_shapes", i + k) for k in range(n))))

        return F.transform(starts, lambda i: F.struct(i.alias("pos"), hashed(i).alias("hash"), F.when(F.col("_some"), F.slice("_tokens", i + 1, n)).alias("slots")))

    parts = [cut(n) for n in lengths]
    return shapes, some, F.concat(*parts) if len(parts) > 1 else parts[0]


def windows(rows: DataFrame, ids: list[str], text: str, lengths: list[int]) -> DataFrame:
    """One row a window, with the columns ``ids``."""
    base = rows.select(*ids, template_tokens(F.col(text)).alias("_tokens"))
    shapes, some, cut = _windows(F.col("_tokens"), lengths)
    return base.withColumn("_shapes", shapes).withColumn("_some", some).select(*ids, F.explode(cut).alias("w")).select(*ids, "w.pos", "w.hash", "w.slots")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 8, share: float = 0.4, most: int = 1_000_000, run: int = 13) -> DataFrame:
    """``doc_id, item_id, matched_windows, item_windows, reparameterised`` of every contaminated pair."""
    items = benchmark.select("item_id", F.col("text").alias("_text"))
    sizes = items.select("item_id", "_text", F.size(template_tokens(F.col("_text"))).alias("n")).where("n > 0")
    short = sorted(r[0] for r in sizes.where(F.col("n") < width).select("n").distinct().collect())
    of_item = windows(sizes.where(F.col("n") >= width), ["item_id"], "_text", [width])
    for n in short:
        of_item = of_item.union(windows(sizes.where(F.col("n") == n), ["item_id"], "_text", [n]))
    total = sizes.groupBy("item_id").agg(F.max(F.greatest(F.col("n") - F.lit(width - 1), F.lit(1))).cast("long").alias("item_windows"))
    of_item = of_item.select("item_id", F.col("pos").alias("ipos"), "hash", F.col("slots").alias("islots"))
    side = F.broadcast(of_item) if of_item.limit(most + 1).count() <= most else of_item

    hits = windows(docs.select("doc_id", F.col("text").alias("_text")), ["doc_id"], "_text", [width, *short]).join(side, "hash")
    pairs = F.filter(F.arrays_zip(F.col("islots").alias("a"), F.col("slots").alias("b")), lambda p: p["a"].startswith(MARK))
    hits = hits.select("doc_id", "item_id", "ipos", (F.col("pos") - F.col("ipos")).alias("diagonal"), F.coalesce(F.when(F.col("islots").isNotNull(), pairs), F.array().cast("array<struct<a:string,b:string>>")).alias("pairs"))
    lines = hits.groupBy("doc_id", "item_id", "diagonal").agg(F.collect_set(F.struct("ipos", "pairs")).alias("hits"))  # at most an item's windows
    lines = lines.withColumn("map", F.array_distinct(F.flatten(F.transform("hits", lambda h: h["pairs"]))))
    torn = F.filter("map", lambda p: F.exists("map", lambda q: (q["a"] == p["a"]) & (q["b"] != p["b"])))
    consistent = F.size("map") == F.size(F.array_distinct(F.transform("map", lambda p: p["a"])))
    lines = lines.withColumn("torn", F.when(consistent, F.array().cast("array<string>")).otherwise(F.transform(torn, lambda p: p["a"])))
    differs = lambda h: F.exists(h["pairs"], lambda p: p["a"] != p["b"])
    holds = lambda h: ~differs(h) | ~F.exists(h["pairs"], lambda p: F.array_contains("torn", p["a"]))
    lines = lines.withColumn("hits", F.when(F.size("torn") == 0, F.col("hits")).otherwise(F.filter("hits", holds))).where(F.size("hits") > 0)
    lines = lines.select("doc_id", "item_id", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["ipos"]))).alias("places"), F.exists("hits", differs).alias("changed"))
    more = max(run - width, 0)  # an item with fewer windows reaches the share before
    starts = F.when(F.size("places") > more, F.sequence(F.lit(0), F.size("places") - 1 - more)).otherwise(F.array().cast("array<int>"))
    lines = lines.withColumn("passage", F.exists(starts, lambda i: F.get("places", i + more) - F.get("places", i) == more))
    found = lines.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("matched_windows"), F.max("changed").alias("reparameterised"), F.max("passage").alias("passage"))
    out = found.join(total, "item_id").where((F.col("matched_windows") >= F.col("item_windows") * share) | F.col("passage"))
    return out.select("doc_id", "item_id", "matched_windows", "item_windows", "reparameterised")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; rows with one id, or with none, go together."""
    name = "_leaked"
    while name in docs.columns:
        name = f"_{name}"
    found = contamination(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
