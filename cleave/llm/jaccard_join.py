"""N-gram Jaccard join: signature trees over groups of documents that can be similar at all.

Method.  A document is its set of distinct k-word shingles (64-bit hashes).  Equal sets are one class.  For a threshold t two
sets of sizes up to r that reach it differ in at most d = 2r(1-t)/(1+t) shingles; so if the shingle space is cut into m > d
parts, at least m - d parts are equal in both.  Parts that are empty prove nothing: a set with e of them shares m - d - e filled
parts with every partner, and where that is less than one it is cut anew by another hash (a pair of which either set is settled at a
level meets there).  Each class emits the hash of every filled part, under the scheme of its size interval and of the next one (no
linked pair spans more), and keeps its rarest ones, all but m - d - e - 1: two partners still meet under one of them, and what very
many texts share is a key only of texts that have little else.  Classes that share a kept hash form coarse clusters: every link
lies inside a cluster.  Inside a cluster the classes stand in a signature tree:
a node holds the OR of its sets' token bitmaps and their size range; a traversal of node pairs drops those whose largest
possible overlap is too small, and those already connected, and checks the rest on the exact sets.

Clusters above ``block`` classes are dealt into blocks and every pair of blocks is a task of its own, so a task never holds more
than two blocks.  Copies count once, hot parts are combined before the shuffle, and components are found by joins.

Edge cases.  An empty table gives an empty result; extra columns are not read.  A very long text is one set of 8 bytes a shingle in its task.
Below 60 % or so most parts of small sets are empty, and such sets meet under the last level's one hash: right, but all are compared.
Null texts and texts without words have no shingles, are linked with nothing and are their own component.  A
text with fewer than k words is its whole sequence as one shingle.  Repeated rows are members of the same class; rows with one id
and several texts are members of several.  Rows with a null doc_id belong to their class, and a class of such rows alone is linked with nothing.  Class keys are 64-bit hashes of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleave.llm.textbytes import Texts, chunks, lower_ascii, mix, to_signed
from cleave.operators.components import connected_components
from cleave.session import bounded_batches, drop, materialise, release

U64 = np.uint64
FANOUT = 8
#: Times that a set with too many empty parts is cut anew by another hash.
LEVELS = 8
#: Bits of the bitmap of repeated part hashes, as a power of two: 4 MB whatever the input; and bits that tell classes apart beside the other
#: 30 of a part hash where repeats are looked for (hashed anew with every part hash, so that no two classes agree in them throughout).
BITMAP_BITS, CLASS_BITS = 25, 34
#: Classes that a task keeps in mind so as to emit each once; more are emitted again, which changes nothing.
SEEN = 1 << 20


def distinct_shingles(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by text and hash, and the offsets of each text."""
    h, at = Texts(lower_ascii(t.data), t.offs).shingles(k)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[fresh], at[fresh]
    return h, np.searchsorted(at, np.arange(t.n + 1))


def sums64(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the multiset of ``h`` in each of ``n`` bins, independent of order."""
    x = mix(h ^ U64(0xA5A5A5A5DEADBEEF))
    low = np.bincount(at, (x & U64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(at, (x >> U64(32)).astype(np.float64), n).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(low + mix(high + U64(0x1234567)))


def _class_keys(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The hash of each whole set."""
    n = np.diff(offs)
    with np.errstate(over="ignore"):
        return mix(sums64(h, np.repeat(np.arange(len(n)), n), len(n)) + n.astype(np.uint64))


class Sizes:
    """Size intervals and, for each, how many differences a pair may have and into how many parts the shingle space is cut.

    An interval ends where the sizes have grown by 1/t twice: sets in the lower half of it have no partner in the next one.
    """

    def __init__(self, percent: int) -> None:
        self.percent, self.low, self.differences = percent, [1], []

    def upto(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last size and number of parts of the intervals up to the one after that of ``most``."""
        while len(self.low) < 3 or self.low[-2] <= most:
            high = self.low[-1] * 10_000 // self.percent**2
            self.differences.append(self.most(2 * high))
            self.low.append(high + 1)
        d = np.array(self.differences)
        return np.array(self.low[:-1]), np.array(self.low[1:]) - 1, np.where(d > 0, d + 2 + d // 4, 0)

    def most(self, together: int) -> int:
        """The most differences of two similar sets that have so many shingles together."""
        return together * (100 - self.percent) // (100 + self.percent)


def part_hashes(h: np.ndarray, offs: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the filled parts of every set under both its schemes: hash, set, scheme and level, and how many of
    that scheme and level any partner shares at least (1 where nothing more is known)."""
    n = np.diff(offs)
    out: list[tuple[np.ndarray, ...]] = []
    if n.max(initial=0):
        low, high, parts = sizes.upto(int(n.max()))
        text = np.repeat(np.arange(len(n)), n)
        for step in (0, 1):
            scheme = np.maximum(np.searchsorted(low, n, "right") - 1, 0) + step
            largest = np.minimum(n * 100 // sizes.percent, high[scheme])  # what a partner in that interval has at most
            differences = sizes.most(n + largest)
            # without differences only equal sets match, which are one class; with the next interval's parts, sets that reach into it
            todo = np.flatnonzero((n > 0) & (parts[scheme] > 0) & (largest >= low[scheme]))
            for level in range(LEVELS):
                p = np.zeros(len(n), np.int64)
                p[todo] = parts[scheme[todo]]
                total = int(p.sum())
                if not total:
                    break
                start = np.cumsum(p) - p
                mine = p[text] > 0
                with np.errstate(over="ignore"):
                    at = start[text[mine]] + ((mix(h[mine] + U64(level * 0x9E3779B9)) >> U64(20)) % p[text[mine]].astype(np.uint64)).astype(np.int64)
                sig, who = sums64(h[mine], at, total), np.repeat(np.arange(len(n)), p)
                filled = np.bincount(at, minlength=total) > 0
                share = p - differences - np.bincount(who[~filled], minlength=len(n))
                key = scheme * 16 + level
                with np.errstate(over="ignore"):
                    place = key[who].astype(np.uint64) * U64(1 << 32) + (np.arange(total) - start[who]).astype(np.uint64)
                    sig = mix(sig + mix(place + U64(77)))[filled]
                who = who[filled]
                out.append((sig, who, key[who], np.maximum(share, 1)[who]))
                todo = todo[share[todo] < 1]
            if len(todo):  # what no level could settle meets under one hash a scheme
                out.append((mix(scheme[todo].astype(np.uint64) + U64(0xE11E << 40)), todo, scheme[todo] * 16 + LEVELS, np.ones(len(todo), np.int64)))
    if not out:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Tree:
    """A signature tree: nodes from leaves of FANOUT sets up to one root."""

    __slots__ = ("bits", "children", "excess", "high", "items", "low", "same")

    def __init__(self, items: list[int], children: list[Tree], bits: int, low: int, high: int, excess: int) -> None:
        self.items, self.children, self.bits, self.low, self.high, self.excess, self.same = items, children, bits, low, high, excess, len(items) < 2


def build(sets: list[np.ndarray], ids: list[int], width: int) -> Tree:
    """The tree of the sets ``ids``, packed in the order of size and smallest hash."""
    nodes = []
    for i in sorted(ids, key=lambda i: (len(sets[i]), int(sets[i][0]))):
        flags = np.zeros(width, np.uint8)
        flags[(sets[i] % U64(width)).astype(np.int64)] = 1
        bits = int.from_bytes(np.packbits(flags).tobytes(), "big")
        nodes.append(Tree([i], [], bits, len(sets[i]), len(sets[i]), len(sets[i]) - bits.bit_count()))
    while len(nodes) > 1:
        above = []
        for lo in range(0, len(nodes), FANOUT):
            group = nodes[lo : lo + FANOUT]
            bits = 0
            for x in group:
                bits |= x.bits
            above.append(Tree([i for x in group for i in x.items], group, bits, min(x.low for x in group), max(x.high for x in group), max(x.excess for x in group)))
        nodes = above
    return nodes[0]


class Linker:
    """Finds links between sets, enough to connect all that any links connect."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.percent, self.parent, self.links, self.checked = sets, percent, list(range(len(sets))), [], 0

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def one(self, node: Tree) -> bool:
        """Whether all sets below are connected; once so, always so."""
        if not node.same:
            root = self.find(node.items[0])
            node.same = all(self.find(i) == root for i in node.items)
        return node.same

    def possible(self, a: Tree, b: Tree) -> bool:
        """Whether sets below ``a`` and ``b`` can reach the threshold: their overlap is at most the common bits and the tokens that share bits."""
        most = min(a.high, b.high)
        need = self.percent * (a.low + b.low)
        if (100 + self.percent) * most < need:
            return False
        most = min(most, (a.bits & b.bits).bit_count() + min(a.excess, b.excess))
        return (100 + self.percent) * most >= need

    def link(self, i: int, j: int) -> None:
        self.checked += 1
        a, b = self.sets[i], self.sets[j]
        common = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * common >= self.percent * (len(a) + len(b) - common):
            self.parent[self.find(i)] = self.find(j)
            self.links.append((i, j))

    def within(self, node: Tree) -> None:
        for x, a in enumerate(node.children):
            self.within(a)
        for x, a in enumerate(node.children):
            for b in node.children[x + 1 :]:
                self.across(a, b)

    def across(self, a: Tree, b: Tree) -> None:
        if not self.possible(a, b) or self.one(a) and self.one(b) and self.find(a.items[0]) == self.find(b.items[0]):
            return
        if not a.children and not b.children:
            self.link(a.items[0], b.items[0])
        elif len(a.items) >= len(b.items) and a.children:
            for x in a.children:
                self.across(x, b)
        else:
            for x in b.children:
                self.across(a, x)


def tree_links(sets: list[np.ndarray], left: list[int], right: list[int], percent: int) -> list[tuple[int, int]]:
    """Links among the sets of ``left`` (no ``right``), or between ``left`` and ``right``."""
    found = Linker(sets, percent)
    width = 256
    while width < 4 * max(map(len, sets)) and width < 1 << 16:
        width *= 2
    if right:
        if left:
            found.across(build(sets, left, width), build(sets, right, width))
    else:
        found.within(build(sets, left, width))
    return found.links


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, cls`` of every row; ``cls`` (null without shingles) is the hash of the whole set."""
    schema = docs.select("doc_id").schema.add("n_shingles", "long").add("cls", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in chunks(batches, "_text"):
            h, offs = distinct_shingles(t, k)
            n, cls = np.diff(offs), _class_keys(h, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(to_signed(cls), mask=n == 0)], names=schema.names)

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, schema)


def _parts(docs: DataFrame, k: int, percent: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """``mark`` of all texts: the part hash but for its last bits, and a hash of it with the class in their place; a task emits equal sets once.

    With a bitmap, ``sig, cls, key, share`` of the part hashes that it may hold.
    """
    shared = None if bitmap is None else docs.sparkSession.sparkContext.broadcast(bitmap)
    tail = U64((1 << CLASS_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, seen = Sizes(percent), set()
        for _, t in chunks(batches, "_text"):
            h, offs = distinct_shingles(t, k)
            n, cls = np.diff(offs), _class_keys(h, offs)
            fresh = np.zeros(t.n, bool)
            if len(seen) > SEEN:
                seen.clear()
            for i, c in enumerate(cls.tolist()):
                if n[i] and c not in seen:
                    seen.add(c)
                    fresh[i] = True
            n_kept = np.where(fresh, n, 0)
            sig, owner, key, share = part_hashes(h[np.repeat(fresh, n)], np.concatenate([[0], np.cumsum(n_kept)]), sizes)
            if shared is None:
                with np.errstate(over="ignore"):
                    mark = np.sort(sig & ~tail | mix(cls[owner] + sig) & tail)
                new = np.ones(len(mark) + 1, bool)
                new[1:-1] = mark[1:] >> U64(CLASS_BITS) != mark[:-1] >> U64(CLASS_BITS)
                cols, names = [mark[new[:-1] | new[1:]]], ["mark"]  # the first and the last class of a hash tell as much as all of them
            else:
                at = sig >> U64(64 - BITMAP_BITS)
                may = (shared.value[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
                owner = owner[may]
                cols, names = [sig[may], cls[owner], key[may].astype(np.int32), share[may].astype(np.int32)], ["sig", "cls", "key", "share"]
            for lo in range(0, len(cols[0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(to_signed(c[lo : lo + (1 << 18)]) if c.dtype == np.uint64 else c[lo : lo + (1 << 18)]) for c in cols], names=names)

    return docs.select(F.col("text").alias("_text")).mapInArrow(run, "mark long" if shared is None else "sig long, cls long, key int, share int")


def _repeated(marks: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the part hashes that two classes or more have: false positives only, so what it lets through stays exact."""
    sig = F.shiftright("mark", CLASS_BITS)
    often = marks.repartition(sig).groupBy(sig.alias("sig")).agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a <> b")
    at = F.shiftrightunsigned("a", 64 - BITMAP_BITS)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(a, {64 - BITMAP_BITS}) & 63 as int))")
    words = often.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # at most 2**(BITMAP_BITS - 6) rows
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    release(marks.sparkSession)
    return bitmap


def candidates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``sig, cls``: part hashes by which every class meets all its partners.

    A class and its partner have ``share`` part hashes of a scheme in common, so the ``share - 1`` of them that most classes have can go: two
    sets that keep all but so many of their rarest hashes still have one in common.  What many texts have in common, such as a passage, is
    no key of a text that has enough of its own.
    """
    # part hashes are made twice: counted alone, then kept with their class only where repeated, which is a few in a hundred
    rows = _parts(docs, k, percent, _repeated(_parts(docs, k, percent))).groupBy("sig", "cls").agg(F.first("key").alias("key"), F.first("share").alias("share"))
    rows = materialise(rows, "jaccard-parts")
    common = rows.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    own = W.partitionBy("cls", "key")
    ranked = rows.join(common, "sig").withColumn("rank", F.row_number().over(own.orderBy("df", "sig"))).withColumn("all", F.count("*").over(own))
    found = materialise(ranked.where("rank <= all - share + 1").select("sig", "cls"), "jaccard-candidates")
    drop(rows)
    return found


def similar_classes(docs: DataFrame, k: int, percent: int, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Classes of all rows (``doc_id, n_shingles, cls``) and links (``a, b``) between classes that connect all similar ones."""
    bounded_batches(docs.sparkSession)
    classes = materialise(_classes(docs, k), "jaccard-classes")
    parts = candidates(docs, k, percent)
    release(docs.sparkSession)
    shared = parts.groupBy("sig").agg(F.min("cls").alias("low"), F.max("cls").alias("top")).where("low <> top").select("sig", "low")
    near = parts.join(shared, "sig").where("cls <> low").select("low", "cls").distinct()
    near = materialise(near.withColumn("least", F.min("low").over(W.partitionBy("cls"))), "jaccard-near")  # at most two rows a part of the class
    drop(parts)
    # one edge from each class to its least partner, and from its other partners to that: as connected, and many classes agree on the latter
    edges = near.select("cls", "least").union(near.where("low <> least").select("low", "least")).distinct()
    clusters = materialise(connected_components(edges, "cls", "least").toDF("cls", "cluster"), "jaccard-clusters")
    drop(near)
    release(docs.sparkSession)

    large = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    first = classes.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    chosen = clusters.join(large, "cluster").join(first, "cls").select(F.col("doc_id").alias("_id"), "cls", "cluster", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("blocks"))
    chosen = chosen.withColumn("mine", F.pmod(F.hash("cls"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    with_text = chosen.join(docs.select("doc_id", F.col("text").alias("_text")), F.col("_id") == F.col("doc_id"))
    dealt = with_text.select("cls", "cluster", "mine", other.alias("other"), "_text").select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "cls", "mine", "_text")
    tasks = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            ids, sets = [], []
            left, right = [], []
            for c, m, s in group:  # rows of one class (repeated rows of a document) stand once
                if ids and ids[-1] == c:
                    continue
                (left if key[1] == key[2] or m == key[1] else right).append(len(ids))
                ids.append(c)
                sets.append(s)
            found = tree_links(sets, left, right, percent) if key[1] == key[2] or right else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["a", "b"])

        key, group = None, []
        for rows, t in chunks(batches, "_text"):
            h, offs = distinct_shingles(t, k)
            own = to_signed(_class_keys(h, offs)).tolist()
            cols = [rows.column(i).to_pylist() for i in range(5)]
            for x, (c, i, j, cls, mine) in enumerate(zip(*cols, strict=True)):
                if own[x] != cls:  # another text under the same doc_id
                    continue
                if (c, i, j) != key:
                    if group:
                        yield done()
                    key, group = (c, i, j), []
                group.append((cls, mine, h[offs[x] : offs[x + 1]].copy()))
        if group:
            yield done()

    links = materialise(tasks.mapInArrow(run, "a long, b long"), "jaccard-links")
    drop(clusters)
    return classes, links


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest doc_id that links of at least ``percent`` reach."""
    classes, links = similar_classes(docs, k, percent)
    labels = connected_components(links, "a", "b").toDF("cls", "label")
    lowest = classes.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low")).join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    whole = lowest.groupBy("label").agg(F.min("low").alias("component_id"))
    by_class = lowest.join(whole, "label").select("cls", "component_id")
    return classes.join(by_class, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The row with the smallest doc_id of each component; rows without shingles all stay, repeated rows of a kept id stay once."""
    found = jaccard_components(docs, k, percent)
    stay = found.where("doc_id = component_id or doc_id is null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("n_shingles") > 0).alias("_some"))
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row")).join(stay, F.col("doc_id").eqNullSafe(F.col("_id")))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.lit(0)))
    return rows.withColumn("rank", rank).where(F.col("doc_id").isNull() | ~F.col("_some") | (F.col("rank") == 1)).select("row.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words
  FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) END AS s
  FROM w
), n AS (SELECT doc_id, len(s) AS n, s FROM g),
e AS (SELECT doc_id, n, unnest(s) AS x FROM n),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  WHERE 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM n
  UNION
  SELECT r.a, l.b FROM r JOIN l ON l.a = r.c
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.c AS component_id
FROM n JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = n.doc_id
"""
