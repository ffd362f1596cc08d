"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns; brute force where SQL can't say it."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cleave.llm import decontaminate, jaccard_join, language_id, licences, perplexity, quality, repeats, sentencepiece_codec, sharding, warc

WORD = r"[^\x20\x09-\x0D]+"
rng = np.random.default_rng(5)
VOCABULARY = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, 5)) for _ in range(300)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(VOCABULARY[i] for i in r.integers(0, len(VOCABULARY), n)) + "."


BASE = prose(120, 1)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace(VOCABULARY[3], "zzz")), (4, None), (5, ""), (6, "one two"), (7, "one two"), (8, "  \n\t "),
    (9, prose(60, 2) + "\n" + BASE[100:420]), (10, "É" * 300 + "日本 " * 40), (11, prose(4000, 3)), (12, "### $$$ %%% | < > & * " * 30), (None, prose(70, 4)),
    (13, "a b c " * 60), (14, "Released under the MIT License.\nx y z\nRELEASED under  the MIT license"), (11, prose(4000, 3)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, id long, _text string, _leaked long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i != 10 else None, "s", len(t or ""), "x", 1.0, 7, "y", 8) for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, empty):
    out = sharding.shard_documents(docs, shards=3).collect()
    assert len(out) == len(TEXTS)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = dict(TEXTS)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in out)
    home = {r["doc_id"]: r["shard"] for r in out}
    assert home[1] == home[2] and home[6] == home[7]
    assert sharding.shard_documents(empty, shards=3).count() == 0


def test_quotas_never_overfill():
    r = np.random.default_rng(1)
    for _ in range(200):
        asked, room = r.integers(0, 20, (5, 5)), r.integers(0, 10, 5)
        np.fill_diagonal(asked, 0)
        got = sharding.quotas(asked, room)
        assert (got <= asked).all() and (got.sum(0) - got.sum(1) <= room).all()


def base_counts(t):
    w = re.findall(WORD, t or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(tri)
    inside = {i + k for i, x in enumerate(tri) if c[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(inside)


def test_perplexity_rules(docs, empty):
    out = perplexity.quality_rules(docs, least=1).collect()
    assert len(out) == len(TEXTS)
    text = dict(TEXTS)
    for r in out:
        got = base_counts(text[r["doc_id"]])
        assert tuple(r)[1:6] == got
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r["base_failed"] and r["kept"])
    assert perplexity.quality_rules(empty).count() == 0


def test_kneser_ney_sums_to_one():
    gram, n = np.unique(np.random.default_rng(2).integers(0, 1 << 24, 3000) & 0x0C30C3, return_counts=True)
    model = perplexity.fit(gram, n)
    context = int(gram[0]) >> 6
    p = np.exp(model.log_probability(np.array([context << 6 | s for s in range(64)])))
    assert abs(p.sum() - 1) < 1e-9
    model.log_probability(np.arange(0, 1 << 24, 4097))


def brute_force_log_p(texts, depth):
    """Modified Kneser-Ney over code points, by dictionaries; grams of only one text (copies are one) back off."""
    where = collections.defaultdict(set)
    for t in filter(None, texts):
        p = "\0" * (depth - 1) + t
        for i in range(len(t)):
            for k in range(1, depth + 1):
                where[p[i + depth - k : i + depth]].add(t)
    counts = [collections.Counter(p[i : i + depth] for t in texts if t for p in ["\0" * (depth - 1) + t] for i in range(len(t)))]
    for _ in range(depth - 1):
        counts.insert(0, collections.Counter(g[1:] for g in counts[0]))
    below = dict.fromkeys([""], 1 / len(counts[0]))
    for count in counts:
        d = perplexity.discounts([sum(n == i for n in count.values()) for i in range(1, 5)])
        total, held = collections.Counter(), collections.Counter()
        for g, n in count.items():
            total[g[:-1]] += n
            held[g[:-1]] += d[min(n, 3)]
        about = collections.defaultdict(set)
        for g in count:
            about[g[:-1]] |= where[g]
        left = {g: held[g[:-1]] * below[g[1:]] / total[g[:-1]] for g in count}
        below = {g: left[g] + (n - d[min(n, 3)]) / total[g[:-1]] if len(where[g]) > 1 else left[g] if len(about[g[:-1]]) > 1 or len(g) == 1 else below[g[1:]] for g, n in count.items()}
    return {g: np.log(p) for g, p in below.items()}


@pytest.mark.parametrize("held", [perplexity.MODEL_GRAMS, 10])
def test_perplexity_model(docs, monkeypatch, held):
    monkeypatch.setattr(perplexity, "CHUNK", 5000)
    monkeypatch.setattr(perplexity, "MODEL_GRAMS", held)
    model = brute_force_log_p([t for _, t in TEXTS], perplexity.DEPTH)
    got = {r["gram"]: r["log_p"] for r in perplexity.train(docs.select("text")).collect()}
    assert got.keys() == model.keys() and all(abs(got[g] - x) < 1e-9 for g, x in model.items())
    text = dict(TEXTS)
    for r in perplexity.quality_rules(docs, least=1).collect():
        p = "\0" * (perplexity.DEPTH - 1) + (text[r["doc_id"]] or "")
        logs = [model[p[i : i + perplexity.DEPTH]] for i in range(len(text[r["doc_id"]] or ""))]
        assert abs(r["perplexity"] - np.exp(-np.mean(logs))) < 1e-9 * r["perplexity"] if logs else r["perplexity"] is None


@pytest.mark.parametrize("least", [1, 50])
def test_perplexity_bands_and_verdict(spark, least):
    """The verdict from the perplexities that the operator gives, by plain loops over languages."""
    rows = [(i, prose(60 + i, i) if i % 3 else VOCABULARY[i] + " " + "qzx " * 3 + " ".join(chr(0x4E00 + (i * 97 + j * 31) % 5000) for j in range(60)), ["en", "de", None][i % 4 % 3]) for i in range(60)]
    out = perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), least=least).collect()
    lang = {i: x for i, _, x in rows}
    logs = {r["doc_id"]: np.log(r["perplexity"]) for r in out if not r["base_failed"]}

    def quartiles(x):  # the value at place ceil(q * n) of the ascending order
        x = sorted(x)
        return np.array([x[max(int(np.ceil(q * len(x))) - 1, 0)] for q in (0.25, 0.75)])

    whole = quartiles(logs.values())
    for r in out:
        own = [x for i, x in logs.items() if lang[i] == lang[r["doc_id"]]]
        q = (quartiles(own) * len(own) + whole * least) / (len(own) + least)
        low, high = q[0] - 2.5 * (q[1] - q[0]), q[1] + 2.5 * (q[1] - q[0])
        assert abs(np.log(r["low"]) - low) < 1e-9 and abs(np.log(r["high"]) - high) < 1e-9
        assert r["kept"] == (not r["base_failed"] and low <= logs[r["doc_id"]] <= high)


def test_perplexity_tells_capitals_and_letters_apart(spark):
    same = [(i, "AAAA" * (80 + i) + " 1111" * 20 + " дддд" * 20) for i in range(5)]
    mixed = [(9, "".join(chr(65 + int(x)) for x in rng.integers(0, 26, 320)) + " " + "".join(chr(0x430 + int(x)) for x in rng.integers(0, 32, 200)))]
    table = spark.createDataFrame([(i, t, "en") for i, t in same + mixed], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["perplexity"] for r in perplexity.quality_rules(table).collect()}
    assert out[9] > 1.5 * out[0]


def test_quality(spark, docs, empty):
    good = [(100 + i, prose(80 + i, i)) for i in range(40)]
    bad = [(200 + i, "### " + prose(60 + i, i).replace(" ", " $$$ ")) for i in range(40)]
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, "en") for i, t in good + bad], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality_scores(table, labels).collect()}
    assert all(out[i]["predicted"] == 1 for i, _ in good) and all(out[i]["predicted"] == 0 for i, _ in bad)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items() if i is not None)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, k):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def expected_components(texts, k, percent):
    sets = [(i, shingles(t, k)) for i, t in texts]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = label[a], label[b]
                label = [new if z == old else z for z in label]
    low = {}
    for (i, _), z in zip(sets, label, strict=True):
        if i is not None:
            low[z] = min(low.get(z, i), i)
    return collections.Counter((i, len(s), low.get(z, i) if s else i) for (i, s), z in zip(sets, label, strict=True))


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 1000), (5, 80, 4), (2, 50, 3)])
def test_jaccard_components(spark, docs, k, percent, block, monkeypatch):
    r = np.random.default_rng(7)
    texts = list(TEXTS)
    for i in range(30):
        w = prose(int(r.integers(20, 60)), int(r.integers(0, 3))).split()
        for _ in range(int(r.integers(0, 3))):
            w[int(r.integers(0, len(w)))] = "changed" + str(r.integers(0, 9))
        texts.append((50 + i, " ".join(w)))
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    real = jaccard_join.similar_classes
    monkeypatch.setattr(jaccard_join, "similar_classes", lambda d, k, p: real(d, k, p, block))
    got = collections.Counter(map(tuple, jaccard_join.jaccard_components(table, k, percent).collect()))
    assert got == expected_components(texts, k, percent)


def test_one_of_each(docs, empty):
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14]
    assert jaccard_join.one_of_each(empty).count() == 0


def without(texts, width):
    """Brute force over (doc_id, text hash, start); a null id is the smallest; equal rows are one document."""
    import xxhash

    own = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t, seed=42)).view(np.int64))
    seen, gone = set(), {}
    for i, _, t in sorted({(-(1 << 63) if i is None else i, own((t or "").encode()), t or "") for i, t in texts}):
        b = t.encode()
        gone[i, t] = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if b[p : p + width] in seen:
                gone[i, t][p : p + width] = True
            seen.add(b[p : p + width])
    return gone


SHARED = [(20, prose(90, 30)), (27, prose(90, 30)), (27, prose(95, 31)), (None, prose(80, 32)), (None, prose(80, 32) + prose(80, 33)), (27, None), (28, None), (27, "")]
PASSAGE = prose(40, 34)
BETWEEN = [(40 + i, prose(5, 50 + i % 3) + PASSAGE + prose(6, 70 + i // 2) + ("ab" * 200 if i == 5 else "")) for i in range(12)]


@pytest.mark.parametrize(("merge_bytes", "hot"), [(2 << 20, 2048), (500, 2048), (500, 3)])
def test_repeats(spark, docs, empty, merge_bytes, hot, monkeypatch):
    monkeypatch.setattr(repeats, "MERGE_BYTES", merge_bytes)
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = TEXTS + SHARED + BETWEEN
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], "doc_id long, text string, id string, own int, lo int").repartition(3)
    gone = without(texts, 100)
    want = collections.Counter()
    for i, t in texts:
        g, b = gone[-(1 << 63) if i is None else i, t or ""], np.frombuffer((t or "").encode(), np.uint8)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], g.astype(int)])) == 1))
        want[i, len(b), int(g.sum()), spans, hashlib.sha256(b[~g].tobytes()).hexdigest()] += 1
    assert collections.Counter(map(tuple, repeats.removed(table).collect())) == want
    cleaned = {r["doc_id"]: r for r in repeats.without_repeats(docs).collect()}
    assert cleaned[4]["text"] is None and cleaned[1]["text"] == BASE and cleaned[2]["text"] == ""
    assert repeats.without_repeats(docs).columns == docs.columns
    assert repeats.without_repeats(table).columns == table.columns
    assert repeats.removed(empty).count() == 0


def test_merged_transforms_give_repeats():
    r = np.random.default_rng(3)
    base = bytes(r.integers(97, 99, 400, dtype=np.uint8))
    for _ in range(20):
        strings, ids, lo = [], [], []
        for i in range(int(r.integers(1, 12))):
            a, n = int(r.integers(0, 250)), int(r.integers(30, 90))
            strings.append(base[a : a + n])
            ids.append(int(r.integers(0, 4)) * 100 + i)
            lo.append(int(r.integers(0, 1000)))
        windows = np.array([len(s) - 19 for s in strings])
        got = set(zip(*(x.tolist() for x in repeats.repeating_windows(strings, windows, np.array(ids), np.array(lo), 20)), strict=True))
        want, seen = set(), set()
        for d, p, x in sorted((ids[i], lo[i] + o, s[o : o + 20]) for i, s in enumerate(strings) for o in range(len(s) - 19)):
            want |= {(d, p)} if x in seen else set()
            seen.add(x)
        assert got == want


def test_decontamination(spark, docs, empty):
    item = "A train leaves Boston at 5 km per hour and then Alice walks 5 miles with Bob to see the river near town."
    bench = spark.createDataFrame([(1, item), (2, "short item 7"), (3, None), (4, "")], "item_id long, text string")
    rows = [
        (1, "intro words here. " + item + " end"), (2, item.replace("Boston", "Denver").replace("5", "9").replace("Alice", "Carol")),
        (3, item.replace("5 km", "9 km").replace("Alice", "Carol")), (4, None), (5, ""), (6, "a SHORT item, 9"), (7, "nothing of the sort in here at all"),
    ]
    out = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out == {(1, 1): False, (2, 1): True, (6, 2): True}
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS)
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_contradicted_value(spark):
    item = "Plain words of a long question come first and are followed by many more plain words before 5 apples meet Alice and 5 pears."
    rows = [(1, item.replace("5 apples", "9 apples")), (2, item.replace("5 apples", "9 apples").replace("Alice", "Carol")), (3, item.replace("5", "9"))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: (r["matched_windows"], r["item_windows"], r["reparameterised"]) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out == {1: (11, 19, False), 2: (10, 19, False), 3: (19, 19, True)}


def test_decontamination_partial_passage(spark):
    item = " ".join(VOCABULARY[:60])
    part = lambda n: f"other {' '.join(VOCABULARY[20 : 20 + n])} things"
    apart = " ".join(" ".join(VOCABULARY[i : i + 12]) + " gap" for i in (0, 15, 30))
    rows = [(1, part(25)), (2, part(13)), (3, part(12)), (4, apart)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: (r["matched_windows"], r["item_windows"]) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out == {1: (18, 53), 2: (6, 53)}


def expected_contamination(docs, items, width=8, share=0.4, run=13):
    """Pairs by plain loops, for texts of single-space words without punctuation, whose only placeholders are whole numbers."""
    tokens = lambda t: [x for w in t.split() for x in ([("N", w), ("E", "")] if w.isdigit() else [(None, w.lower())])]
    out = {}
    for d, text in docs:
        x = tokens(text)
        for i, item in items:
            y = tokens(item)
            n = min(width, len(y))
            if not y or n < decontaminate.FEW and len(x) != n:
                continue
            shape = lambda w: tuple(w) if all(k for k, _ in w) else tuple((k, None if k else v) for k, v in w)
            by_line = collections.defaultdict(set)
            for a in range(len(x) - n + 1):
                for b in range(len(y) - n + 1):
                    if shape(x[a : a + n]) == shape(y[b : b + n]):
                        by_line[a - b].add(b)
            places, passage, changed = set(), False, False
            for line, bs in by_line.items():
                pairs = {b: {(y[b + k][1], x[line + b + k][1]) for k in range(n) if y[b + k][0]} for b in bs}
                values = collections.defaultdict(set)
                for p in pairs.values():
                    for v, w in p:
                        values[v].add(w)
                torn = {v for v, w in values.items() if len(w) > 1}
                ok = sorted(b for b in bs if all(v == w for v, w in pairs[b]) or not any(v in torn for v, _ in pairs[b]))
                places |= set(ok)
                more = max(run - width, 0)
                passage |= any(ok[j + more] - ok[j] == more for j in range(len(ok) - more))
                changed |= any(v != w for b in ok for v, w in pairs[b])
            if places and (passage or len(places) >= share * max(len(y) - width + 1, 1)):
                out[d, i] = (len(places), max(len(y) - width + 1, 1), changed)
    return out


def test_decontamination_brute_force(spark):
    r = np.random.default_rng(13)
    word = lambda: str(r.integers(1, 4)) if r.random() < 0.3 else VOCABULARY[int(r.integers(0, 3))]
    items = [(i, " ".join(word() for _ in range(int(r.integers(1, 30))))) for i in range(25)] + [(90, "1 2 3 4 5 6 7 8 9"), (91, "paris"), (92, "two words")]
    docs = []
    for d in range(60):
        x = items[int(r.integers(0, 25))][1].split()
        x = [str(int(w) + 1) if w.isdigit() and d % 3 == 0 else w if r.random() < 0.97 else word() for w in x]
        docs.append((d, " ".join([word() for _ in range(int(r.integers(0, 6)))] + x + [word() for _ in range(int(r.integers(0, 6)))])))
    docs += [(70, "1 2 3 4 5 6 7 8 9"), (71, "9 8 7 6 5 4 3 2 1 " * 9), (72, "paris"), (73, "i love paris in spring"), (74, "two words"), (75, "two words more")]
    got = {(x["doc_id"], x["item_id"]): (x["matched_windows"], x["item_windows"], x["reparameterised"]) for x in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = expected_contamination(docs, items)
    assert got == want and {(70, 90), (72, 91), (74, 92)} <= set(want) and not {(71, 90), (73, 91), (75, 92)} & set(want)


def test_quality_densities():
    """Scores against the plain formula with inverse and determinant."""
    r = np.random.default_rng(17)
    d = len(quality.STATS)
    mean, root = r.normal(size=(2, d)), r.normal(size=(2, d, d))
    cov = root @ root.transpose(0, 2, 1) + np.eye(d)
    chol = np.linalg.cholesky(cov)
    model = quality.Discriminant(0.3, mean, np.linalg.inv(chol), 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1))
    x = r.normal(size=(50, d))
    x[:, 0] = np.abs(x[:, 0]) * 3
    logs = [-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(mean, cov, strict=True)]
    words = np.expm1(x[:, 0])
    want = 1 / (1 + np.exp(-np.clip(words / (words + 20) * (logs[1] - logs[0]) + 0.3, -500, 500)))
    assert np.allclose(model.scores(x), want)


def test_quality_fit_is_shrunken_moments(spark):
    r = np.random.default_rng(19)
    d = len(quality.STATS)
    rows = [(int(q), r.normal(size=d) * (1 + q) + q) for q in r.integers(0, 2, 400)]
    table = spark.createDataFrame([(q, x.tolist()) for q, x in rows] + [(None, [0.0] * d), (7, [0.0] * d)], "quality int, stats array<double>").repartition(5)
    model = quality.fit(table, 0.2, 0.3, 0.01)
    by = [np.array([x for q, x in rows if q == c]) for c in (0, 1)]
    both = sum(np.cov(x.T, bias=True) * len(x) for x in by) / len(rows)
    for c, x in enumerate(by):
        own = np.cov(x.T, bias=True)
        s = 0.5 * own + 0.2 * both + 0.3 * np.diag(np.diag(own)) + 0.01 * np.eye(d)
        assert np.allclose(model.mean[c], x.mean(0)) and np.allclose(np.linalg.inv(model.whiten[c].T @ model.whiten[c]), s) and np.isclose(model.log_det[c], np.linalg.slogdet(s)[1])
    assert np.isclose(model.log_prior, np.log((len(by[1]) + 1) / (len(by[0]) + 1)))


def test_warc_archives():
    """Archives without a dictionary, with a plain and a compressed one, and broken ones."""
    import struct

    import zstandard

    digest = lambda b: hashlib.sha256(b).hexdigest()
    bodies = [(b"<p>page %d</p>" % i) * 20 for i in range(30)]
    raws = [warc.record(i, f"http://h/{i}", b, digest(b), len(b), None, False, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies)]
    dictionary = warc.train(raws)
    plain = b"".join(zstandard.ZstdCompressor().compress(x) for x in raws)
    frames = b"".join(zstandard.ZstdCompressor(dict_data=dictionary).compress(x) for x in raws)
    leading = lambda raw: struct.pack("<II", warc.SKIPPABLE, len(raw)) + raw
    small = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    for data in (plain, leading(dictionary.as_bytes()) + frames, leading(small) + frames, leading(dictionary.as_bytes()) + frames + struct.pack("<II", 0x184D2A50, 3) + b"abc"):
        assert [(r[0], r[2]) for r in warc.read_archive(data)] == list(enumerate(bodies))
    for data in (plain[:-1], plain[:-6], frames, b"abcd" + plain, leading(dictionary.as_bytes())[:-1], struct.pack("<II", warc.SKIPPABLE, 1 << 20)):
        with pytest.raises((ValueError, zstandard.ZstdError, struct.error)):
            list(warc.read_archive(data))
    revisit = warc.record(9, "u", b"", digest(b"x"), 1, 3, True, "2024-01-01T00:00:00Z")
    assert warc.parse(revisit)[5:] == ("revisit", 3)
    with pytest.raises(ValueError):
        warc.parse(revisit.replace(b"WARC-Refers-To: <urn:x-page:3>\r\n", b""))


def expected_licences(texts, templates, least=0.8):
    """Spans by plain loops."""
    words = lambda t: re.sub(r"[\W_]+", " ", t.lower()).split()
    pairs = lambda t: list(zip(words(t), words(t)[1:], strict=False))
    out = []
    for doc, text in {(i, t) for i, t in texts if t}:
        x, found = pairs(text), {}
        for name, bodies in templates.items():
            for body in bodies:
                y = set(pairs(body))
                hits = [i for i, g in enumerate(x) if g in y]
                for i in hits:
                    for j in hits:
                        n = j - i + 1
                        if j >= i and len(y) * least / (2 - least) <= n + 1e-9 and n <= len(y) * (2 - least) / least + 1e-9:
                            dice = 2 * len(y & set(x[i : j + 1])) / (n + len(y))
                            if dice >= least:
                                found[name, i] = max(found.get((name, i), (0, 0)), (dice, n))
        spans = [(d, name, i, n) for (name, i), (d, n) in found.items()]
        for d, name, i, n in spans:
            if not any((e > d or e == d and (other, k) < (name, i)) and k <= i + n and i <= k + m for e, other, k, m in spans):
                out.append((doc, i, n + 1, name, round(d, 9)))
    return sorted(out, key=str)


def test_licences(spark, docs, empty):
    out = sorted(map(tuple, licences.scan(docs).collect()))
    assert out == [(14, 0, 5, "MIT", 1.0), (14, 8, 5, "MIT", 1.0)]
    assert licences.scan(empty).count() == 0
    bsd, mit = licences.TEMPLATES["BSD-3-Clause"], licences.TEMPLATES["MIT"]
    gpl = licences.TEMPLATES["GPL-3.0"][0]
    texts = [
        (1, "This project is released under the MIT License. Copyright 2020 Jane Doe"), (2, bsd[0].replace(" ", "\n* ", 5).upper()), (3, prose(9, 1) + gpl + prose(9, 2)), (4, mit[1] + "\n" + mit[2]),
        (5, mit[1].replace("free of charge", "without any charge").replace("merge, publish,", "")), (6, " ".join(mit[1].split()[:30])), (7, (bsd[1] + " ") * 4), (8, "under the MIT"),
        (9, "released under the gnu license of the mit"), (None, gpl), (1, gpl), (1, gpl), (10, None), (11, "released"),
    ]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, start int, licence int").repartition(3)
    got = sorted((tuple(r)[:4] + (round(r["dice"], 9),) for r in licences.scan(table).collect()), key=str)
    assert got == expected_licences(texts, licences.TEMPLATES)
    assert {r[0] for r in got} == {1, 2, 3, 4, 5, 7, None} and sum(r[0] == 7 for r in got) == 4


def test_warc(spark):
    big = "<p>" + "é" * 200 + "</p>"
    rows = [(3, "http://a/ü", big), (1, None, big), (2, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (1, None, big), (6, "u", "")]
    pages = spark.createDataFrame([(*r, 9, "x") for r in rows], "page_id long, url string, html string, size long, digest string").repartition(2)
    out = collections.Counter(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    n = len(big.encode())
    assert out == collections.Counter([(3, n, "revisit", 1), (1, n, "response", None), (1, n, "response", None), (None, n, "revisit", 1), (2, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 0, "response", None)])
    assert warc.round_trip(pages.limit(0)).count() == 0
    raw = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 3, None, False, "2024-01-01T00:00:00Z")
    assert warc.parse(raw)[2] == b"abc"
    for broken in (raw[:-1], raw.replace(b"abc", b"abd"), raw.replace(b"WARC-Date", b"WARC-Dat"), b"x" + raw):
        with pytest.raises(ValueError):
            warc.parse(broken)


def test_language(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog in the house " * 5, "en"), (2, "der hund und die katze in dem haus " * 5, "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.b.de/x", '<html lang="de"><p>der hund und die katze</p>'), (2, "http://a.b.com", "<p>the dog and the cat</p>"), (3, None, None), (4, "http://a.b.de/y", ""), (4, "odd", "<b>")], "page_id long, url string, html string")
    out = [(r["page_id"], r["lang"]) for r in language_id.identify(pages, docs).collect()]
    assert (1, "de") in out and (2, "en") in out and len(out) == 5
    assert language_id.identify(pages.limit(0), docs).count() == 0
    assert {r["lang"] for r in language_id.identify(pages, docs.limit(0)).collect()} == {None}


def expected_language(scored, names, strength=10.0):
    """Posteriors by plain loops; a page is left out of its own prior and of its own declaration's weight."""
    import urllib.parse

    def levels(host):
        if host is None:
            return [None] * 3
        if re.fullmatch(r"[0-9.]+|\[.*", host):
            return [host, host, ""]
        parts = host.split(".")
        deep = 3 if len(parts) > 2 and parts[-2] in language_id.SECOND_LEVEL.split("|") and re.fullmatch("[a-z]{2}", parts[-1]) else 2
        return [host, ".".join(parts[-deep:]), parts[-1]]

    softmax = lambda x: np.exp(x - np.max(x)) / np.exp(x - np.max(x)).sum()
    own = [softmax(np.array(r["loglik"])) if r["n_grams"] else np.zeros(len(names)) for r in scored]
    out = []
    for i, r in enumerate(scored):
        q = np.full(len(names), 1 / len(names))
        mine = levels(r["host"])
        for depth in (None, 2, 1, 0):
            if depth is not None and r["host"] is None:
                break
            n = sum((own[j] for j, x in enumerate(scored) if j != i and (depth is None or x["host"] is not None and levels(x["host"])[depth] == mine[depth])), np.zeros(len(names)))
            q = (n + strength * q) / (n.sum() + strength)
        logs = np.array(r["loglik"]) + np.log(q)
        if r["declared"] is not None:
            said = [j for j, x in enumerate(scored) if x["declared"] is not None]
            of = [j for j in said if scored[j]["declared"] == r["declared"]]
            share = sum(own[j].sum() for j in of) / max(sum(own[j].sum() for j in said), 1.0)
            hits, all_ = (sum((own[j] for j in x if j != i), np.zeros(len(names))) for x in (of, said))
            logs = logs + np.log((hits + strength * share + 1e-9) / (all_ + strength))
        p = softmax(logs)
        out.append((r["page_id"], names[int(np.argmax(p))], round(float(p.max()), 9)))
    return sorted(out, key=str)


def test_language_posteriors(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog in the house " * 5, "en"), (2, "der hund und die katze in dem haus " * 5, "de"), (3, "le chat et le chien dans la maison " * 5, "fr")], "doc_id long, text string, lang string")
    urls = ["http://localhost/a", "http://intranet/b", "http://example.com./c", "http://x.com/", "http://Example.com:8080/d", "http://u:p@www.shop.co.uk/e", "http://other.co.uk/", "http://10.0.0.1/x", "http://10.0.0.2/x", "http://[::1]:80/", None, "odd", "http://www.x.com/z", "http://x.com/"]
    bodies = ["der hund und die katze", "the dog and the cat", "le chien et le chat", "", None, "the house"]
    rows = [(i, u, None if (b := bodies[i % 6]) is None else f'<html lang="{"de" if i % 3 else "en"}"><p>{b}</p>' if i % 4 else f"<p>{b}</p>", 1.0, "x") for i, u in enumerate(urls)]
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, p double, n string").repartition(3)
    names, log_p = language_id.train(docs)
    scored = language_id.text_scores(pages, names, log_p).collect()
    got = sorted(((r["page_id"], r["lang"], round(r["probability"], 9)) for r in language_id.identify(pages, docs).collect()), key=str)
    assert got == expected_language(scored, names)
    hosts = {r["page_id"]: r["host"] for r in scored}
    assert [hosts[i] for i in (2, 4, 5, 9, 10, 11)] == ["example.com", "example.com", "www.shop.co.uk", "[::1]", None, None]


def test_pieces(docs, empty):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    odd = ["", " ", "  a  b\n\tc ", "ﬁ é é", "a\x00b", "日本𐍈", "▁x", "x" * 300, "    ", "hello   world", "\n\n\n", " a", "aaaa" * 50, BASE, "😀" * 9]
    codec = sentencepiece_codec.codec(sentencepiece_codec.read_model(sentencepiece_codec.default_model()))
    t = sentencepiece_codec.Texts.of(pa.array(odd))
    ids, offs = codec.encode(t)
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == sp.encode(odd)
    out = sentencepiece_codec.encode_documents(docs)
    text = dict(TEXTS)
    for r in out.collect():
        want = text[r["doc_id"]]
        assert r["ids"] == (None if want is None else sp.encode(want)) and r["round_trip"] == (None if want is None else True)
    assert {(r["doc_id"], r["text"]) for r in sentencepiece_codec.decode_documents(out).collect()} == set(TEXTS)
    assert sentencepiece_codec.encode_documents(empty).count() == 0


def test_pieces_of_unbroken_text(monkeypatch):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    codec = sentencepiece_codec.Codec.load(sentencepiece_codec.read_model(sentencepiece_codec.default_model()))
    r = np.random.default_rng(9)
    letters = "".join(chr(int(x)) for x in r.integers(97, 123, 20_000))
    texts = ["".join(VOCABULARY[i] for i in r.integers(0, 300, 6000)), letters, "ab" * 5000, "日本語😀" * 500, prose(3000, 8).replace(" ", ""), "thequickbrownfoxjumpsoverthelazydog" * 300]
    monkeypatch.setattr(sentencepiece_codec, "MOST_PAIRS", 1000)
    ids, offs = codec.encode(sentencepiece_codec.Texts.of(pa.array(texts)))
    assert len(codec.pairs) <= 1000
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == sp.encode(texts)


@pytest.mark.parametrize("name", ["licences", "warc", "jaccard_join", "repeats"])
def test_sql(spark, name):
    module = {"repeats": (repeats, repeats.op7_suffix_dedup), "licences": (licences, licences.op2_licence_scan), "warc": (warc, warc.op6_warc_zstandard), "jaccard_join": (jaccard_join, jaccard_join.op8_jaccard_join)}[name]
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = module[1](spark, "/root/testdata/sf0.001")
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({module[0].SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*cols).collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where(F.col("round_trip")).count() == out.count() > 100


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage by plain loops on its own input; the discriminant's verdicts are tested on their own."""
    import corpus_pipeline

    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    plain = lambda n, seed: prose(n, seed).replace(".", "")
    question = plain(30, 900) + " 7 and 12 " + plain(10, 901)
    texts = [(i, plain(90 + i, 200 + i)) for i in range(40)]
    texts += [(50 + i, texts[i][1]) for i in range(4)] + [(60 + i, " ".join(["zz", *texts[10 + i][1].split()[:-1]])) for i in range(4)]
    texts += [(70 + i, plain(60, 400 + i) + " " + plain(40, 500) + " " + plain(60, 600 + i)) for i in range(5)]
    texts += [(80, plain(50, 700) + " " + question + " " + plain(50, 701)), (81, plain(50, 702) + " " + question.replace("7", "8").replace("12", "13")), (82, plain(50, 703) + " " + " ".join(question.split()[:14]) + " " + plain(40, 704))]
    texts += [(100 + i, ("### $$$ " * (20 + i)) + plain(30, 800 + i).upper()) for i in range(25)] + [(90, None), (91, ""), (None, plain(99, 999))]
    labels = [(i, int(i < 100), 0) for i, _ in texts if i is not None and i not in (90, 91)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    good = {(r["doc_id"]) for r in quality.quality_scores(read("documents"), read("labels")).collect() if r["predicted"] == 1}
    left = [(i, t) for i, t in texts if i in good]
    assert not {100 + i for i in range(25)} & good and {i for i, _ in texts[:40]} <= good
    components = {i: c for i, _, c in expected_components(left, 5, 80)}
    left = [(i, t) for i, t in left if i is None or components[i] == i]
    assert not {50, 51, 52, 53, 60, 61, 62, 63} & {i for i, _ in left}
    gone = without(left, 100)
    cut = []
    for i, t in left:
        b = np.frombuffer((t or "").encode(), np.uint8)
        cut.append((i, None if t is None else b[~gone[-(1 << 63) if i is None else i, t]].tobytes().decode("utf-8", "ignore")))
    assert sum(len(x or "") < len(y or "") for (_, x), (_, y) in zip(cut, left, strict=True)) == 5  # four of the five that share a passage, and one that shares over 100 bytes of the question
    leaked = {d for d, _ in expected_contamination([(i, t or "") for i, t in cut], [(1, question)])}
    assert 80 in leaked
    want = sorted(((i, None if t is None else sp.encode(t)) for i, t in cut if i not in leaked), key=str)
    got = sorted(((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert got == want


def test_unrelated_sets_share_no_part():
    """Sets of 1 to 900 shingles without a common one meet under no key; sets at the threshold always do."""
    r = np.random.default_rng(11)
    sizes = [1, 2, 3, 5, 8, 13, 30, 31, 60, 150, 400, 900]
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in sizes * 20]
    offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for percent in (80, 90, 50):
        sig, owner, key, share = jaccard_join.part_hashes(np.concatenate(sets), offs, jaccard_join.Sizes(percent))
        assert (share >= 1).all() and (percent == 50 or len(np.unique(sig)) == len(sig))  # at 50 % most small sets meet under the last level
        for s in sets[:48]:
            n = len(s)
            for gone in range(n):  # as many taken out, and then as many changed, as the threshold allows
                if 100 * (n - gone) < percent * n:
                    break
            for other in (s[: n - gone + 1] if gone else s, np.concatenate([s[: n - changed(n, percent)], r.integers(0, 1 << 63, changed(n, percent)).astype(np.uint64)])):
                pair = [s, np.sort(other)]
                if len(pair[0]) == len(pair[1]) and (pair[0] == pair[1]).all():
                    continue
                got = jaccard_join.part_hashes(np.concatenate(pair), np.array([0, n, n + len(other)]), jaccard_join.Sizes(percent))
                both = set(got[0][got[1] == 0].tolist()) & set(got[0][got[1] == 1].tolist())
                need = {(w, k): m for _, w, k, m in zip(*map(np.ndarray.tolist, got), strict=True)}
                common = collections.Counter(k for x, w, k, _ in zip(*map(np.ndarray.tolist, got), strict=True) if w == 0 and x in both)
                assert any(c >= max(need[0, k], need[1, k]) for k, c in common.items() if (0, k) in need and (1, k) in need), (n, len(other), percent)


def changed(n, percent):
    """The most shingles of n that can be replaced while the sets reach the threshold."""
    c = 0
    while 100 * (n - c - 1) >= percent * (n + c + 1):
        c += 1
    return c


def test_very_long_texts(spark):
    """Texts of 1.8 MB, above a chunk: whole, and with the right results."""
    long = prose(300_000, 77)
    texts = [(1, long), (2, long[:-7]), (3, "x"), (4, None)]
    table = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(table, 3, 90).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    cut = {r["doc_id"]: r for r in repeats.removed(table).collect()}
    assert cut[2]["n_removed"] == len(long) - 7 == cut[2]["n_bytes"] and cut[3]["n_removed"] == 0
    counts = {r["doc_id"]: r for r in perplexity.quality_rules(table).collect()}
    assert counts[1]["n_words"] == 300_000 and counts[1]["perplexity"] > 1
    assert quality.quality_scores(table, spark.createDataFrame([], "doc_id long, quality int")).count() == 4
    assert {r["doc_id"]: r["size"] for r in sharding.shard_documents(table, shards=2).collect()} == {1: len(long) + 8, 2: len(long) + 1, 3: 9, 4: 8}
    bench = spark.createDataFrame([(1, " ".join(long.split()[200_000:200_040])), (2, prose(40, 78))], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contamination(table, bench).collect()) == [(1, 1), (2, 1)]
    marked = table.withColumn("text", F.concat("text", F.lit(" released under the MIT license")))
    assert sorted((r["doc_id"], r["start"]) for r in licences.scan(marked).collect()) == [(1, 300_000), (2, 299_999), (3, 1)]
    assert all(r["round_trip"] in (True, None) for r in sentencepiece_codec.encode_documents(table).collect())
    pages = spark.createDataFrame([(1, "http://a.com", f"<p>{long}</p>"), (2, "http://a.com", f"<p>{long}</p>")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in warc.round_trip(pages).collect()) == [(1, "response", len(long) + 7), (2, "revisit", len(long) + 7)]
    assert language_id.identify(pages, table).where("lang = 'en'").count() == 2
