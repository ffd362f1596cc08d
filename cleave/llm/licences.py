"""Licence scan: passages of text compared with licence templates by the Dice coefficient over word bigrams, in DataFrame functions only.

Method.  Texts and templates are lower-cased and everything but letters and digits becomes one space, so line breaks, quotes and case don't count.
Every word bigram of a text is looked up among the templates' bigrams, which are few and broadcast; only these hits go on.  A span goes from one hit
of a template to another; with c different template bigrams in its l places and b in the template, its coefficient is 2c/(l+b).  A coefficient
of ``least`` (t) bounds the size: l lies between b*t/(2-t) and b*(2-t)/t, and c is at least t*(l+b)/2.  Hits are therefore dealt into stretches of
the longest span's length (each goes to its own and the one before), stretches with too few different bigrams are dropped by a count, and
spans are compared only in what is left.  Every start takes its best span (longer one of equals); of spans that overlap, whatever their licence,
those stay that none is better than (ties: smaller licence name, smaller start).

A stretch holds at most two span lengths of places, so no task holds more of one text; texts of a third of all rows are dealt like any others.

Edge cases.  Null and empty texts and texts of fewer than two words match nothing.  Repeated rows of an id are found once; rows of one id with
different texts are scanned each.  Null ids are scanned like others.  Texts of any length are scanned whole.  Empty tables give an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.session import materialise

# Licence names, and the notices and texts that are looked for.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Different bigrams of all templates together; beyond it the lookup is a shuffled join.
MOST_GRAMS = 1_000_000


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """The hashed neighbouring word pairs of an array of words, in order."""
    at = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1)))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """``doc_id, start, words, licence, dice``: where a licence's passage starts (a place among the words) and how many words it has."""
    spark = docs.sparkSession
    rows = [(name, i, body) for name, bodies in sorted(templates.items()) for i, body in enumerate(bodies)]
    known = spark.createDataFrame(rows, "licence string, part int, body string").select("licence", "part", F.array_distinct(bigrams(F.split(normalised(F.col("body")), " "))).alias("set")).where(F.size("set") > 0)
    known = known.select("licence", "part", F.size("set").alias("b"), F.explode("set").alias("gram"))
    longest = F.floor(F.col("b") * ((2 - least) / least) + 1e-9).cast("int")
    shortest = F.ceil(F.col("b") * (least / (2 - least)) - 1e-9).cast("int")
    known = known.withColumn("low", shortest).withColumn("high", longest)
    known = F.broadcast(known) if known.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS else known

    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("which"), F.split(normalised(F.col("text")), " ").alias("_words"))
    grams = texts.select("doc_id", "which", F.posexplode(bigrams(F.col("_words"))).alias("pos", "gram"))
    hits = grams.join(known, "gram").withColumn("own", F.floor(F.col("pos") / F.col("high")).cast("int"))
    # a span starts in one stretch and ends in it or in the next
    hits = hits.withColumn("stretch", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    by = ["doc_id", "which", "licence", "part", "b", "low", "high", "stretch"]
    found = hits.groupBy(*by).agg(F.collect_set(F.struct("pos", "gram")).alias("hits"))  # at most two span lengths of places
    enough = least * (F.col("low") + F.col("b")) / 2 - 1e-9
    found = found.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["gram"]))) >= enough)
    found = found.withColumn("hits", F.sort_array("hits"))
    starts = F.filter("hits", lambda h: F.floor(h["pos"] / F.col("high")) == F.col("stretch"))

    def best(h: Column) -> Column:
        """The best span that starts at a hit: dice, length."""
        ends = F.filter("hits", lambda x: (x["pos"] - h["pos"] + 1).between(F.col("low"), F.col("high")))
        common = lambda e: F.size(F.array_distinct(F.transform(F.filter("hits", lambda x: x["pos"].between(h["pos"], e["pos"])), lambda x: x["gram"])))
        return F.array_max(F.transform(ends, lambda e: F.struct((2 * common(e) / (e["pos"] - h["pos"] + 1 + F.col("b"))).alias("dice"), (e["pos"] - h["pos"] + 1).alias("len"))))

    spans = found.select("doc_id", "which", "licence", "high", F.explode(F.transform(starts, lambda h: F.struct(h["pos"].alias("start"), best(h).alias("best")))).alias("s"))
    spans = spans.select("doc_id", "which", "licence", F.col("s.start").alias("start"), F.col("s.best.len").alias("len"), F.col("s.best.dice").alias("dice")).where(F.col("dice") >= least)
    spans = spans.groupBy("doc_id", "which", "licence", "start").agg(F.max(F.struct("dice", "len")).alias("x")).select("doc_id", "which", "licence", "start", F.col("x.len").alias("len"), F.col("x.dice").alias("dice"))
    spans = materialise(spans, "licence-spans")  # few; each is compared with others below
    # of spans that overlap the better one stays; both stand in every tile that they touch
    tile = max(1, max((floor((2 - least) / least * len(body.split())) for _, _, body in rows), default=1))
    tiled = spans.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("start") + F.col("len")) / tile))))
    other = tiled.select("tile", *(F.col(c).alias(f"o_{c}") for c in ("doc_id", "which", "licence", "start", "len", "dice")))
    better = (F.col("o_dice") > F.col("dice")) | ((F.col("o_dice") == F.col("dice")) & (F.struct("o_licence", "o_start") < F.struct(F.col("licence").alias("o_licence"), F.col("start").alias("o_start"))))
    overlap = (F.col("o_start") <= F.col("start") + F.col("len")) & (F.col("start") <= F.col("o_start") + F.col("o_len"))
    same = F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & (F.col("which") == F.col("o_which")) & (tiled["tile"] == other["tile"])
    beaten = tiled.join(other, same & overlap & better, "left_semi").select("doc_id", "which", "licence", "start").distinct()
    a, b = spans.alias("a"), beaten.alias("b")
    stay = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.which") == F.col("b.which")) & (F.col("a.licence") == F.col("b.licence")) & (F.col("a.start") == F.col("b.start")), "left_anti")
    return stay.select("doc_id", F.col("start").cast("long").alias("start"), (F.col("len") + 1).cast("long").alias("words"), "licence", "dice")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_QUOTED = ", ".join("('{}', {}, '{}')".format(k, i, v.replace("'", "''")) for k, vs in sorted(TEMPLATES.items()) for i, v in enumerate(vs))
SQL = rf"""
WITH t(licence, part, body) AS (VALUES {_QUOTED}),
tw AS (SELECT licence, part, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t),
ts AS (SELECT licence, part, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS s FROM tw),
tg AS (SELECT licence, part, len(s) AS b, unnest(s) AS gram FROM ts),
dw AS (SELECT DISTINCT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS pos, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM dw WHERE len(w) > 1),
h AS (SELECT doc_id, licence, part, b, pos, gram FROM dg JOIN tg USING (gram)),
near AS (SELECT x.*, count(DISTINCT y.gram) AS c FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.licence = y.licence AND x.part = y.part AND y.pos BETWEEN x.pos AND x.pos + 1.5 * x.b GROUP BY ALL),
s AS (SELECT * FROM near WHERE 3 * c >= 2 * b),
p AS (SELECT s.doc_id, s.licence, s.part, s.b, s.pos AS start, e.pos - s.pos + 1 AS l FROM s JOIN h e ON e.doc_id = s.doc_id AND e.licence = s.licence AND e.part = s.part AND 1.5 * (e.pos - s.pos + 1) >= s.b AND e.pos - s.pos + 1 <= 1.5 * s.b),
q AS (SELECT p.*, (SELECT count(DISTINCT gram) FROM h WHERE h.doc_id = p.doc_id AND h.licence = p.licence AND h.part = p.part AND h.pos BETWEEN p.start AND p.start + p.l - 1) AS c FROM p),
d AS (SELECT doc_id, licence, start, l, 2.0::DOUBLE * c / (l + b) AS dice FROM q WHERE 2.0::DOUBLE * c / (l + b) >= 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, licence, start ORDER BY dice DESC, l DESC) AS k FROM d),
z AS (SELECT * FROM r WHERE k = 1)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(l + 1 AS BIGINT) AS words, licence, dice FROM z
WHERE NOT EXISTS (SELECT 1 FROM z o WHERE o.doc_id = z.doc_id AND o.start <= z.start + z.l AND z.start <= o.start + o.l AND (o.dice > z.dice OR o.dice = z.dice AND (o.licence < z.licence OR o.licence = z.licence AND o.start < z.start)))
"""
