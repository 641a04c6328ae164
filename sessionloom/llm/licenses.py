"""License notices in texts: MinHash bands over overlapping windows, then exact containment. Native expressions only.

Texts are cut into words of letters and digits in lower case and those into shingles of five
words. A template of n words is sought in windows of 2 n to 2.5 n words, half overlapping, so
that any passage up to its size lies whole in one window. The MinHash of a window is compared
with the template's by bands of one row: a window that holds 0.8 of a template's shingles has a
Jaccard similarity of 1/6 or more (the least for n = 5), so that 96 bands miss it with a
probability of at most (5/6) ** 96 = 3e-8. Retrieved templates are verified by the exact share
of their shingles in the window.

Windows without any word that a sufficient share of a template must bring along are left out
first, which loses nothing: of a template's n shingles at least 0.8 n must be present, so of
any n - ceil(0.8 n) + 1 of them at least one, with all its words.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import text_or_empty

WORDS = 5
#: Templates are written in ASCII.
ASCII_WORD = r"[A-Za-z0-9]+"
BANDS = 96
#: Public license notices. Templates are a parameter; these are the default.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
     "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
     "governing permissions and limitations under the License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License"),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """Distinct hashes of five words each; fewer words have none."""
    last = F.size(words) - WORDS + 1
    return F.when(last > 0, F.array_distinct(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, WORDS)))))).otherwise(F.array().cast("array<bigint>"))


def minhash(shingles: Column) -> Column:
    """The least of the shingles' hashes under each of BANDS seeds."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda s: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, s))))


def _anchors(words: list[str], need: float) -> set[str]:
    """Words of which any sufficient share of the template must contain one; long words first."""
    shingles = [set(words[i:i + WORDS]) for i in range(len(words) - WORDS + 1)]
    hit_needed = len(shingles) - math.ceil(need * len(shingles) - 1e-9) + 1
    chosen: set[str] = set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(bool(s & chosen) for s in shingles) >= hit_needed:
            break
        chosen.add(w)
    return chosen


def _window(words: int) -> int:
    """The first even number of a ladder of steps of a quarter that is at least twice the words."""
    size = 2 * WORDS
    while size < 2 * words:
        size = 2 * math.floor(size * 1.25 / 2)
    return size


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]], need: float) -> list[dict]:
    """Each template's shingles, MinHash, window size and anchors; templates are few, a parameter."""
    if len(templates) > 10_000:
        raise ValueError("at most 10,000 templates")
    frame = spark.createDataFrame(list(templates), "license string, text string").withColumn("words", words_of(F.col("text")))
    rows = frame.withColumn("shingles", shingles_of(F.col("words"))).withColumn("minhash", minhash(F.col("shingles"))).collect()
    for r in rows:
        if not r["shingles"]:
            raise ValueError(f"template {r['license']} has fewer than {WORDS} words")
    return [{"license": r["license"], "shingles": r["shingles"], "minhash": r["minhash"],
             "window": _window(len(r["words"])), "anchors": _anchors(r["words"], need)} for r in rows]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, need: float = 0.8) -> DataFrame:
    """doc_id, license, containment, windows: a row per document and license found in it.

    ``windows`` counts the windows that hold at least ``need`` of the template's shingles,
    ``containment`` is the largest share. Null, empty and clean texts give no row; rows with one
    doc_id count as one document; rows with a null doc_id do so, too. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates, need)
    anchors = sorted(set().union(*(t["anchors"] for t in known)))
    sizes = sorted({t["window"] for t in known})
    # Templates times BANDS rows at most, each a few hundred numbers.
    bands = spark.createDataFrame([(t["license"], t["window"], b, m, t["shingles"]) for t in known for b, m in enumerate(t["minhash"])],
                                  "license string, size int, band int, least long, template array<long>")
    text = text_or_empty()
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter(
        F.lower("text").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(anchors)})(?![\p{{L}}\p{{N}}])"))
    worded = some.select("doc_id", words_of(F.col("text")).alias("words"))
    held = F.array(*[F.lit(a) for a in anchors])
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(held, F.get("words", i)))

    def around(size: int) -> Column:
        half = size // 2
        # A place lies in the window that begins in its half and in the one before.
        starts = F.flatten(F.transform("places", lambda p: F.array(F.floor(p / half) * half, F.floor(p / half) * half - half)))
        return F.transform(F.filter(F.array_distinct(starts), lambda s: s >= 0), lambda s: F.struct(F.lit(size).alias("size"), s.cast("int").alias("start")))

    windows = worded.withColumn("places", places).select(
        "doc_id", "words", F.explode(F.concat(*[around(s) for s in sizes])).alias("w")).select(
        "doc_id", F.col("w.size").alias("size"), F.col("w.start").alias("start"),
        shingles_of(F.slice("words", F.col("w.start") + 1, F.col("w.size"))).alias("shingles"))
    banded = windows.filter(F.size("shingles") > 0).select(
        "doc_id", "size", "start", "shingles", F.posexplode(minhash(F.col("shingles"))).alias("band", "least"))
    met = banded.join(F.broadcast(bands), ["size", "band", "least"])
    share = F.size(F.array_intersect("shingles", "template")) / F.size("template")
    # Windows that meet in several bands are verified in each and counted once.
    sure = met.select("doc_id", "license", "size", "start", share.alias("share")).filter(F.col("share") >= need)
    return sure.groupBy("doc_id", "license", "size", "start").agg(F.max("share").alias("share")).groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.count("*").alias("windows"))
