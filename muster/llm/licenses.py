"""License scans: templates found in texts by MinHash bands over overlapping windows, verified by exact containment.

Words are runs of ASCII letters and digits, with `.` and `-` inside, after lower-casing. Templates and windows are sets
of five-word shingles; a template of fewer words is one shingle of all its words. A template matches where a window
as long as itself holds at least `percent` of its shingles.

1. A text without any anchor word cannot match: anchors are chosen so that a match lacks fewer shingles than have
   one. Nor can a window without any template shingle match. Both tests are exact; the first costs one pass, and what
   it leaves is kept as shingle hashes, so that no later filter evaluates them again.
2. Around each shingle that occurs in some template, windows of each template length start every eighth of that
   length. A window shifted by half a step and with a fifth of the shingles changed still has a Jaccard similarity over
   0.6 with its template.
3. Each window gets a signature of 64 minima, cut into 32 bands of two rows: at a similarity of 0.6 it shares no band
   with its template with a probability of 0.64 ** 32, below one in a million. Bands are joined with the templates'.
4. A candidate stands for all windows that start within one step of it: the shingles of each are intersected with the
   template's, so containment is taken at the true offset; the best window of a text and template is reported.

Everything is DataFrame functions. Templates are a parameter bounded by MAX_TEMPLATE_WORDS, which is why their bands may
be broadcast. Null and empty texts match nothing; repeated rows of a key count once; null keys are one key; ties
between windows go to the first. Extra columns do not matter; an empty table gives no rows. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.tables import keep, load

WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
HASHES, ROWS, MAX_TEMPLATE_WORDS = 64, 2, 200_000

#: Customary notices of public licenses.
TEMPLATES = (
    ("apache-2.0/line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0/header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0/warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit/line", "Released under the MIT License."),
    ("mit/grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("bsd/grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0/line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl/header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0/line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0/line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("rights-reserved/line", "All rights reserved."),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def anchors(templates: list[list[str]], percent: int) -> list[str]:
    """Words without any of which a text can hold no template: of each template, the longest words, so many that
    more of its shingles have one than a match may lack."""
    out: set[str] = set()
    for words in templates:
        shingles = [set(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
        chosen: set[str] = set()
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if 100 * sum(bool(s & chosen) for s in shingles) > (100 - percent) * len(shingles):
                break
            chosen.add(w)
        out |= chosen
    return sorted(out)


def _shingles(words: Column | str, k: int) -> Column:
    """Hashes of runs of `k` words of a column of words."""
    n = F.size(words)
    return F.transform(F.slice(words, 1, F.greatest(n - (k - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k))))


def _bands(shingles: str, length: Column) -> tuple[Column, Callable[[Column], Column]]:
    """The minima of a column of shingle hashes, and the bands' keys from a column of minima."""
    minima = F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda j: F.array_min(F.transform(F.col(shingles), lambda h: F.xxhash64(h, j))))
    return minima, lambda sig: F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda b: F.xxhash64(b, length, *(F.get(sig, b * ROWS + r) for r in range(ROWS))))


def _starts(length: int, step: int, k: int) -> Column:
    """The windows of `length` words, at multiples of `step`, that hold a shingle at a place in `at`."""
    last = lambda p: (F.floor(p / step) * step).cast("int")
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - (length - k)) / step) * step).cast("int")
    around = F.transform("at", lambda p: F.sequence(F.least(first(p), last(p)), last(p), F.lit(step)))
    return F.transform(F.array_distinct(F.flatten(around)), lambda a: F.struct(F.lit(length).alias("length"), a.alias("start")))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text and template that it holds: the key, license, first_word (from 0), n_words, shared and template
    shingles."""
    spark = docs.sparkSession
    cut = [(name, words_of(text)) for name, text in templates]
    if sum(len(w) for _, w in cut) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    # bounded as WORD bounds words; \b would take an underscore for a part of the word
    anchor = "|".join(map(re.escape, anchors([w for _, w in cut], percent)))
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = docs.select(F.col(id_col).alias("doc"), lower.alias("text")).where(F.col("text").rlike(rf"(?<![a-z0-9])(?:{anchor})(?![a-z0-9])"))
    texts = texts.select("doc", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    sizes = sorted({min(5, len(w)) for _, w in cut})
    # texts are read and cut into words once, for all sizes of shingles
    all_hashes = keep(texts.select("doc", *(_shingles("words", k).alias(f"hashes{k}") for k in sizes)))
    out = None
    for k in sizes:
        own = [(name, w, len(w)) for name, w in cut if min(5, len(w)) == k]
        named = spark.createDataFrame(own, "license string, words array<string>, length int")
        named = named.select("license", "length", F.array_distinct(_shingles("words", k)).alias("wanted"))
        minima, keys = _bands("wanted", F.col("length"))
        named = named.withColumn("sig", minima).withColumn("bands", keys(F.col("sig"))).drop("sig")
        known = sorted({h for r in named.select("wanted").collect() for h in r.wanted})  # bounded as the templates are
        # each length with its step, and how many windows of it hold a given shingle
        steps = sorted({(n, max(1, n // 8)) for _, _, n in own})
        hashed = all_hashes.select("doc", F.col(f"hashes{k}").alias("hashes"))
        hit = hashed.withColumn("at", F.filter(F.transform("hashes", lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull()))
        starts = [_starts(n, step, k) for n, step in steps]
        windows = hit.select("doc", "hashes", F.explode_outer(F.concat(*starts)).alias("w"))
        # the hashes of all windows that start less than a step away, and how far the grid's is from the first of them
        step = F.greatest(F.lit(1), F.floor(F.col("w.length") / 8).cast("int"))
        first = F.greatest(F.lit(0), F.col("w.start") - step + 1)
        around = F.slice("hashes", first + 1, F.col("w.start") - first + step - 1 + F.col("w.length") - (k - 1))
        windows = windows.select("doc", F.col("w.length").alias("length"), F.col("w.start").alias("start"), F.array_distinct(F.slice("hashes", F.col("w.start") + 1, F.col("w.length") - (k - 1))).alias("have"), around.alias("around"), (F.col("w.start") - first).alias("back"))
        minima, keys = _bands("have", F.col("length"))
        signed = windows.withColumn("sig", minima).withColumn("bands", keys(F.col("sig"))).drop("sig")
        wanted = named.select("license", F.col("length").alias("t_length"), "wanted", F.explode_outer("bands").alias("band"))
        near = signed.select("doc", "length", "start", "back", "around", F.explode_outer("bands").alias("band")).join(F.broadcast(wanted), "band").where("length = t_length")
        once = near.select("doc", "license", "length", "start", "back", "around", "wanted").distinct()
        reach = F.greatest(F.lit(1), F.floor(F.col("length") / 8).cast("int")) - 1
        shared = lambda j: F.size(F.array_intersect(F.slice("around", j + 1, F.col("length") - (k - 1)), F.col("wanted"))).cast("bigint")
        tried = F.transform(F.sequence(F.lit(0), F.col("back") + reach), lambda j: F.struct(shared(j).alias("shared"), (F.col("back") - F.col("start") - j).alias("from_start")))
        found = once.select("doc", "license", F.array_max(tried).alias("w"), F.col("length").cast("bigint").alias("n_words"), F.size("wanted").cast("bigint").alias("of"))
        found = found.select("doc", "license", (-F.col("w.from_start")).alias("start"), "n_words", F.col("w.shared").alias("shared"), "of")
        found = found.where(100 * F.col("shared") >= percent * F.col("of"))
        best = found.groupBy("doc", "license").agg(F.max(F.struct("shared", (-F.col("start")).alias("back"), "n_words", "of")).alias("m"))
        part = best.select(F.col("doc").alias(id_col), "license", (-F.col("m.back")).cast("bigint").alias("first_word"), F.col("m.n_words").alias("n_words"), F.col("m.shared").alias("shared_shingles"), F.col("m.of").alias("template_shingles"))
        out = part if out is None else out.unionByName(part)
    return out


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
