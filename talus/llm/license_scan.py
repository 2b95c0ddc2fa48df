"""License scans: MinHash bands retrieve templates for overlapping text windows, exact containment decides.

SQL functions only.  Words are runs of letters and digits in lower case, shingles five of them.
A text is cut into overlapping blocks.  Windows of a few sizes slide over a block by an eighth of
their size; each has a MinHash signature whose bands are looked up among the templates' bands.  What a
block retrieves is verified once by exact containment: the share of a template's shingles inside a
window of its own length that starts in the block or soon behind it.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import documents

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and rows.  A template that fills a window of its size class to 0.8 has Jaccard 0.55 or
#: more with it, so a band agrees with probability 0.3 and at least one of 40 with 1 - 1e-6.
BANDS, ROWS = 40, 2
#: Ratio between window size classes.
GROWTH = 1.25
#: Words of a text whose windows are one row's work.
BLOCK = 512
#: A window of the verification is this much longer than its template, to let words be inserted.
SLACK = 1.25

#: License statements that are looked for, the notices and key sentences of usual licenses.
TEMPLATES: dict[str, str] = {
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-disclaimer": "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0-or-later": "either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-disclaimer": "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def gates(templates: dict[str, str], similarity: float = SIMILARITY) -> list[str]:
    """Words without which no template can be contained to `similarity`.

    Of each template the longest words, until the shingles free of them are fewer than the
    share that a match needs: a text that has none of these words matches nothing.
    """
    out: set[str] = set()
    for text in templates.values():
        words = words_of(text)
        shingles = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        need = similarity * len(shingles)
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if len(shingles) < need:
                break
            out.add(word)
            shingles = {s for s in shingles if word not in s}
    return sorted(out)


def _classes(templates: dict[str, str]) -> list[int]:
    """Window sizes in words so that every template has one of at most `GROWTH` times its length."""
    sizes: list[int] = []
    for n in sorted({len(words_of(t)) for t in templates.values()}):
        if not sizes or n > sizes[-1]:
            sizes.append(max(n, math.floor(n * GROWTH)))
    return sizes


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def _hashes(words: Column) -> Column:
    """Hashes of all shingles; none where there are fewer words than a shingle has."""
    last = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))
    return F.when(
        last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))
    ).otherwise(F.array().cast("array<bigint>"))


def _mixed(shingles: Column) -> Column:
    """The shingles' hashes under each row's seed: an array of arrays."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda seed: F.transform(shingles, lambda h: F.xxhash64(h, seed)))


def _bands(mixed: Column, start: Column, length: Column) -> Column:
    """One hash a band over the least hashes of its rows in a stretch; loops of lambdas, so that the plan stays small."""
    least = lambda row: F.array_min(F.slice(F.get(mixed, row), start, length))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[least(b * ROWS + r) for r in range(ROWS)]))


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column behind a generator.  The optimiser moves plain projections into the lambdas
    that use them, where they would be computed again for every element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def template_frame(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """`license, n_words, shingles` (distinct hashes) of each template."""
    frame = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    words = _words(F.col("body"))
    return frame.select("license", F.size(words).alias("n_words"), F.array_distinct(_hashes(words)).alias("wanted"))


def _blocks(words: Column, reach: int) -> Column:
    """Stretches of `BLOCK` words that starts are taken from, each with the `reach` words that follow."""
    last = F.floor((F.size(words) - SHINGLE) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(words, k * BLOCK + 1, BLOCK + reach))


def _starts(gate_places: Column, size: int, n_hashes: Column) -> Column:
    """Windows (start, shingles) of one size, on a grid of an eighth of it, that begin in the block and cover a gate word."""
    step = max(1, size // 8)
    first = lambda g: F.greatest(F.ceil((g - size) / step).cast("int"), F.lit(0))
    last = lambda g: F.least(F.floor((g - 1) / step), F.lit((BLOCK - 1) // step)).cast("int")
    near = F.filter(gate_places, lambda g: first(g) <= last(g))
    starts = F.array_distinct(F.flatten(F.transform(near, lambda g: F.transform(F.sequence(first(g), last(g)), lambda k: k * step + 1))))
    fits = F.filter(starts, lambda s: s <= n_hashes)
    return F.transform(fits, lambda s: F.struct(s.alias("start"), F.lit(size - SHINGLE + 1).alias("length")))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, license, n_shingles, n_found, containment` of every template found in a text.

    `containment` is the greatest share of the template's shingles inside any window of `SLACK`
    times its words; rows below `similarity` are not returned.  Null and empty texts and texts
    of fewer than five words match nothing; repeated rows give one row a template; a null id
    keeps its null; an empty table gives none; other columns are ignored.  A text is cut into
    overlapping blocks, which are rows of their own and are dealt to all tasks: a text's length
    sets the number of blocks, not the work on a row.
    """
    spark = docs.sparkSession
    known = template_frame(spark, templates)
    sizes = _classes(templates)
    gate = gates(templates, similarity)
    # What begins in a block may be found best by a window that begins behind it: twice the longest window.
    longest = max(math.ceil(max(len(words_of(t)) for t in templates.values()) * SLACK), max(sizes))
    reach = 2 * longest
    # The templates' bands: some hundred numbers, fixed by `templates`.
    banded = _settled(known, "mixed", _mixed(F.col("wanted"))).select("license", _bands(F.col("mixed"), F.lit(1), F.size("wanted")).alias("codes")).collect()
    holders: dict[int, list[str]] = {}
    for row in banded:
        for code in row["codes"]:
            holders.setdefault(code, []).append(row["license"])
    codes = F.lit(list(holders))
    owners = F.map_from_arrays(codes, F.lit(list(holders.values())))
    # Lossless: without a gate word no template reaches the share that a match needs.
    # The text is lower-cased once, as the variable of a lambda.
    hit = F.exists(F.array(F.lower(F.col(text_col))), lambda t: reduce(or_, [F.contains(t, F.lit(word)) for word in gate]))
    rows = docs.where(hit).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.array(_words(F.col(text_col)))).alias("words"))
    parts = rows.where(F.size("words") >= SHINGLE).select("doc_id", F.explode(_blocks(F.col("words"), reach)).alias("part"))
    places = F.filter(F.sequence(F.lit(1), F.size("part")), lambda i: F.element_at(F.col("part"), i).isin(gate))
    parts = _settled(parts, "gates", places).where(F.size("gates") > 0)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    parts = parts.repartition(tasks, F.xxhash64("part"))
    blocks = _settled(parts, "hashes", _hashes(F.col("part"))).select("doc_id", "gates", "hashes")
    windows = F.concat(*[_starts(F.col("gates"), size, F.size("hashes")) for size in sizes])
    # Hashes under all seeds are looked up by the windows of the block, and go before a row is copied.
    found = F.flatten(F.transform(F.array(_mixed(F.col("hashes"))), lambda m: F.flatten(F.transform(F.col("windows"), lambda w: F.array_intersect(_bands(m, w["start"], w["length"]), codes)))))
    blocks = _settled(_settled(blocks, "windows", windows), "found", F.array_distinct(found)).where(F.size("found") > 0)
    retrieved = blocks.select("hashes", "doc_id", F.explode(F.array_distinct(F.flatten(F.transform("found", lambda c: F.element_at(owners, c))))).alias("license"))
    # Some dozen rows, fixed by `templates`.
    scored = retrieved.join(F.broadcast(known), "license")
    span = F.ceil(F.col("n_words") * SLACK).cast("int") - (SHINGLE - 1)
    hits = F.filter(F.sequence(F.lit(1), F.least(F.lit(BLOCK + longest), F.size("hashes"))), lambda p: F.array_contains(F.col("wanted"), F.element_at(F.col("hashes"), p)))
    scored = _settled(scored, "hits", hits).where(F.size("hits") > 0)
    shared = F.array_max(F.transform("hits", lambda p: F.size(F.array_intersect(F.slice(F.col("hashes"), p, span), F.col("wanted")))))
    most = scored.select("doc_id", "license", F.size("wanted").cast("long").alias("n_shingles"), shared.cast("long").alias("n_found"))
    best = most.groupBy("doc_id", "license").agg(F.first("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return best.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= similarity)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _sql() -> str:
    literals = ", ".join(f"('{k}', '{' '.join(words_of(v))}')" for k, v in sorted(TEMPLATES.items()))
    return f"""
with templates(license, body) as (values {literals}),
tw as (select license, string_split(body, ' ') as w from templates),
ts as (
  select license, len(w) as n_words, list_distinct([array_to_string(w[i : i + {SHINGLE - 1}], ' ') for i in range(1, len(w) - {SHINGLE - 2})]) as wanted from tw
), docs as (
  select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents
), shingles as (
  select doc_id, pos, array_to_string(w[pos : pos + {SHINGLE - 1}], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) as pos from docs)
), hits as (
  select distinct doc_id, license, n_words, len(wanted) as n_shingles, pos, s
  from shingles join (select *, unnest(wanted) as s from ts) using (s)
), windows as (
  select a.doc_id, a.license, a.pos, any_value(a.n_shingles) as n_shingles, count(distinct b.s) as n_found
  from hits a join hits b on a.doc_id = b.doc_id and a.license = b.license
    and b.pos between a.pos and a.pos + ceil(a.n_words * {SLACK}e0) - {SHINGLE}
  group by 1, 2, 3
)
select doc_id, license, n_shingles::bigint as n_shingles, max(n_found)::bigint as n_found, max(n_found)::double / n_shingles as containment
from windows group by doc_id, license, n_shingles having max(n_found)::double / n_shingles >= {SIMILARITY}
"""


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES = {"op7_license_scan": _sql()}
