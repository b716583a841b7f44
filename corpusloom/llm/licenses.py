"""License scans, with DataFrame functions only.

Words are lower-cased runs of letters and digits; shingles are five words.  Templates and texts are cut into
overlapping windows of shingles, each summed up by the minima of four hash functions: four bands of one row.  A
template takes windows of the largest of 16, 4, 2 and 1 shingles that it holds, half a window apart; texts take
windows of 16 shingles at every fourth place and of the other sizes at every place.  Verification reaches half
a window to both sides of a place that some band retrieves.

How sure retrieval is where a text holds a share of 0.8 or more of a template (collision_chance() computes it for the
worst stretch of missing shingles, as changed words take shingles away in stretches): two windows of Jaccard
similarity j agree in some band with probability 1 - (1 - j)**4.  Templates of 1 to 4 shingles miss none at that
share, so their own windows are there whole and agree for certain; of 8 and 9 shingles one may be missing,
and some window of 4 is whole.  With 16 shingles or more the worst case is 17 of which 3 are missing, and one window pair
alone agrees with 0.98; the others come on top (README has what was measured).

Retrieved places are verified exactly: the share of the template's shingles found in a stretch of the
template's length, at the best place near the retrieved one, must be 0.8 or more.

The catalogue is fixed and small; its keys are constants of the plan and its join side is broadcast.
Texts are never exploded, only retrieved places are, each with the shingles around it.

Nulls: a null text has no words.  Rows are told apart by a row number, so repeated rows and null ids each
get their own results.  Texts shorter than a shingle match nothing; texts of any length are looked at whole.  Ties in
containment go to the earlier place.  Further columns aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

SHINGLE = 5
#: Shingles in a window, largest first, and between windows of a text; the bands of each.
WINDOWS = {16: 4, 4: 1, 2: 1, 1: 1}
BANDS = 4
CONTAINMENT = 0.8

#: Notices and opening texts of common licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """A 64-bit hash for every five words in a row; shorter texts have none."""
    last = F.size(words) - SHINGLE + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE))))).otherwise(F.array().cast("array<long>"))


def window_size(shingles: int) -> int:
    return next(size for size in WINDOWS if shingles >= size)


def step_of(size: int) -> int:
    """Shingles between windows of a template."""
    return max(1, size // 2)


def band_count(size: int) -> int:
    """Windows of one or two shingles stand for templates that must be there whole: their minima agree for certain."""
    return BANDS if size > 2 else 1


def offsets(shingles: int) -> list[int]:
    """Where a template's windows begin."""
    size = window_size(shingles)
    return sorted({*range(0, shingles - size + 1, step_of(size)), shingles - size})


def collision_chance(shingles: int, containment: float = CONTAINMENT) -> float:
    """The least chance, over the place of a stretch of missing shingles and the text's windows, that the best pair of windows alone agrees in a band."""
    size, missing = window_size(shingles), shingles - max(1, int(-(-containment * shingles // 1)))
    step, worst = WINDOWS[size], 1.0
    for gone in range(shingles - missing + 1):
        there = {i for i in range(shingles) if not gone <= i < gone + missing}
        for shift in range(step):
            best = 0.0
            for o in offsets(shingles):
                for at in range(o - size, o + size + 1):
                    if (at - shift) % step == 0:
                        common = len(there & set(range(max(o, at), min(o, at) + size)))
                        best = max(best, common / (2 * size - common))
            worst = min(worst, 1 - (1 - best) ** band_count(size))
    return worst


def hashed(shingles: Column, band: int) -> Column:
    """The band's hash function on every shingle."""
    return F.transform(shingles, lambda x: F.xxhash64(x, F.lit(band)))


def catalogue(spark: SparkSession, templates: dict[str, str]) -> tuple[list[dict], dict[tuple[int, int], list[tuple[int, int, str]]]]:
    """Templates with their shingles, and the keys by (window size, band): (key, offset of the window, license)."""
    rows = literal_table(spark, [{"license": F.lit(k), "text": F.lit(v)} for k, v in sorted(templates.items())])
    rows = rows.select("license", shingle_hashes(word_array(F.col("text"))).alias("h"))
    rows = rows.select("license", "h", *[hashed(F.col("h"), b).alias(f"g{b}") for b in range(BANDS)]).collect()  # as many rows as the catalogue has
    listed, keys = [], {}
    for r in rows:
        n = len(r["h"])
        if not n:
            raise ValueError(f"template {r['license']} is shorter than a shingle")
        size = window_size(n)
        listed.append({"license": r["license"], "size": size, "shingles": sorted(set(r["h"])), "length": n})
        for offset in offsets(n):
            for b in range(band_count(size)):
                keys.setdefault((size, b), []).append((min(r[f"g{b}"][offset : offset + size]), offset, r["license"]))
    return listed, keys


def _hits(minima: Column, size: int, band: int, wanted: list[int]) -> Column:
    """(size, band, key, at) of the windows whose key is one of the catalogue's; most texts have none and end here."""
    step = WINDOWS[size]
    return F.array_compact(F.transform(minima, lambda x, i: F.when(x.isin(wanted), F.struct(F.lit(size).alias("size"), F.lit(band).alias("band"), x.alias("key"), (i * step).alias("at")))))


def literal_table(spark: SparkSession, rows: list[dict[str, Column]]) -> DataFrame:
    """A small fixed table as constants of the plan."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[v.alias(k) for k, v in r.items()]) for r in rows])))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, row, license, containment, first_word): for each row and license found, its best place (word from 0)."""
    spark = docs.sparkSession
    listed, keys = catalogue(spark, templates or TEMPLATES)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), word_array(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "row", shingle_hashes(F.col("words")).alias("h"))
    listed_bands = range(max(b for _, b in keys) + 1)
    rows = rows.select("doc_id", "row", "h", F.size("h").alias("n"), *[hashed(F.col("h"), b).alias(f"g{b}") for b in listed_bands])
    # minima of four in a row at every place; of sixteen from those, at every fourth
    four = lambda b: F.transform(f"g{b}", lambda y, i: F.least(y, *[F.get(f"g{b}", i + k) for k in (1, 2, 3)]))
    rows = rows.select("doc_id", "row", "h", "n", "g0", *[four(b).alias(f"m{b}") for b in listed_bands])
    sixteen = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(f"m{b}") - 1) / 4).cast("int")), lambda i: F.least(*[F.get(f"m{b}", 4 * (i + k)) for k in range(4)]))
    places = []
    for (size, b), listed_keys in sorted(keys.items()):
        if size == 16:
            minima = F.when(F.size(f"m{b}") > 0, sixteen(b)).otherwise(F.array().cast("array<long>"))
        elif size == 4:
            minima = F.col(f"m{b}")
        elif size == 2:
            minima = F.transform("g0", lambda y, i: F.least(y, F.get("g0", i + 1)))
        else:
            minima = F.col("g0")
        places.append(_hits(minima, size, b, sorted({k for k, _, _ in listed_keys})))
    # explode_outer, then a filter: one on the array itself would be moved down and compute everything twice
    rows = rows.withColumn("hits", F.concat(*places))
    # each hit takes along the shingles that a template around it can reach, not the whole text's
    reach = max(t["length"] + t["size"] for t in listed)
    around = F.transform("hits", lambda x: x.withField("from", F.greatest(F.lit(0), x["at"] - reach)).withField("near", F.slice("h", F.greatest(F.lit(0), x["at"] - reach) + 1, F.lit(2 * reach + 1))))
    rows = rows.select("doc_id", "row", "n", F.explode_outer(around).alias("hit")).filter("hit.key is not null")
    # as many rows as the catalogue has windows and bands
    known = F.broadcast(literal_table(spark, [{"size": F.lit(s), "band": F.lit(b), "key": F.lit(k).cast("long"), "offset": F.lit(o), "license": F.lit(name)} for (s, b), found in keys.items() for k, o, name in found]))
    met = rows.select("doc_id", "row", "n", "hit.*").join(known, ["size", "band", "key"]).select("doc_id", "row", "from", "near", "n", "size", "license", (F.col("at") - F.col("offset")).alias("begin"))
    shapes = F.broadcast(literal_table(spark, [{"license": F.lit(t["license"]), "shingles": F.array(*[F.lit(x).cast("long") for x in t["shingles"]]), "length": F.lit(t["length"])} for t in listed]))
    met = met.join(shapes, "license")
    tried = F.sequence(F.greatest(F.lit(0), F.col("begin") - F.col("size") / 2).cast("int"), F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("begin") + F.col("size") / 2)).cast("int"))
    share = lambda p: F.size(F.array_intersect(F.col("shingles"), F.slice(F.col("near"), p - F.col("from") + 1, F.col("length")))) / F.size("shingles")
    best = F.array_max(F.transform(tried, lambda p: F.struct(share(p).alias("containment"), (-p).alias("back"))))
    met = met.withColumn("best", best).filter(F.col("best.containment") >= containment)
    found = met.groupBy("row", "doc_id", "license").agg(F.max("best").alias("best"))
    return found.select("doc_id", "row", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).cast("long").alias("first_word"))


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "license", "containment", "first_word")


def oracle(templates: dict[str, str] | None = None) -> str:
    """DuckDB SQL for op1: every place of every text tried, by the words themselves."""
    listed = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in sorted((templates or TEMPLATES).items()))
    words = lambda text: f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    shingles = lambda w: f"list_transform(range(greatest(0, len({w}) - {SHINGLE - 1})), lambda i: array_to_string({w}[i + 1:i + {SHINGLE}], ' '))"
    return f"""
WITH t AS (SELECT license, {shingles('w')} AS s FROM (SELECT license, {words('text')} AS w FROM (VALUES {listed}) v(license, text))),
ts AS (SELECT license, unnest(list_distinct(s)) AS shingle FROM t), tn AS (SELECT license, len(s) AS n, len(list_distinct(s)) AS kinds FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
h AS (SELECT r, doc_id, unnest({shingles('w')}) AS shingle, generate_subscripts({shingles('w')}, 1) - 1 AS i FROM d),
m AS (SELECT r, doc_id, license, i, shingle, n, kinds FROM h JOIN ts USING (shingle) JOIN tn USING (license)),
p AS (SELECT r, doc_id, license, shingle, kinds, unnest(range(greatest(0, i - n + 1), i + 1)) AS at_word FROM m),
c AS (SELECT r, doc_id, license, at_word, count(DISTINCT shingle) / any_value(kinds) AS containment FROM p GROUP BY r, doc_id, license, at_word),
b AS (SELECT *, row_number() OVER (PARTITION BY r, license ORDER BY containment DESC, at_word) AS place FROM c WHERE containment >= {CONTAINMENT})
SELECT doc_id, license, containment, at_word AS first_word FROM b WHERE place = 1"""


OP1_SQL = oracle()
