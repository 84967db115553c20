"""Licence scans: Dice coefficient over word bigrams against licence templates, in SQL functions only.

A text is compared unit by unit: each line, and each paragraph of several lines. A unit is
normalised (A-Z lower-cased, everything but letters, digits and non-ASCII characters a
blank), its distinct word bigrams are compared with those of a template, and the pair
counts from THRESHOLD on. Two sets of a and b bigrams can reach a Dice coefficient t only if
a lies between b t / (2 - t) and b (2 - t) / t; so a unit's size alone rules most templates
out before any bigram is looked at. A document is one row in and one row out: no shuffle.

Defined results: null and empty texts, and units of fewer than two words, match nothing;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.75

# Short notices and standard notice paragraphs of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def template_bigrams(text: str) -> list[str]:
    words = [w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", text.translate(str.maketrans(UPPER, LOWER))) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and largest number of bigrams of a unit that can reach the threshold with a template of so many."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def units(text: Column) -> Column:
    """Lines, and paragraphs of more than one line."""
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    return F.concat(F.split(text, "\n"), F.when(text.contains("\n"), paragraphs).otherwise(F.array().cast("array<string>")))


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """docs with matches: for each unit and template that reaches the threshold, its licence, template number and dice."""
    sets = [template_bigrams(t) for _, t in templates]
    bounds = [size_bounds(len(s), threshold) for s in sets]
    least, most_words = max(2, min(b[0] for b in bounds) + 1), max(b[1] for b in bounds)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("matches", "_u", "_w", "_b")]
    lowered = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER)
    one = docs.select(*kept, units(lowered).alias("_u"))
    two = one.select(*kept, F.transform("_u", lambda u: F.split(F.trim(F.regexp_replace(u, NOT_WORD, " ")), " ")).alias("_w"))
    three = two.select(*kept, F.transform(F.filter("_w", lambda w: F.size(w) >= least), _bigrams).alias("_b"))

    def compare(bigrams: Column) -> Column:
        found = []
        for k, ((licence, _), grams, (low, high)) in enumerate(zip(templates, sets, bounds)):
            shared = F.size(F.array_intersect(bigrams, F.array(*map(F.lit, grams))))
            dice = F.lit(2.0) * shared / (F.size(bigrams) + len(grams))
            row = F.struct(F.lit(licence).alias("licence"), F.lit(k).alias("template"), dice.alias("dice"))
            found.append(F.when(F.size(bigrams).between(low, high), row))
        return F.filter(F.array(*found), lambda r: r.isNotNull() & (r["dice"] >= threshold))

    sized = F.filter("_b", lambda b: F.size(b) <= most_words)
    return three.select(*kept, F.flatten(F.transform(sized, compare)).alias("matches"))


def verdicts(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row a document: licences (sorted, comma-joined), n_matches, best_licence and best_dice (ties to the licence of the earlier template)."""
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), (-m["template"]).alias("order"), m["licence"].alias("licence"))))
    return scanned.select(
        F.col(doc_id),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",").alias("licences"),
        F.size("matches").cast("long").alias("n_matches"),
        best["licence"].alias("best_licence"),
        F.round(best["dice"], 6).alias("best_dice"),
    )


def oracle(threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same as DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n  ".join(f"({k}, {quoted(licence)}, {quoted(text)})" for k, (licence, text) in enumerate(templates))
    words = lambda t: f"string_split(trim(regexp_replace(translate({t}, '{UPPER}', '{LOWER}'), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' '), ' ')"
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
    return f"""
WITH templates(template, licence, text) AS (VALUES
  {rows}),
t AS (SELECT template, licence, {pairs} AS grams FROM (SELECT template, licence, {words("text")} AS w FROM templates)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT r, unnest(list_concat(string_split(text, chr(10)), [p FOR p IN regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') IF contains(p, chr(10))])) AS unit FROM d),
b AS (SELECT r, row_number() OVER () AS k, {pairs} AS grams FROM (SELECT r, {words("unit")} AS w FROM u) WHERE len(w) >= 2),
p AS (
  SELECT b.r, b.k, t.template, t.licence, 2.0 * len(list_intersect(b.grams, t.grams)) / (len(b.grams) + len(t.grams)) AS dice
  FROM b JOIN t ON len(b.grams) BETWEEN len(t.grams) * {threshold} / (2 - {threshold}) - 1e-9 AND len(t.grams) * (2 - {threshold}) / {threshold} + 1e-9),
m AS (
  SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) AS n, arg_max(licence, (dice, -template)) AS best, max(dice) AS dice
  FROM p WHERE dice >= {threshold} GROUP BY r)
SELECT doc_id, coalesce(licences, '') AS licences, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, best AS best_licence, round(dice, 6) AS best_dice
FROM d LEFT JOIN m USING (r)
"""
