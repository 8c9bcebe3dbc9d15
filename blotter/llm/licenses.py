"""License scans by Dice coefficient over word bigrams. DataFrame functions only.

Units of a document are its lines, and the whole text where it has several.
A unit is normalised to lower-case runs of letters and digits and becomes the
set of its word bigrams; so do the license templates. With n and t bigrams,

    dice = 2 common / (n + t) <= 2 min(n, t) / (n + t),

so a template can only reach ``threshold`` for n from t * th / (2 - th) to
t * (2 - th) / th: these size bounds prune the candidate templates before any
set is intersected. Units of fewer words, or of more different words, than any
template allows never get bigrams at all. Everything is in the document's own row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
TOKEN = "[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices and short texts of public licenses, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams(text: str) -> list[str]:
    """Different word bigrams of a template, in order."""
    ws = re.findall(TOKEN, text.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(ws, ws[1:])))


def bounds(t: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams with which a unit can reach the threshold."""
    return math.ceil(t * threshold / (2 - threshold) - 1e-9), math.floor(t * (2 - threshold) / threshold + 1e-9)


def matches(text: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """``array<struct<dice, license>>`` of all pairs of a unit and a template that reach the threshold."""
    sets = [(name, bigrams(body)) for name, body in templates]
    least, most = min(bounds(len(s), threshold)[0] for _, s in sets), max(bounds(len(s), threshold)[1] for _, s in sets)
    lines = F.split(text, "\n", -1)
    units = F.transform(F.when(F.contains(text, F.lit("\n")), F.concat(lines, F.array(text))).otherwise(lines),
                        lambda u: F.regexp_extract_all(F.translate(u, UPPER, LOWER), F.lit(TOKEN), F.lit(0)))
    sized = F.filter(units, lambda w: (F.size(w) > max(least, 1)) & (F.size(F.array_distinct(w)) <= most + 1))
    grams = F.transform(sized, lambda w: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))))

    def compared(g: Column) -> Column:
        out = []
        for name, s in sets:
            low, high = bounds(len(s), threshold)
            dice = 2.0 * F.size(F.array_intersect(g, F.array(*map(F.lit, s)))) / (F.size(g) + len(s))
            out.append(F.when(F.size(g).between(low, high), F.struct(dice.alias("dice"), F.lit(name).alias("license"))))
        return F.filter(F.array(*out), lambda x: F.coalesce(x["dice"] >= threshold, F.lit(False)))
    return F.flatten(F.transform(grams, compared))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, ``n_matches`` (pairs of a unit and a template),
    ``licenses`` (different ones, sorted, comma-joined), ``best_license`` and
    ``best_dice``; ties go to the name that sorts first.

    Null and empty texts, and templates and units of fewer than two words, match
    nothing: 0, an empty string, null and 0.0. Repeated rows give repeated rows;
    an empty table an empty result; other columns are ignored.
    """
    usable = [t for t in templates if bigrams(t[1])]
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = F.expr("cast(array() as array<struct<dice: double, license: string>>)")
    found = found.select("id", (matches(F.col("t"), usable, threshold) if usable else none).alias("m"))
    top = F.array_max("m.dice")
    found = found.select("id", "m", top.alias("top"))
    return found.select(
        F.col("id").alias(id_col), F.size("m").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("m.license")), ",").alias("licenses"),
        F.array_min(F.transform(F.filter("m", lambda x: x["dice"] == F.col("top")), lambda x: x["license"])).alias("best_license"),
        F.coalesce("top", F.lit(0.0)).alias("best_dice"))


def sql() -> str:
    """The query in DuckDB's SQL."""
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(g) for g in bigrams(body))}])" for i, (name, body) in enumerate(TEMPLATES))
    return rf"""
WITH templates(k, license, tg) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
units AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS u FROM docs
  UNION ALL SELECT rid, t FROM docs WHERE contains(t, chr(10))),
words AS (SELECT rid, row_number() OVER () AS uid, regexp_extract_all(translate(u, '{UPPER}', '{LOWER}'), '{TOKEN}') AS w FROM units),
grams AS (
  SELECT rid, uid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words
  WHERE len(w) BETWEEN 2 AND 100000),
dices AS (
  SELECT rid, license, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice
  FROM grams, templates WHERE 2.0 * least(len(g), len(tg)) / (len(g) + len(tg)) >= {THRESHOLD} - 1e-9),
hits AS (SELECT * FROM dices WHERE dice >= {THRESHOLD}),
best AS (
  SELECT rid, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best_dice,
         arg_min(license, (-dice, license)) AS best_license
  FROM hits GROUP BY rid)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, coalesce(best_dice, 0.0::DOUBLE) AS best_dice
FROM docs LEFT JOIN best USING (rid)
"""
