"""Operator 9: licence notices by Dice coefficient over word bigrams. DataFrame functions only.

A text's lines, and the whole text, are normalised (lower case, everything but letters and digits a space) and compared
with every notice whose size allows the threshold: with a and b distinct bigrams the coefficient is at most
2 min(a, b) / (a + b), so other templates are not looked at. The best template above the threshold is the line's licence.

Notices wrapped over lines, or inside a longer line, are found by windows over the words of the whole text, compared with
the notices and with the full licence texts of license_texts. Only a template with enough of its bigrams in the text is
looked at. A window starts where a run of shared bigrams starts (a start inside a run is never better), is up to once or
one and a half times the template long, and ends at its last shared bigram. Of overlapping windows the one of the highest
Dice times shared bigrams stays. A line's match stands for windows inside that line; of a match and a window over several
lines the higher score stays.

Everything is projections: no shuffle. A row's work is linear in its text, and where a template is nearly whole in the
text also in that template's size for each run.

Cases: a null or empty text has no licence; a line of one word has no bigram and matches nothing; texts of any length
are compared whole; ties go to the first template by name; repeated rows are treated alike; an empty table gives no
rows; other columns, whatever their names, are untouched.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices of public licences, as their authors ask for them or as they are commonly shortened.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


#: Windows have at most the length of their template, and this many times that: the threshold lets two fifths of its bigrams be others'.
REACH = 1.5


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Licence and full text of the files beside this one."""
    return tuple((f.stem, f.read_text()) for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt")))


def normal_words(text: str) -> list[str]:
    """Words of a normalised text (ASCII letters and digits)."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_grams(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """Licence and sorted distinct word bigrams of each template, in order of name and text."""
    out = []
    for name, text in sorted(templates):
        w = normal_words(text)
        out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return out


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))
    words = F.split(norm, " ")
    # the words are named once: a one-element transform binds them
    return F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
        ),
    )[0]


def best_license(grams: Column, threshold: float = THRESHOLD, templates=TEMPLATES) -> Column:
    """Struct (dice, license, size of both sets) of the best template for a set of bigrams, or null."""
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("n"), F.array(*[F.lit(x) for x in g]).alias("g")) for name, g in template_grams(templates)])

    def match(g: Column) -> Column:
        # 2 min(a, b) >= t (a + b) in whole numbers: both sides times 1000
        t = round(threshold * 1000)
        fit = F.filter(known, lambda k: 2000 * F.least(k["n"], F.size(g)) >= t * (k["n"] + F.size(g)))
        dice = F.transform(fit, lambda k: F.struct((2e0 * F.size(F.array_intersect(k["g"], g)) / (k["n"] + F.size(g))).alias("dice"), k["license"].alias("license"), (k["n"] + F.size(g)).alias("both")))
        return F.aggregate(
            F.filter(dice, lambda d: d["dice"] >= threshold),
            F.lit(None).cast("struct<dice:double,license:string,both:int>"),
            lambda best, d: F.when(best.isNull() | (d["dice"] > best["dice"]), d).otherwise(best),
        )

    return F.transform(F.array(grams), lambda g: F.when(F.size(g) > 0, match(g)))[0]


def bigram_list(text: Column) -> Column:
    """Word bigrams of a normalised text, in order and with repeats."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))
    return F.transform(
        F.array(F.split(norm, " ")),
        lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))),
    )[0]


#: Size of the table of marks.
MARKS = 1 << 18


def marks(grams) -> bytearray:
    """A byte per place: 1 where the checksum of any of the bigrams falls. What it marks falsely is left out after."""
    out = bytearray(b"0" * MARKS)
    for g in grams:
        out[zlib.crc32(g.encode()) % MARKS] = 49
    return out


def _among(grams: list[str]) -> str:
    return f"x.b IN ({', '.join(repr(g) for g in grams)})"


WINDOW = "struct<rank:double,k:int,a:int,b:int,license:string,dice:double>"


def windows(found: Column) -> Column:
    """Windows (rank, k, first and last bigram, license, dice) over the threshold, of structs of a template and the places of its bigrams."""

    def measured(t: Column, s: Column, reach: Column) -> Column:
        inside = F.filter(F.slice(t["p"], s["j"] + 1, t["far"]), lambda y: y["i"] < s["i"] + reach)

        def window(q: Column) -> Column:
            last = F.element_at(q, -1)["i"]
            size = F.size(F.array_distinct(F.slice("bg", s["i"] + 1, last - s["i"] + 1)))
            return F.struct(F.size(F.array_distinct(q["b"])).alias("s"), size.alias("d"), s["i"].alias("a"), last.alias("b"))

        return F.transform(F.array(inside), window)[0]

    def of_template(t: Column) -> Column:
        starts = F.filter(
            F.transform(t["p"], lambda x, j: F.struct(x["i"].alias("i"), j.alias("j"))),
            lambda s: ((s["j"] == 0) | (s["j"] % t["need"] == 0) | (F.get(t["p"], F.greatest(s["j"] - 1, F.lit(0)))["i"] < s["i"] - 1)) & (F.get(t["p"], s["j"] + t["need"] - 1)["i"] < s["i"] + t["far"]),
        )
        sized = F.flatten(F.transform(starts, lambda s: F.transform(F.array(t["length"], t["far"]), lambda reach: measured(t, s, reach))))
        dice = F.transform(sized, lambda w: F.struct((2e0 * w["s"] / (t["n"] + w["d"])).alias("dice"), w.alias("w")))
        return F.transform(
            F.filter(dice, lambda x: x["dice"] >= t["least"]),
            lambda x: F.struct((-x["dice"] * x["w"]["s"]).alias("rank"), t["k"].alias("k"), x["w"]["a"].alias("a"), x["w"]["b"].alias("b"), t["license"].alias("license"), x["dice"].alias("dice")),
        )

    return F.flatten(F.transform(found, of_template)).cast(f"array<{WINDOW}>")


def fewest(n: int, threshold: float) -> int:
    """Bigrams that a set must share with one of n bigrams to reach the threshold."""
    return max(1, math.ceil(threshold * n / (2 - threshold) - 1e-9))


def line_of(sizes: Column, word: Column) -> Column:
    """Number of the line that holds a word, from the lines' numbers of words."""
    start = F.struct(word.cast("int").alias("left"), F.lit(0).alias("line"), F.lit(False).alias("there"))
    return F.aggregate(
        sizes,
        start,
        lambda at, n: F.when(at["there"] | (at["left"] < n), F.struct(at["left"].alias("left"), at["line"].alias("line"), F.lit(True).alias("there"))).otherwise(
            F.struct((at["left"] - n).alias("left"), (at["line"] + 1).alias("line"), F.lit(False).alias("there"))
        ),
        lambda at: at["line"],
    )


HIT = "struct<line:int,dice:double,license:string>"


def license_scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, n_notices, license, dice, line): the notices of each document and the best of them.

    line: 0-based number of the best line, or of the line where the best window starts, or -1 if it is the whole text of
    several lines; null without a notice.
    """
    known = template_grams()
    lengths = [len(normal_words(text)) - 1 for _, text in sorted(TEMPLATES)]
    notices = len(known)
    known = known + [x for t in full_texts() for x in template_grams((t,))]
    lengths += [len(normal_words(text)) - 1 for _, text in full_texts()]

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"), bigram_list(text).alias("bg"))
    pairs = "transform(bg, (b, i) -> named_struct('i', i, 'b', b))"
    union = sorted({g for _, grams in known[:notices] for g in grams})
    marked = F.filter(F.expr(pairs), lambda x: F.substring(F.lit(marks(g for _, grams in known[notices:] for g in grams)), (F.crc32(x["b"].cast("binary")) % MARKS + 1).cast("int"), F.lit(1)) == F.lit(bytearray(b"1")))
    rows = rows.select("doc_id", "t", "bg", F.expr(f"filter({pairs}, x -> {_among(union)})").alias("h"), marked.alias("f"))
    places = []
    for k, (_, g) in enumerate(known):
        need = fewest(len(g), threshold)
        if k < notices:
            place = f"CASE WHEN size(h) >= {need} THEN filter(h, x -> {_among(g)}) ELSE array() END"
        else:
            # the split of a literal is folded to one literal array
            common = f"array_intersect(transform(f, x -> x.b), split('{'|'.join(g)}', '[|]'))"
            place = f"CASE WHEN size(f) >= {need} THEN transform(array({common}), c -> CASE WHEN size(c) >= {need} THEN filter(f, x -> array_contains(c, x.b)) ELSE array() END)[0] ELSE array() END"
        places.append(F.expr(place).alias(f"p{k}"))
    rows = rows.select("doc_id", "t", "bg", *places)
    held = []
    for k, (name, g) in enumerate(known):
        fixed = {"k": k, "n": len(g), "length": lengths[k], "far": math.ceil(REACH * lengths[k]), "need": fewest(len(g), threshold), "least": float(threshold), "license": name}
        held.append(F.struct(*[F.lit(x).alias(c) for c, x in fixed.items()], F.col(f"p{k}").alias("p")))
    rows = rows.select("doc_id", "t", "bg", F.filter(F.array(*held), lambda x: F.size(x["p"]) >= x["need"]).alias("held"))
    # a line, or the whole text, reaches the threshold only if the text holds enough of a notice's bigrams
    may = F.exists("held", lambda x: x["k"] < notices)
    wins = F.array_sort(windows(F.col("held")))
    apart = F.aggregate(
        wins,
        F.array().cast(f"array<{WINDOW}>"),
        lambda kept, x: F.when(F.exists(kept, lambda y: (x["a"] <= y["b"]) & (y["a"] <= x["b"])), kept).otherwise(F.concat(kept, F.array(x))),
    )
    rows = rows.select("doc_id", "t", F.split("t", "\n").alias("lines"), may.alias("may"), apart.alias("wins"))

    whole = F.when(F.size("lines") > 1, F.array(F.struct(F.lit(-1).alias("line"), bigrams(F.col("t")).alias("g")))).otherwise(F.array().cast("array<struct<line:int,g:array<string>>>"))
    most = max(len(g) for _, g in known[:notices])
    least = min(len(g) for _, g in known[:notices])
    low, high = threshold / (2 - threshold) * least, (2 - threshold) / threshold * most
    cells = F.concat(F.transform("lines", lambda x, i: F.struct(i.alias("line"), bigrams(x).alias("g"))), whole)
    hits = F.filter(
        F.transform(F.filter(cells, lambda x: F.size(x["g"]).between(int(low), int(high) + 1)), lambda x: F.struct(x["line"].alias("line"), best_license(x["g"], threshold).alias("m"))),
        lambda h: h["m"].isNotNull(),
    )
    none = F.array().cast("array<struct<line:int,m:struct<dice:double,license:string,both:int>>>")
    sizes = F.transform("lines", lambda x: F.size(F.filter(F.split(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "), " "), lambda w: w != "")))
    placed = F.transform(
        F.array(sizes),
        lambda n: F.transform("wins", lambda w: F.struct(line_of(n, w["a"]).alias("line"), line_of(n, w["b"] + 1).alias("to"), (-w["rank"]).alias("rank"), w["dice"].alias("dice"), w["license"].alias("license"))),
    )[0]
    at = "array<struct<line:int,to:int,rank:double,dice:double,license:string>>"
    rows = rows.select("doc_id", F.when(F.col("may"), hits).otherwise(none).alias("hits"), F.when(F.size("wins") > 0, placed).otherwise(F.array()).cast(at).alias("wins"))

    def rank(h: Column) -> Column:
        return h["m"]["dice"] * h["m"]["dice"] * h["m"]["both"] / 2

    def meet(h: Column, w: Column) -> Column:
        return (h["line"] < 0) | h["line"].between(w["line"], w["to"])

    # what a line's match and a window share goes to the higher score; a line's match also stands for windows inside it
    over = F.filter("wins", lambda w: ~F.exists("hits", lambda h: meet(h, w) & ((rank(h) >= w["rank"]) | ((h["line"] == w["line"]) & (w["line"] == w["to"])))))
    rows = rows.select("doc_id", "hits", over.alias("wins"))
    left = F.filter("hits", lambda h: ~F.exists("wins", lambda w: meet(h, w) & (rank(h) < w["rank"])))
    lines = F.transform(left, lambda h: F.struct(h["line"].alias("line"), h["m"]["dice"].alias("dice"), h["m"]["license"].alias("license")))
    spans = F.array_sort(F.transform("wins", lambda w: F.struct(w["line"].alias("line"), w["dice"].alias("dice"), w["license"].alias("license"))))
    rows = rows.select("doc_id", F.concat(lines.cast(f"array<{HIT}>"), spans.cast(f"array<{HIT}>")).alias("found"))
    first = F.aggregate("found", F.lit(None).cast(HIT), lambda best, h: F.when(best.isNull() | (h["dice"] > best["dice"]), h).otherwise(best))
    return rows.select("doc_id", F.size("found").cast("bigint").alias("n_notices"), first.alias("b")).select("doc_id", "n_notices", F.col("b.license").alias("license"), F.col("b.dice").alias("dice"), F.col("b.line").cast("bigint").alias("line"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB SQL."""
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(x) for x in g)}])" for i, (name, g) in enumerate(template_grams()))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS v(k, license, g)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
cells AS (
  SELECT r, i - 1 AS line, ls[i] AS x FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT r, string_split(x, chr(10)) AS ls FROM d))
  UNION ALL SELECT r, -1, x FROM d WHERE contains(x, chr(10))
), w AS (
  SELECT r, line, string_split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM cells
), g AS (
  SELECT r, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1
), m AS (
  SELECT r, line, license, k, 2e0 * len(list_intersect(t.g, g.g)) / (len(t.g) + len(g.g)) AS dice
  FROM g JOIN t ON 2000 * least(len(t.g), len(g.g)) >= {round(threshold * 1000)} * (len(t.g) + len(g.g))
), best AS (
  SELECT r, line, license, dice FROM m WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY dice DESC, k) = 1
), doc AS (
  SELECT r, count(*) OVER (PARTITION BY r) AS n, license, dice, line FROM best
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, CASE WHEN line < 0 THEN 1 ELSE 0 END, line) = 1
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, license, dice, CAST(line AS BIGINT) AS line
FROM d LEFT JOIN doc USING (r)
"""
