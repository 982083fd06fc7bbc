"""Licence scans by Dice coefficient over word bigrams, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliq.llm.common import let, text_or_empty

#: Notices by which authors name a licence, from the licences' own instructions or common use.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: How full licence texts name themselves; looked for as passages, like the notices, but not as lines.
HEADS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("CC-BY-NC-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License"),
)
#: Least Dice coefficient, in thousandths.
LEAST = 800
#: Lengths of passages in quarters of the template's length.
QUARTERS = (3, 4, 5, 6)


def _normal(text: Column) -> Column:
    """Lower-cased runs of letters and digits, single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """All bigrams in order, repeated ones too."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _normal_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _py_bigrams(text: str) -> list[str]:
    words = _normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _needed(grams: int, least: int) -> int:
    """Bigrams of a template of ``grams`` that any match has: the smaller set bounds what can be shared."""
    return (least * grams + 1999 - least) // (2000 - least)


def _key_words(sets: list[list[str]], least: int) -> list[str]:
    """Words of which every match of a template has one: so many bigrams hold them that a match can't miss all."""
    keys: set[str] = set()
    for grams in sets:
        for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in keys, len(w), w), reverse=True):
            if sum(not keys.isdisjoint(g.split()) for g in grams) > len(grams) - _needed(len(grams), least):
                break
            keys.add(word)
    return sorted(keys)


def _better(acc: Column, a: Column) -> Column:
    """Largest coefficient first; of equal ones the first name."""
    return F.when((a["dice"] > acc["dice"]) | ((a["dice"] == acc["dice"]) & (a["name"] < acc["name"])), a).otherwise(acc)


def _found(dice: Column, name: Column) -> Column:
    return F.struct(dice.alias("dice"), name.alias("name"))


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", heads: tuple[tuple[str, str], ...] = HEADS) -> DataFrame:
    """Per document, the licence its text is nearest to and how many units match one.

    Units are the lines of the whole text, the text itself if it has several
    lines, and passages.  A unit matches a template if the Dice coefficient of
    their sets of word bigrams is at least ``least`` thousandths.  The nearest
    template is that of the largest coefficient, ties going to the name that
    sorts first.

    Passages are what lines don't show: a notice wrapped over lines, in the
    midst of a line, or part of a licence's full text.  They begin at each
    bigram of a template, have QUARTERS of its length, run across line breaks,
    and are compared with ``templates`` and ``heads``.  Words of a line that
    matches are its own and in no passage, and a text that matches as a whole
    has no passages.  Of passages that overlap the nearest counts.

    Columns: doc_id, license (null: none), dice_milli (int, 0: none), n_hits
    (long, matching units).  A null or empty text has no match; repeated rows
    stay; other columns are ignored; an empty table gives an empty result.  No
    shuffle: the templates, a fixed list, are literals of the plan, and units
    stay within their row.  A match has two thirds of a template's bigrams (at
    800 thousandths), so texts that have fewer of each are never cut in units.
    """
    sets = [(name, grams, len(_normal_words(body)) - 1, is_line) for part, is_line in ((templates, True), (heads, False)) for name, body in part if (grams := _py_bigrams(body))]
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(_needed(len(grams), least)).alias("needed"), F.lit(n).alias("n"), F.lit(is_line).alias("is_line")) for name, grams, n, is_line in sets))
    none = _found(F.lit(0), F.lit(""))

    def dice(grams: Column, t: Column) -> Column:
        found = (F.lit(2000) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(F.array_distinct(grams)) + F.size(t["grams"]))).cast("int")
        return F.when(found >= least, found).otherwise(0)

    def best(grams: Column) -> Column:
        return let(grams, lambda g: F.aggregate(F.filter("_rules", lambda t: t["is_line"]), none, lambda acc, t: let(dice(g, t), lambda d: _better(acc, _found(d, F.when(d > 0, t["name"]).otherwise(""))))))

    def passages(grams: Column, t: Column) -> Column:
        at = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i + 1)), lambda i: i.isNotNull())
        sizes = F.array(*(F.greatest(F.lit(1), F.floor(t["n"] * q / 4).cast("int")) for q in QUARTERS))

        def cut(i: Column, n: Column) -> Column:
            return let(F.slice(grams, i, n), lambda g: F.struct((F.lit(0) - dice(g, t)).alias("rank"), i.alias("first"), (i + F.size(g)).alias("last"), t["name"].alias("name")))

        return F.filter(F.flatten(F.transform(at, lambda i: F.transform(sizes, lambda n: cut(i, n)))), lambda p: p["rank"] < 0)

    plain = docs.select(docs[doc_id].alias("doc_id"), text_or_empty(docs[text]).alias("_t"))
    lower = F.lower("_t")
    keys = _key_words([grams for _, grams, _, _ in sets], least)
    #: Short keys are parts of many words, so they must stand alone.
    short = "|".join(key for key in keys if len(key) < 4)
    keyed = let(lower, lambda x: F.exists(F.array(*(F.lit(key) for key in keys if len(key) > 3)).cast("array<string>"), lambda key: F.contains(x, key)) | (x.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{short})(?![\p{{L}}\p{{N}}])") if short else F.lit(False)))
    plain = plain.withColumn("_grams", F.when(keyed, _bigrams(_words(_normal(F.col("_t"))))))
    plain = plain.withColumn("_rules", F.when(F.col("_grams").isNotNull(), let(F.array_distinct("_grams"), lambda g: F.filter(rules, lambda t: F.size(F.array_intersect(g, t["grams"])) >= t["needed"]))))
    some = F.coalesce(F.size("_rules") > 0, F.lit(False))
    plain = plain.withColumn("_lines", F.when(some, F.transform(F.split("_t", "\n"), lambda x: _words(_normal(x)))))
    plain = plain.withColumn("_by_line", F.transform("_lines", lambda x: best(_bigrams(x))))
    plain = plain.withColumn("_whole", F.when(some & (F.size("_lines") > 1), best(F.col("_grams"))).otherwise(none))
    left = F.flatten(F.zip_with("_lines", "_by_line", lambda x, hit: F.when(hit["dice"] > 0, F.array(F.lit("\n"))).otherwise(x)))
    plain = plain.withColumn("_passages", F.when(some & (F.col("_whole.dice") == 0), let(_bigrams(left), lambda g: F.array_sort(F.flatten(F.transform("_rules", lambda t: passages(g, t)))))))
    #: The nearest first; of those that overlap only the first stays.
    taken = F.aggregate("_passages", F.array().cast("array<struct<rank:int,first:int,last:int,name:string>>"), lambda acc, p: F.when(F.exists(acc, lambda q: (q["first"] <= p["last"]) & (p["first"] <= q["last"])), acc).otherwise(F.concat(acc, F.array(p))))
    plain = plain.withColumn("_hits", F.when(some, F.filter(F.concat("_by_line", F.array("_whole"), F.coalesce(F.transform(taken, lambda p: _found(F.lit(0) - p["rank"], p["name"])), F.array().cast("array<struct<dice:int,name:string>>"))), lambda x: x["dice"] > 0)))
    top = F.when(some, F.aggregate("_hits", none, _better)).otherwise(none)
    scored = plain.select("doc_id", top.alias("_top"), F.when(some, F.size("_hits")).otherwise(0).alias("_n"))
    return scored.select("doc_id", F.when(F.col("_top.dice") > 0, F.col("_top.name")).alias("license"), F.col("_top.dice").alias("dice_milli"), F.col("_n").cast("long").alias("n_hits"))


def _oracle() -> str:
    rows = ", ".join("({}, [{}])".format(f"'{name}'", ", ".join("'" + g.replace("'", "''") + "'" for g in _py_bigrams(body))) for name, body in TEMPLATES)
    return rf"""
WITH t(name, grams) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT r, unnest(CASE WHEN contains(t, chr(10)) THEN list_append(string_split(t, chr(10)), t) ELSE [t] END) AS unit FROM d),
n AS (SELECT r, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM u),
g AS (SELECT r, row_number() OVER () AS k, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM n WHERE len(ws) > 1),
s AS (SELECT r, k, name, (2000 * len(list_intersect(g.grams, t.grams))) // (len(g.grams) + len(t.grams)) AS dice FROM g JOIN t
      ON 2000 * least(len(g.grams), len(t.grams)) >= {LEAST} * (len(g.grams) + len(t.grams))),
h AS (SELECT r, k, dice, name FROM s WHERE dice >= {LEAST}),
b AS (SELECT r, count(DISTINCT k) AS n_hits, max(dice) AS dice FROM h GROUP BY r),
x AS (SELECT b.r, b.n_hits, b.dice, min(h.name) AS name FROM b JOIN h ON h.r = b.r AND h.dice = b.dice GROUP BY ALL)
SELECT d.doc_id, x.name AS license, CAST(coalesce(x.dice, 0) AS INT) AS dice_milli, CAST(coalesce(x.n_hits, 0) AS BIGINT) AS n_hits FROM d LEFT JOIN x USING (r)
"""


ORACLE = _oracle()
