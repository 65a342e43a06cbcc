"""License scan: text units compared with licence templates by the Dice coefficient of word bigrams.

Units of a text are its sentences, its lines and its paragraphs. A unit is
lower-cased, everything but letters a-z and digits becomes a blank, and its set of
word bigrams is compared with each template's: 2 * common / (size + size). Only
templates are compared whose size allows the threshold t: between t / (2 - t)
and (2 - t) / t times the unit's. All steps are Spark expressions.

The signs that open the lines of a comment go first. A template that names its licence's version names it of units
only that have the version too, else the licence without a version.

Before that, texts and units without any gate word are passed over. This loses nothing: gate_is_sound()
proves for each template that a unit which reaches t shares a bigram with a
gate word in it.

Edge cases: a null or empty text has no units and so no licence; very long texts are cut into all their units, of which
those too large for every template are passed over; an empty table gives no rows; units of one
word are one bigram of their own; ties go to the template that sorts first; rows
that share an id stay rows of their own; extra columns are left out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.runtime import prepare

THRESHOLD = 0.8
# Public licence notices, and words of which each has some.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Licensed under the BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
GATE = ("licens", "permi", "distribut", "software", "version", "apache", "applicable", "conditions", "released", "without", "documentation", "furnished", "obtaining", "general", "notice", "subject", "mozilla", "source", "cc", "creative", "unencumbered", "publi")

# What stands before the text of a line in a comment; it goes first, so that a comment's empty lines part paragraphs.
COMMENT = r"(^|\n)[ \t]*(?:/\*+|\*+/?|//+|#+|;+|%+|--+|<!--)[ \t]*"
SENTENCE = r"[.!?:;]+\s+|\n+"
LINE = r"\n+"
PARAGRAPH = r"\n[ \t\r]*\n\s*"


def bigrams_of(text: str) -> list[str]:
    """The bigram set of a text, as the Spark expressions below build it."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({" ".join(p) for p in zip(words, words[1:])} or set(words))


def versions(name: str, text: str) -> list[str]:
    """The bigrams of a template that name its licence's version, if it names one: a unit without them is of no version we know."""
    number = re.search(r"-(\d+)(?:\.\d+)?$", name)
    return [b for b in bigrams_of(text) if number and b.split()[-1] == number[1]]


def without_version(name: str) -> str:
    return re.sub(r"-\d+(\.\d+)?$", "", name)


def least_size(size: int, t: float) -> int:
    return math.ceil(size * t / (2 - t) - 1e-9)


def gate_is_sound(t: float) -> bool:
    """Whether no unit can reach t with a template through bigrams without a gate word alone."""
    for _, text in TEMPLATES:
        bigrams = bigrams_of(text)
        without = [b for b in bigrams if not any(g in b for g in GATE)]
        if len(without) >= t / 2 * (len(bigrams) + least_size(len(bigrams), t)):
            return False
    return True


def _gated(text: Column) -> Column:
    found = F.contains(text, F.lit(GATE[0]))
    for word in GATE[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def scan(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, license, score, n_units), one for each row of docs: the licence of the best unit,
    its Dice coefficient, and how many different units reach the threshold. Without any: null, 0 and 0."""
    spark = prepare(docs.sparkSession)
    if not gate_is_sound(threshold):
        raise ValueError("the gate words are not enough for this threshold")
    templates = [(name, bigrams_of(t), versions(name, t)) for name, t in TEMPLATES]
    low = F.regexp_replace(F.lower(F.col(text)), COMMENT, "$1")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.when(_gated(F.lower(F.col(text))), low).alias("low"))
    units = F.array_distinct(F.concat(*[F.split("low", p) for p in (SENTENCE, LINE, PARAGRAPH)]))
    units = F.filter(units, _gated)
    # Words as a list, then bigrams; the largest template bounds the units that are looked at further.
    longest = max(len(b) for _, b, _ in templates)
    words = F.transform(units, lambda u: F.filter(F.split(F.regexp_replace(u, "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    sets = F.array_distinct(F.transform(words, _bigrams))
    sets = F.filter(sets, lambda b: (F.size(b) > 0) & (F.size(b) * threshold / (2 - threshold) <= longest + 1e-9))
    rows = rows.select("doc_id", sets.alias("sets"))

    def dice(unit: Column) -> Column:
        """The best (score, licence) of a unit, as a struct whose greatest is the best."""
        each = []
        for place, (name, bigrams, marks) in enumerate(sorted(templates, reverse=True)):
            size, n = F.size(unit), len(bigrams)
            named = F.lit(name)
            for mark in marks:
                named = F.when(F.array_contains(unit, mark), named).otherwise(F.lit(without_version(name)))
            common = F.size(F.array_intersect(unit, F.array(*[F.lit(b) for b in bigrams])))
            score = F.when((size >= n * threshold / (2 - threshold) - 1e-9) & (size <= n * (2 - threshold) / threshold + 1e-9), 2.0 * common / (size + n)).otherwise(0.0)
            each.append(F.struct(score.alias("score"), F.lit(place).alias("place"), named.alias("license")))
        return F.array_max(F.array(*each))

    found = F.filter(F.transform("sets", dice), lambda b: b["score"] >= threshold - 1e-12)
    best = F.array_max("found")
    out = rows.select("doc_id", F.coalesce(found, F.array().cast("array<struct<score:double,place:int,license:string>>")).alias("found"))
    return out.select("doc_id", best["license"].alias("license"), F.coalesce(best["score"], F.lit(0.0)).alias("score"), F.size("found").cast("long").alias("n_units"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, without gate and size bounds, over the view documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda words: f"[{', '.join(map(quote, words))}]::VARCHAR[]"
    values = ", ".join(f"({place}, {quote(name)}, {quote(without_version(name))}, {listed(bigrams)}, {listed(marks)})" for place, (name, bigrams, marks) in enumerate(sorted(((n, bigrams_of(t), versions(n, t)) for n, t in TEMPLATES), reverse=True)))
    plain = f"regexp_replace(lower(text), {quote(COMMENT)}, '\\1', 'g')"
    pieces = " UNION ".join(f"SELECT doc_id, unnest(regexp_split_to_array({plain}, {quote(p)})) AS u FROM documents" for p in (SENTENCE, LINE, PARAGRAPH))
    return f"""
WITH t(place, named, unversioned, bigrams, marks) AS (VALUES {values}),
units AS (SELECT DISTINCT doc_id, u FROM ({pieces})),
words AS (SELECT doc_id, list_filter(string_split(regexp_replace(u, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM units),
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) > 1 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE w END AS b FROM words WHERE len(w) > 0),
scored AS (SELECT doc_id, b, CASE WHEN len(list_intersect(b, marks)) = len(marks) THEN named ELSE unversioned END AS license, place, 2.0::DOUBLE * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS score FROM sets, t),
best AS (SELECT doc_id, b, arg_max(license, (score, place)) AS license, max(score) AS score, max((score, place)) AS top FROM scored WHERE score >= {threshold} - 1e-12 GROUP BY doc_id, b),
found AS (SELECT doc_id, arg_max(license, top) AS license, max(score) AS score, count(*) AS n_units FROM best GROUP BY doc_id)
SELECT d.doc_id, license, round(coalesce(score, 0.0), 6) AS score, coalesce(n_units, 0) AS n_units FROM documents d LEFT JOIN found USING (doc_id)
"""
