"""License scan: Dice coefficient of word bigrams against licence templates.

Units are the lines of a text and the whole text. Texts are lower-cased and every run of
characters other than letters and digits separates words. With A and B the sets of word
bigrams of a unit and a template, the score is 2|A and B| / (|A| + |B|).

Pruning loses nothing. A score of at least t needs t/(2-t) * |B| <= |A| <= (2-t)/t * |B|
(size bounds), and at least t/(2-t) * |B| common bigrams, hence one of any
|B| - ceil(t/(2-t) * |B|) + 1 bigrams of the template. A text without such a bigram of any
template is done with after one pass over its characters. All of it is one row-wise
expression: no shuffle, no join, no Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and opening clauses of public licences. Their wording is the licences' own.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
)
SEPARATOR = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Template:
    license: str
    bigrams: tuple[str, ...]

    @classmethod
    def of(cls, license: str, text: str) -> Template:
        words = re.findall(r"[^\W_]+", text.lower())
        return cls(license, tuple(dict.fromkeys(" ".join(p) for p in zip(words, words[1:]))))

    def least_common(self, threshold: float) -> int:
        return max(1, ceil(threshold / (2 - threshold) * len(self.bigrams) - 1e-9))

    def most_bigrams(self, threshold: float) -> int:
        return int((2 - threshold) / threshold * len(self.bigrams) + 1e-9)


def templates(pairs=TEMPLATES) -> list[Template]:
    found = [Template.of(*p) for p in pairs]
    if not all(t.bigrams for t in found):
        raise ValueError("a template needs at least two words")
    return found


def key_bigrams(known: list[Template], threshold: float) -> list[str]:
    """Bigrams of which every matching unit has one. Long ones are taken first: they are rarer in prose."""
    out: set[str] = set()
    for t in known:
        out.update(sorted(t.bigrams, key=lambda b: (-min(map(len, b.split())), b))[:len(t.bigrams) - t.least_common(threshold) + 1])
    return sorted(out)


def key_pattern(bigrams: list[str]) -> str:
    """One expression for all bigrams over lower-cased text, branching once per first word."""
    by_first: dict[str, list[str]] = {}
    for b in bigrams:
        first, second = b.split()
        by_first.setdefault(first, []).append(second)
    return "(?:" + "|".join(f"{a}{SEPARATOR}(?:{'|'.join(b)})" for a, b in by_first.items()) + ")"


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1),
                                        lambda i: F.concat_ws(" ", F.element_at(words, i.cast("int")), F.element_at(words, (i + 1).cast("int")))))


def license_scan(docs: DataFrame, threshold: float = 0.8, known: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``license`` of the best unit, its ``score``, ``unit`` and ``n_units`` that match.

    ``unit`` is 0 for the whole text, else the number of the line; of equal scores the first
    template, then the first unit counts. ``license`` and ``unit`` are null and ``score`` zero
    where nothing reaches the threshold.

    Defined results: null and empty texts and units of fewer than two words match nothing;
    repeated rows give equal rows; an empty table gives no rows.
    """
    known = known or templates()
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t.license).alias("license"), F.lit(len(t.bigrams)).alias("n"),
                               F.lit(t.least_common(threshold)).alias("low"), F.lit(t.most_bigrams(threshold)).alias("high"),
                               F.array(*map(F.lit, t.bigrams)).alias("bigrams")) for k, t in enumerate(known)])
    least, most = min(t.least_common(threshold) for t in known), max(t.most_bigrams(threshold) for t in known)

    def words(unit: Column) -> Column:
        return F.filter(F.split(unit, SEPARATOR), lambda w: w != "")

    def scored(unit: Column) -> Column:
        """Template matches of a unit with ``bigrams``: only templates within the size bounds are compared."""
        size = F.size(unit["bigrams"])
        return F.filter(F.transform(F.filter(table, lambda t: (size >= t["low"]) & (size <= t["high"])), lambda t: F.struct(
            F.round(2 * F.size(F.array_intersect(unit["bigrams"], t["bigrams"])) / (size + t["n"]), 6).alias("score"),
            (-t["k"]).alias("order"), (-unit["unit"]).alias("place"), t["license"].alias("license"))), lambda m: m["score"] >= threshold)

    units = F.transform(F.concat(F.array(text), F.split(text, "\n")), lambda line, i: F.struct(i.alias("unit"), words(line).alias("words")))
    # a text of one line is that line
    units = F.filter(units, lambda u: (F.size(u["words"]) > least) & ((u["unit"] > 0) | F.contains(text, F.lit("\n"))))
    paired = F.filter(F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), _bigrams(u["words"]).alias("bigrams"))),
                      lambda u: (F.size(u["bigrams"]) >= least) & (F.size(u["bigrams"]) <= most))
    per_unit = F.filter(F.transform(paired, scored), lambda m: F.size(m) > 0)
    found = F.when(F.regexp_like(text, F.lit(key_pattern(key_bigrams(known, threshold)))), per_unit)
    best = F.array_max(F.flatten("found"))
    return (docs.select(F.col(id_col).alias("id"), found.alias("found"))
            .select(F.col("id").alias(id_col), best["license"].alias("license"), F.coalesce(best["score"], F.lit(0.0)).alias("score"),
                    (-best["place"]).alias("unit"), F.coalesce(F.size("found"), F.lit(0)).alias("n_units")))


def oracle_sql(threshold: float = 0.8, known: list[Template] | None = None) -> str:
    """The same without any pruning."""
    known = known or templates()
    values = ",\n".join(f"({k}, '{t.license}', {list(t.bigrams)!r})" for k, t in enumerate(known))
    return rf"""
        WITH t(k, license, b) AS (VALUES {values}),
        u AS (SELECT doc_id, unnest(range(len(l))) AS unit, unnest(l) AS line
              FROM (SELECT doc_id, list_concat([text], string_split(text, chr(10))) AS l FROM (SELECT doc_id, lower(coalesce(text, '')) AS text FROM documents))),
        w AS (SELECT doc_id, unit, list_filter(string_split_regex(line, '{SEPARATOR}'), lambda x: x <> '') AS w FROM u
              WHERE unit > 0 OR contains(line, chr(10))),
        a AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM w WHERE len(w) > 1),
        s AS (SELECT doc_id, unit, k, license, round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS score FROM a, t),
        m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k, unit) AS r FROM s WHERE score >= {threshold}),
        n AS (SELECT doc_id, count(DISTINCT unit)::INTEGER AS n_units FROM m GROUP BY doc_id)
        SELECT d.doc_id, m.license, coalesce(m.score, 0.0) AS score, m.unit::INTEGER AS unit, coalesce(n_units, 0)::INTEGER AS n_units
        FROM documents d LEFT JOIN (SELECT * FROM m WHERE r = 1) m ON d.doc_id = m.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""
