"""Operator 5: licence scan by Dice coefficient over word bigrams.

A text is looked at whole, by paragraph (between empty lines) and by line. Each of these units is normalised (lower case, runs of anything but
a-z and 0-9 become one blank) and compared with every licence template whose size allows the threshold: with n and m distinct bigrams, Dice is at
most 2 min(n, m) / (n + m), so templates outside [t n / (2 - t), (2 - t) n / t] are pruned unseen.

Defined results: null, empty or one-word texts match nothing; equal scores go to the template that comes first by name; repeated rows give equal
rows; templates may be replaced by any list of (name, text).

Everything is a DataFrame expression over one scan; nothing is shuffled, and the templates are constants of the plan (bounded by their list).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.llm.common import documents, text_of

THRESHOLD = 0.8

#: Short licence notices in their public wording.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit-full",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)


def _bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), then), 0)


def bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), last), F.slice(words, F.lit(2), last), lambda a, b: F.concat_ws(" ", a, b)))


def matches(unit: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """(license, dice) of the templates a unit matches."""
    kinds = [(name, grams) for name, text in templates if (grams := _bigrams(text))]
    # a little slack, so that rounding prunes no exact tie
    least, most = (1 - 1e-9) * threshold / (2 - threshold), (1 + 1e-9) * (2 - threshold) / threshold
    low, high = min(len(g) for _, g in kinds) * least, max(len(g) for _, g in kinds) * most
    none = F.array().cast("array<struct<license:string,dice:double>>")

    def score(g: Column) -> Column:
        n = F.size(g)

        def one(name: str, grams: list[str]) -> Column:
            m = len(grams)
            fits = n.between(F.lit(m * least), F.lit(m * most))
            dice = F.lit(2.0) * F.size(F.array_intersect(g, F.array(*map(F.lit, grams)))) / (n + m)
            return F.when(fits, F.struct(F.lit(name).alias("license"), dice.alias("dice")))

        return F.filter(F.array(*[one(*k) for k in kinds]), lambda x: x["dice"] >= threshold)

    # a unit of so many words has at most one bigram less; repeated bigrams only lower the count
    words = F.filter(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return _let(words, lambda w: F.when(F.size(w) - 1 < low, none).otherwise(_let(bigrams(w), lambda g: F.when(F.size(g) > high, none).otherwise(score(g)))))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license and dice of the best match (null: none), licenses (all names, sorted, joined by commas), n_units that matched."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("__text"))
    units = F.array_union(F.split("__text", "\n"), F.array_union(F.split("__text", r"\n\s*\n"), F.array("__text")))
    found = F.filter(F.transform(units, lambda u: matches(u, templates, threshold)), lambda m: F.size(m) > 0)
    rows = rows.select("doc_id", found.alias("__found"))
    every = F.flatten("__found")
    best = F.get(F.array_sort(every, lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(0)), 0)
    return rows.select(
        "doc_id", best["license"].alias("license"), F.round(best["dice"], 6).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(every, lambda x: x["license"]))), ",").alias("licenses"),
        F.size("__found").cast("bigint").alias("n_units"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(n)}, [{', '.join(map(quote, g))}])" for n, t in TEMPLATES if (g := _bigrams(t)))


ORACLE_SQL = f"""WITH kinds(license, t) AS (VALUES {_values()}),
units AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(coalesce(text, ''), chr(10)),
    list_concat(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n'), [coalesce(text, '')]))) AS unit FROM documents),
words AS (SELECT doc_id, unit, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM units),
grams AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM words WHERE len(w) >= 2),
scored AS (SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice
  FROM grams, kinds),
hits AS (SELECT * FROM scored WHERE dice >= {THRESHOLD}::DOUBLE),
best AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, round(max(dice), 6) AS dice,
    array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, count(DISTINCT unit) AS n_units FROM hits GROUP BY doc_id)
SELECT d.doc_id, b.license, b.dice, coalesce(b.licenses, '') AS licenses, coalesce(b.n_units, 0) AS n_units
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id"""
