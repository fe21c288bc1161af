"""Licence recognition by sentence rules.

Normalised sentences that are known from licence texts and notices map to identifiers; a document's identifier
sequence is matched against ordered rules, each match consuming its sentences, so that a whole licence text isn't
also reported by a shorter notice inside it.

A text is cut into units at sentence ends and at line ends. A known sentence may be any run of units, as texts are
wrapped and sentences hold inner marks: what starts at a unit meets the known sentences in a join on the hash of its
first words, and the whole sentence confirms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

# Sentences of licence notices and texts; the key is the sentence's identifier.
SENTENCES = {
    1: "Released under the MIT License.",
    2: "Licensed under the MIT License.",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    5: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    6: "Licensed under the Apache License, Version 2.0.",
    7: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    8: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    9: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    10: "See the License for the specific language governing permissions and limitations under the License.",
    11: "This work is licensed under the GNU General Public License, version 3.",
    12: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    13: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    14: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    15: "Licensed under CC BY-NC 4.0.",
    16: "Licensed under CC BY 4.0.",
    17: "Licensed under CC BY-SA 4.0.",
    18: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    19: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    20: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    21: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    22: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    23: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    24: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    25: "SPDX-License-Identifier: MIT",
    26: "SPDX-License-Identifier: Apache-2.0",
    27: "SPDX-License-Identifier: GPL-3.0-or-later",
    28: "SPDX-License-Identifier: BSD-3-Clause",
    29: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    30: "This work has been released into the public domain and carries no license.",
    31: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    32: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    33: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    34: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    35: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    36: "You should have received a copy of the GNU General Public License along with this program.",
    37: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    38: "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    39: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    40: "This is free and unencumbered software released into the public domain.",
    41: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    42: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    43: "This work is dedicated to the public domain under CC0 1.0 Universal.",
    44: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    45: "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    46: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    47: "Distributed under the Boost Software License, Version 1.0.",
    48: "This software is provided 'as-is', without any express or implied warranty.",
    49: "In no event will the authors be held liable for any damages arising from the use of this software.",
    50: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    51: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    52: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    53: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    55: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    56: "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    57: "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    58: "Licensed under the EUPL, Version 1.2 or later.",
    59: "Licensed under the BSD 3-Clause License.",
    60: "Licensed under the BSD 2-Clause License.",
    61: "Licensed under the ISC License.",
    62: "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    63: "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
}

# Identifiers of further SPDX tags, numbered from 101.
SPDX_TAGS = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BSD-2-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT-0", "MPL-2.0",
    "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib", "0BSD",
)
SENTENCES |= {101 + k: f"SPDX-License-Identifier: {tag}" for k, tag in enumerate(SPDX_TAGS)}

# Rules in the order in which they are tried, licence and sentence identifiers.
RULES = (
    ("MIT", (3, 4, 5, 51)),
    ("MIT", (3, 4, 5)),
    ("Apache-2.0", (7, 8, 9, 10)),
    ("BSD-3-Clause", (21, 22, 23, 24)),
    ("BSD-2-Clause", (21, 22, 23)),
    ("GPL-3.0-or-later", (12, 14)),
    ("GPL-2.0-or-later", (13, 14)),
    ("GPL-3.0-or-later", (12,)),
    ("GPL-2.0-or-later", (13,)),
    ("GPL-3.0", (11,)),
    ("Apache-2.0", (7,)),
    ("Apache-2.0", (6,)),
    ("Apache-2.0", (26,)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("MIT", (3,)),
    ("MIT", (25,)),
    ("GPL-3.0-or-later", (27,)),
    ("BSD-3-Clause", (28,)),
    ("CC-BY-NC-4.0", (15,)),
    ("CC-BY-NC-4.0", (20,)),
    ("CC-BY-SA-4.0", (17,)),
    ("CC-BY-SA-4.0", (19,)),
    ("CC-BY-4.0", (16,)),
    ("CC-BY-4.0", (18,)),
    ("MPL-2.0", (29,)),
    ("public-domain", (30,)),
    ("AGPL-3.0-or-later", (31, 14)),
    ("AGPL-3.0-or-later", (31,)),
    ("LGPL-2.1-or-later", (32,)),
    ("LGPL-3.0-or-later", (33,)),
    ("GPL-3.0-only", (34,)),
    ("GPL-2.0-only", (35,)),
    ("ISC", (37, 38)),
    ("ISC", (37,)),
    ("0BSD", (39,)),
    ("Unlicense", (40, 41)),
    ("Unlicense", (40,)),
    ("CC0-1.0", (42,)),
    ("CC0-1.0", (43,)),
    ("EPL-2.0", (44,)),
    ("EPL-1.0", (45,)),
    ("BSL-1.0", (46,)),
    ("BSL-1.0", (47,)),
    ("Zlib", (48, 49, 50)),
    ("WTFPL", (53,)),
    ("CC-BY-ND-4.0", (55,)),
    ("CC-BY-NC-SA-4.0", (56,)),
    ("CC-BY-NC-ND-4.0", (57,)),
    ("EUPL-1.2", (58,)),
    ("BSD-3-Clause", (59,)),
    ("BSD-2-Clause", (60,)),
    ("ISC", (61,)),
    ("BSD-3-Clause", (62,)),
    ("MIT", (63,)),
    *((tag, (101 + k,)) for k, tag in enumerate(SPDX_TAGS)),
)
#: Words of a known sentence's beginning whose hash it is looked up by; known sentences have as many at least.
KEY_WORDS = 3
#: Letters of a word that make a clue.
CLUE_LETTERS = 6
#: Up to so many known sentences are broadcast; a longer list joins by shuffle.
BROADCAST_SENTENCES = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_form(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip(" ")


@cache
def clues() -> tuple[str, ...]:
    """Beginnings of words such that each known sentence has one of them: a text without any holds no known sentence.
    They lie inside single words, which no wrapping changes. Greedily, those that most sentences have."""
    words = [normal_form(s).split() for s in SENTENCES.values()]
    left = [{w[:CLUE_LETTERS] for w in ws if len(w) >= CLUE_LETTERS} or {max(ws, key=len)} for ws in words]
    out: list[str] = []
    while left:
        counts = Counter(w for ws in left for w in ws)
        out.append(min(counts, key=lambda w: (-counts[w], w)))
        left = [ws for ws in left if out[-1] not in ws]
    return tuple(out)


def _units(text: Column) -> Column:
    """Normalised pieces between sentence ends and line ends, without empty ones. Sentences end after closing marks
    before white space. Numbers such as ``1)`` that begin a line aren't part of it."""
    out = F.translate(text, _UPPER, _LOWER)
    out = F.regexp_replace(out, r"(?m)^[ \t]*\(?[0-9]{1,3}\)[ \t]+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[.!?:][ \t\r\n]+|\n", "H"), "[^a-z0-9H]+", " ")
    return F.filter(F.split(F.regexp_replace(out, " *H+[ H]*", "H"), "H"), lambda u: F.trim(u) != "")


def _candidates(units: Column, first_words: list[str], most: int) -> Column:
    """What may begin a known sentence: the units from there, as ``words`` with ``|`` between units, and their places."""

    def runs(listed: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(listed)), lambda i: F.substring_index(F.get(listed, i - 1)["u"], " ", 1).isin(first_words))
        return F.transform(
            begins,
            lambda i: F.struct(
                F.array_join(F.transform(F.slice(listed, i, F.lit(most)), lambda x: x["u"]), "|").alias("words"),
                F.transform(F.slice(listed, i, F.lit(most)), lambda x: x["at"]).alias("places"),
                F.lit(None).cast("string").alias("letters"),
            ),
        )

    def of(listed: Column) -> Column:
        letters = F.transform(listed, lambda x: F.when(x["u"].rlike("[a-z]"), "1").otherwise("0"))
        head = F.struct(F.lit(None).cast("string").alias("words"), F.lit(None).cast("array<int>").alias("places"), F.array_join(letters, "").alias("letters"))
        lettered = F.filter(listed, lambda x: x["u"].rlike("[a-z]"))
        # Units without letters, such as list numbers, count and don't count.
        some = F.when(F.size(lettered) == F.size(listed), runs(listed)).otherwise(F.concat(runs(listed), runs(lettered)))
        return F.when(F.size(listed) > 0, F.concat(F.array(head), some))

    return F.element_at(F.transform(F.array(F.transform(units, lambda u, i: F.struct(F.trim(u).alias("u"), i.cast("int").alias("at")))), of), 1)


def known_frame(spark: SparkSession) -> DataFrame:
    """A row for each known sentence: its normal form, identifier and the hash of its first words."""
    df = spark.createDataFrame([(normal_form(s), i) for i, s in SENTENCES.items()], "known string, id int")
    return df.withColumn("__h", F.xxhash64(F.substring_index("known", " ", KEY_WORDS)))


def _sequences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row of ``docs``: key and ``sentence_ids``. Known sentences are taken from the text's begin on, the longest of
    those that begin at one place, none overlapping another."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    low = F.translate(whole, _UPPER, _LOWER)
    clue = F.lit(False)
    for c in clues():
        clue |= low.contains(c)
    forms = [normal_form(s) for s in SENTENCES.values()]
    first_words, most = sorted({f.split(" ")[0] for f in forms}), max(f.count(" ") + 1 for f in forms)
    rows = docs.select(F.col(key).alias("__key"), F.when(clue, _candidates(_units(whole), first_words, most)).alias("__c")).withColumn("__row", F.monotonically_increasing_id())
    begun = rows.select("__key", "__row", F.explode_outer("__c").alias("c"))
    words = F.translate("c.words", "|", " ")
    begun = begun.withColumn("__begin", F.xxhash64(F.substring_index(words, " ", KEY_WORDS)))
    known = known_frame(spark)
    met = begun.join(F.broadcast(known) if len(SENTENCES) <= BROADCAST_SENTENCES else known, F.col("__begin") == F.col("__h"), "left")
    n = F.length("known")
    after = F.substring(F.col("c.words"), n + 1, F.lit(1))
    n_units = n - F.length(F.replace(F.substring(F.col("c.words"), F.lit(1), n), F.lit("|"), F.lit(""))) + 1
    hit = F.struct(F.get("c.places", F.lit(0)).alias("start"), (-F.get("c.places", n_units - 1) - 1).alias("end"), F.col("id"))
    hit = F.when(F.startswith(words, F.col("known")) & after.isin("", "|"), hit)
    found = met.groupBy("__row").agg(F.first("__key").alias("__key"), F.max("c.letters").alias("letters"), F.collect_set(hit).alias("hits"))

    def take(acc: Column, h: Column) -> Column:
        between = F.substring(F.col("letters"), acc["last"] + 1, h["start"] - acc["last"])
        gap = F.when((acc["seq"] != "") & between.contains("1"), "<?>").otherwise("")
        taken = F.struct((-h["end"]).alias("last"), F.concat(acc["seq"], gap, F.lit("<"), h["id"].cast("string"), F.lit(">")).alias("seq"))
        return F.when(h["start"] >= acc["last"], taken).otherwise(acc)

    begin = F.struct(F.lit(0).alias("last"), F.lit("").alias("seq"))
    return found.select(F.col("__key").alias(key), F.aggregate(F.array_sort("hits"), begin, take)["seq"].alias("sentence_ids"))


def _matched(sequence: Column, rules: Sequence[tuple[str, tuple[int, ...]]]) -> Column:
    """Licences of the rules that match, in the rules' order, once for each match."""
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in rules])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        rest = F.replace(acc["rest"], rule["ids"], F.lit("<?>"))
        gone = F.length(acc["rest"]) - F.length(F.replace(acc["rest"], rule["ids"], F.lit("")))
        times = (gone / F.length(rule["ids"])).cast("int")
        return F.struct(rest.alias("rest"), F.concat(acc["found"], F.array_repeat(rule["name"], times)).alias("found"))

    return F.aggregate(listed, start, step)["found"]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[tuple[str, tuple[int, ...]]] = RULES) -> DataFrame:
    """Per row of ``docs``: key, ``sentence_ids`` (known sentences in order, ``<?>`` for others between them),
    ``licenses`` (array, one entry for each match, in the rules' order) and ``n_known``.

    Line ends count as sentence ends and as spaces, whichever gives a known sentence at that place, so wrapped texts and
    notices on lines of their own are found next to each other. Units without letters aren't sentences.

    A null or empty text has no sentences. Repeated rows are scanned one by one. Only the two named columns are read.
    An empty table gives an empty result.
    """
    n_known = lambda s: F.length(F.regexp_replace(F.regexp_replace(s, r"<\?>", ""), "[^<]", ""))
    chosen = _sequences(docs, key, text)
    return chosen.select(key, "sentence_ids", _matched(F.col("sentence_ids"), rules).alias("licenses"), n_known(F.col("sentence_ids")).cast("long").alias("n_known"))


def op5_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "sentence_ids", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"), "n_known")


def _op5_sql() -> str:
    """No clues: every text is cut, and runs of its units are compared with the known sentences' words."""
    forms = {i: normal_form(s) for i, s in SENTENCES.items()}
    known = ", ".join(f"('{s}', {i}, '{s.split(' ')[0]}', {s.count(' ') + 1})" for i, s in forms.items())
    steps, last = [], "m0"
    for k, (licence, ids) in enumerate(RULES, 1):
        pattern = "".join(f"<{i}>" for i in ids)
        n = f"((length(rest) - length(replace(rest, '{pattern}', ''))) // {len(pattern)})"
        steps.append(f"m{k} AS (SELECT r, seq, replace(rest, '{pattern}', '<?>') AS rest, found || repeat('{licence},', {n}::BIGINT) AS found FROM {last})")
        last = f"m{k}"
    runs = lambda listed: (
        f"SELECT r, places[i] AS a, places[i + n - 1] + 1 AS b, id FROM (SELECT d.*, i, id, known, unnest(generate_series(1, n_words)) AS n FROM "
        f"(SELECT r, {listed}, unnest(generate_series(1, len(words))) AS i FROM cut) d JOIN known ON split_part(words[i], ' ', 1) = first) WHERE i + n - 1 <= len(words) AND array_to_string(words[i:i + n - 1], ' ') = known"
    )
    return rf"""
WITH RECURSIVE known(known, id, first, n_words) AS (VALUES {known}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '(?m)^[ \t]*\(?[0-9]{{1,3}}\)[ \t]+', '', 'g') AS t FROM documents),
u AS (SELECT r, list_filter(list_transform(regexp_split_to_array(t, '[.!?:][ \t\r\n]+|\n'), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS u FROM d),
cut AS MATERIALIZED (SELECT r, u, list_transform(u, lambda x, i: i - 1) AS uat, list_filter(u, lambda x: regexp_matches(x, '[a-z]')) AS lu, list_filter(list_transform(u, lambda x, i: CASE WHEN regexp_matches(x, '[a-z]') THEN i - 1 END), lambda x: x IS NOT NULL) AS lat FROM u),
hits AS (SELECT r, a, max(b) AS b, arg_min(id, (-b, id)) AS id FROM ({runs("u AS words, uat AS places")} UNION ALL {runs("lu AS words, lat AS places")}) GROUP BY r, a),
linked AS MATERIALIZED (SELECT h.*, (SELECT min(n.a) FROM hits n WHERE n.r = h.r AND n.a >= h.b) AS next FROM hits h),
walk(r, a, b, seq) AS (SELECT r, a, b, '<' || id || '>' FROM linked WHERE (r, a) IN (SELECT r, min(a) FROM linked GROUP BY r)
  UNION ALL SELECT n.r, n.a, n.b, w.seq || CASE WHEN len(list_filter(c.lat, lambda x: x >= w.b AND x < n.a)) > 0 THEN '<?>' ELSE '' END || '<' || n.id || '>'
  FROM walk w JOIN linked l ON w.r = l.r AND w.a = l.a JOIN linked n ON n.r = l.r AND n.a = l.next JOIN cut c ON c.r = w.r),
m0 AS (SELECT r, arg_max(seq, a) AS seq, arg_max(seq, a) AS rest, '' AS found FROM walk GROUP BY r),
{", ".join(steps)}
SELECT doc_id, coalesce(seq, '') AS sentence_ids, rtrim(coalesce(found, ''), ',') AS licenses, length(coalesce(found, '')) - length(replace(coalesce(found, ''), ',', '')) AS n_licenses,
  length(regexp_replace(regexp_replace(coalesce(seq, ''), '<\?>', '', 'g'), '[^<]', '', 'g')) AS n_known FROM d LEFT JOIN {last} USING (r)
"""


OP5_SQL = _op5_sql()
