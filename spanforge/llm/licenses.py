"""License scans (operator 1), with DataFrame functions only.

Texts become words of a-z and 0-9, pairs of neighbouring words are hashed, and overlapping windows of
WINDOW words (each STEP words) get a MinHash value for each band over their pairs. A template, or
each run of CONTAINED words of a longer one, has the same bands; a window that holds such a run
whole shares at least 4 of 11 pairs with the shortest, so that all BANDS bands miss it with a
probability of (7 / 11) ** 20, about 1 in 8000 (1 in 80 million or less for 7 words). The pairs of
document and template that some band retrieves are then verified by containment: the share of the
template's distinct runs of five words that the document has.

Bands, and then five-word runs, are probed in the templates' few thousand hashes, a table of fixed
size that is broadcast. No text is shuffled; only hits are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, sieve, sifted, wanted

N, THRESHOLD = 5, 0.8
BANDS, WINDOW, STEP = 20, 12, 6
CONTAINED = WINDOW - STEP + 1

#: Public license notices as they are put into works.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


def _windows(texts: DataFrame, width: int, step: int, *keys: str) -> DataFrame:
    """(keys, at, p): the pair hashes of each window of ``width`` words, every ``step`` words."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")

    def steps(last: Column, by: int) -> Column:
        return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(by)))

    def pairs(w: Column) -> Column:
        return F.transform(steps(F.size(w) - 2, 1), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))

    def cut(p: Column) -> Column:
        return F.transform(steps(F.size(p) - 1, step), lambda i: F.struct(i.alias("at"), F.slice(p, i + 1, width - 1).alias("p")))

    # arrays of one element bind what is used more than once, so that it is computed once
    bound = F.transform(F.transform(F.array(words), pairs), cut)
    return texts.select(*keys, F.inline(F.get(bound, F.lit(0))))


def _mask(k: int) -> int:
    bits = (0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xD1B54A32D192ED03 * (k + 7) >> 5)) & 0xFFFFFFFFFFFFFFFF
    return bits - (1 << 64) if bits >> 63 else bits


def _bands(windows: DataFrame, width: int) -> DataFrame:
    """To windows the hash of each band: BANDS rows with a MinHash value over the window's pairs.

    A band's MinHash is the pair that comes first when hashes are compared after a change of bits by
    the band's own mask. Bands are rows before they are computed: one short expression stays
    compiled, where one for each band would not.
    """
    rows = windows.select("*", F.posexplode(F.array(*[F.lit(_mask(k)) for k in range(BANDS)])).alias("k", "mask"))
    band = F.xxhash64("k", F.least(*[F.get("p", F.lit(i)).bitwiseXOR(F.col("mask")) for i in range(width - 1)]))
    return rows.withColumn("hash", band).drop("p", "k", "mask")


def _runs(windows: DataFrame, starts: int) -> DataFrame:
    """To windows the hashes of the five-word runs that start at their first ``starts`` words."""
    rows = windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("k"))
    parts = [F.get("p", F.col("k") + j) for j in range(N - 1)]
    return rows.filter(parts[-1].isNotNull()).withColumn("hash", F.xxhash64(F.lit(-1), *parts)).drop("p", "k")


def template_windows(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, at, p): each template's runs of CONTAINED words; runs at its end, or of a shorter one, are as long as the words last."""
    for name, text in templates:
        if len(re.findall("[a-z0-9]+", text.lower())) < N:
            raise ValueError(f"a template of {name} has fewer than {N} words: {text!r}")
    rows = [F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)]
    texts = spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))
    return _windows(texts, CONTAINED, 1, "template", "license").filter(F.size("p") >= N - 1)


def license_scan(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, template, matched, runs, first_word) for each document of ``docs`` (doc_id, text) and template that it contains.

    matched of the template's runs (distinct runs of five words) are in the document, ``threshold``
    or more of them; first_word is the place of the first window with one. Rows that share a doc_id
    (or have none) are read as one document. Null, empty and short texts contain nothing; a template
    of fewer than five words is an error, no templates find nothing. Other columns are ignored; an
    empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    known = template_windows(docs.sparkSession, templates or [("", "a b c d e")]).filter(F.lit(bool(templates)))
    bands = _bands(known, CONTAINED).select("template", "hash").distinct()
    runs = _runs(known, 1).select("template", "license", "hash").distinct()
    sizes = runs.groupBy("template").agg(F.count("*").alias("runs"))
    texts = wanted(docs, {"doc_id": "long", "text": "string"})
    retrieved = _bands(_windows(texts, WINDOW, STEP, "doc_id"), WINDOW).join(F.broadcast(bands), "hash").select("doc_id", "template").distinct()
    retrieved = materialize(retrieved, "retrieved")
    # only documents with a retrieved template are cut into runs
    key = F.xxhash64("doc_id")
    asked = sifted(texts, key, sieve(retrieved, key, "retrieved-sieve"))
    hits = _runs(_windows(asked, WINDOW, STEP, "doc_id"), STEP).join(F.broadcast(runs.join(sizes, "template")), "hash")
    # a row for each pair and run: its first place
    hits = hits.groupBy("doc_id", "template", "license", "runs", "hash").agg(F.min("at").alias("at"))
    pairs = hits.alias("h").join(retrieved.alias("r"), F.expr("h.doc_id <=> r.doc_id and h.template = r.template"), "left_semi")
    found = pairs.groupBy("doc_id", "license", "template", "runs").agg(F.count("*").alias("matched"), F.min("at").cast("long").alias("first_word"))
    return found.filter(F.col("matched") >= F.col("runs") * threshold).select("doc_id", "license", "template", "matched", "runs", "first_word")


def oracle() -> str:
    """The same containment for all documents and templates, without windows or bands."""
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))
    run = lambda w: f"array_to_string({w}[i:i + {N - 1}], ' ')"
    return f"""
WITH t(template, license, text) AS (VALUES {rows}),
tw AS (SELECT template, license, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t),
tr AS (SELECT DISTINCT template, license, {run('w')} AS run FROM (SELECT template, license, w, unnest(range(1, len(w) - {N - 2})) AS i FROM tw)),
tn AS (SELECT template, count(*) AS runs FROM tr GROUP BY 1),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
dr AS (SELECT doc_id, i, {run('w')} AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - {N - 2})) AS i FROM dw WHERE len(w) >= {N}))
SELECT doc_id, license, CAST(template AS INTEGER) AS template, count(DISTINCT run) AS matched, runs,
       CAST((min(i) - 1) // {STEP} * {STEP} AS BIGINT) AS first_word
FROM dr JOIN tr USING (run) JOIN tn USING (template)
GROUP BY doc_id, license, template, runs HAVING count(DISTINCT run) >= {THRESHOLD} * runs
"""
