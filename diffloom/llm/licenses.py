"""License scans by MinHash bands over overlapping windows."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm.words import normal_words, seed_hash, sent_to_tasks, word_rows
from diffloom.session import checkpointed

SHINGLE = 5
STEP = 16
WINDOW = 2 * STEP
SHARE = 0.8
MISS = 1e-3

# Customary license notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


# How texts name a licence in a sentence.
VERBS = ("licensed", "released", "distributed", "available", "provided")
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "a BSD 2-Clause License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "a BSD 3-Clause License"),
    "CC-BY-4.0": ("a Creative Commons Attribution 4.0 International License", "CC BY 4.0", "the CC BY 4.0"),
    "CC-BY-NC-4.0": ("a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "the CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("a Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "the CC BY-SA 4.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2", "the GNU General Public License v2.0",
                "the GNU GPL v2", "the GPL v2", "the GPLv2 license"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3", "the GNU General Public License v3.0",
                "the GNU GPL v3", "the GPL v3", "the GPLv3 license"),
    "ISC": ("the ISC License",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3",
                 "the GNU Lesser General Public License v3.0"),
    "MIT": ("the MIT License", "an MIT License"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
}
_WARRANTY = (
    " This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.")
_FREE = (
    "This {it} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free "
    "Software Foundation; either version {version} of the License, or (at your option) any later version.")
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. ")
NOTICES = (
    *[(license, f"{verb} under {name}") for license, names in NAMES.items() for name in names for verb in VERBS],
    *[(license, (_FREE + more).format(it=it, name=f"GNU {kind}General Public License", version=version))
      for license, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"))
      for it in ("program", "library", "file") for more in ("", _WARRANTY)],
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
     "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
     'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
     "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
     "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
     "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE "
     "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
     "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
     "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
     "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission. " + _AS_IS),
)
TEXTS = Path(__file__).with_name("license_texts")  #: whole licence texts, by SPDX name
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*"


def default_templates(spark: SparkSession) -> DataFrame:
    texts = [(file.stem, file.read_text(encoding="utf-8")) for file in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame([*sorted(TEMPLATES.items()), *NOTICES, *texts], "license string, text string")


def _tagged(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Licences of ``names`` that SPDX lines give; the tag alone has too few words for a shingle."""
    pieces = F.split(F.coalesce("text", F.lit("")), SPDX)
    rows = docs.where(F.col("text").rlike(SPDX)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), pieces.alias("pieces"), F.posexplode(pieces).alias("i", "piece")).where("i > 0")
    before = F.array_join(F.slice("pieces", 1, F.col("i")), "\nspdx license identifier ")
    ids = F.regexp_extract_all(F.regexp_extract("piece", r"^[^\r\n]*", 0), F.lit(r"[A-Za-z0-9.+-]+"), F.lit(0))
    named = rows.select("doc_id", F.size(normal_words(before)).cast("bigint").alias("at"), F.explode(ids).alias("_id")).withColumn(
        "_key", F.lower(F.regexp_replace("_id", r"(?i)(-only|-or-later|\+)$", "")))
    known = names.select("license", F.lower("license").alias("_key")).distinct()
    return named.join(F.broadcast(known), "_key").select("doc_id", "license", F.lit(1.0).alias("containment"), "at")


def bands_for(window: int, shingle: int, miss: float) -> int:
    """One-row bands so that a window and any shingle set it shares a single shingle with collide, but for ``miss``."""
    least = 1 / (2 * (window - shingle + 1))
    return math.ceil(math.log(miss) / math.log(1 - least))


def _shingles(words: Column, size: int) -> Column:
    """Distinct hashes of runs of ``size`` words; shorter lists have none."""
    return F.when(F.size(words) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size))))).otherwise(
        F.array().cast("array<bigint>"))


def _band_values(shingles: Column, bands: int) -> Column:
    """The least hash of the set under each of ``bands`` seeded hash functions."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.struct(
        b.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(b, s))).alias("value")))


def license_matches(docs: DataFrame, templates: DataFrame, share: float = SHARE, miss: float = MISS,
                    shingle: int = SHINGLE, step: int = STEP) -> DataFrame:
    """``doc_id``, ``license``, ``containment`` and ``at`` (first word) for each notice that a text contains.

    Each text is cut into windows of ``2 * step`` words, ``step`` apart, and templates into
    pieces of at most ``step`` words, so each piece that stands in a text is whole in a window. MinHash
    bands of one row retrieve pieces for windows; their number makes the chance to miss a
    piece that shares even one shingle with the window at most ``miss``. Windows that hold no template
    shingle at all have similarity 0, collide with nothing, and get no signature: their
    shingles are looked up first, in the stream of words. A retrieved piece leads to its template, which is
    verified exactly: the share of its distinct shingles of ``shingle`` words that stand in the text around the window,
    as far as the template is long. A licence may have several templates. Licences named by SPDX lines are read from the line.

    Words are runs of letters and digits in lower case. Templates under ``shingle`` words never
    match; null texts have no words; null doc_ids stay null and count as one document; repeated rows give their row
    once; of templates that match one stretch the one with most shingles there is named, equal ones all. Empty tables give no rows.
    """
    bands = bands_for(2 * step, shingle, miss)
    known = templates.select("license", normal_words(F.col("text")).alias("words")).where(F.size("words") >= shingle).distinct()
    known = checkpointed(known.select(F.xxhash64("license", "words").alias("template"), "license", "words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - shingle + 1, F.lit(1)), F.lit(step - shingle + 1))
    pieces = known.select("template", F.explode(F.transform(starts, lambda i: F.slice("words", i, step))).alias("piece"))
    pieces = pieces.where(F.size("piece") >= shingle)
    # A template of any length is one row for each value: its pieces' windows lead to it all the same.
    signed = pieces.select("template", F.explode(_band_values(_shingles(F.col("piece"), shingle), bands)).alias("b"))
    signed = checkpointed(signed.groupBy(F.col("b.band").alias("band"), F.col("b.value").alias("value")).agg(
        F.collect_set("template").alias("templates")))
    key = seed_hash(tuple(range(shingle)))
    owned = word_rows(known.select("template", "words"), shingle).select("template", key.alias("key")).where("key is not null").distinct()
    keys = checkpointed(owned.groupBy("key").agg(F.collect_set("template").alias("owners")))
    sizes = checkpointed(known.select("template", "license", F.size("words").alias("length")).join(
        owned.groupBy("template").agg(F.count(F.lit(1)).alias("distinct")), "template"))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_words(F.col("text")).alias("words"))
    texts = texts.withColumn("_text", F.xxhash64("words"))
    hits = word_rows(texts, shingle).withColumn("key", key).join(sent_to_tasks(keys, keys.count()), "key")
    # A shingle stands in the windows that begin up to 2 * step - shingle words before it.
    lowest = F.greatest(F.ceil((F.col("at") + shingle - 2 * step) / step), F.lit(0)).cast("int")
    hits = checkpointed(hits.select(
        "doc_id", "_text", "key", "at", "owners",
        F.transform(F.sequence(lowest, F.floor(F.col("at") / step).cast("int")), lambda w: F.struct(
            w.alias("w"), F.slice("words", w * step + 1, F.lit(2 * step)).alias("window"))).alias("_windows")))
    placed = hits.select("doc_id", "_text", F.explode("_windows").alias("_w"))
    windows = placed.groupBy("doc_id", "_text", F.col("_w.w").alias("w")).agg(F.first("_w.window").alias("window"))
    banded = windows.select("doc_id", "_text", "w", F.explode(_band_values(_shingles(F.col("window"), shingle), bands)).alias("b"))
    retrieved = banded.join(
        sent_to_tasks(signed, signed.count()),
        (F.col("b.band") == signed["band"]) & (F.col("b.value") == signed["value"]))
    candidates = retrieved.select("doc_id", "_text", "w", F.explode("templates").alias("template")).distinct()
    wanted = candidates.groupBy("doc_id", "_text", "template").agg(F.sort_array(F.collect_set("w")).alias("ws"))
    # A text's places of one template's shingles: as many as the text has words at most.
    spots = hits.select("doc_id", "_text", F.explode("owners").alias("template"), "key", "at").groupBy("doc_id", "_text", "template").agg(
        F.collect_set(F.struct("at", "key")).alias("spots"))
    spots = spots.join(sent_to_tasks(sizes, sizes.count()), "template").where(
        F.size(F.array_distinct("spots.key")) >= share * F.col("distinct"))
    both = spots.withColumnRenamed("doc_id", "_d").withColumnRenamed("_text", "_x").withColumnRenamed("template", "_t")
    verified = wanted.join(both, wanted["doc_id"].eqNullSafe(both["_d"]) & (F.col("_text") == F.col("_x")) & (F.col("template") == F.col("_t")))
    near = verified.select("doc_id", "_text", "template", "license", "distinct", "length", "spots", F.explode("ws").alias("w")).withColumn(
        "near", F.filter("spots", lambda s: (s["at"] >= F.col("w") * step - F.col("length")) & (
            s["at"] + shingle <= F.col("w") * step + 2 * step + F.col("length"))))
    found = near.withColumn("matched", F.size(F.array_distinct("near.key"))).withColumn(
        "containment", F.col("matched") / F.col("distinct")).where(F.col("containment") >= share).select(
        "doc_id", "_text", "license", "matched", "containment",
        F.array_min("near.at").alias("at"), (F.array_max("near.at") + shingle).alias("till")).distinct()
    # Of templates that match one stretch the one with the most shingles there stays. Lists are as long as matches in one text.
    all_ = found.groupBy("doc_id", "_text").agg(F.collect_list(F.struct("matched", "containment", "at", "till", "license")).alias("_all"))
    better = lambda a, b: (F.struct(b["matched"], b["containment"]) > F.struct(a["matched"], a["containment"])) & (
        2 * (F.least(a["till"], b["till"]) - F.greatest(a["at"], b["at"])) > a["till"] - a["at"])
    kept = all_.select("doc_id", F.explode(F.filter("_all", lambda a: ~F.exists("_all", lambda b: better(a, b)))).alias("_one"))
    named = kept.select("doc_id", "_one.license", "_one.containment", F.col("_one.at").cast("bigint").alias("at"))
    return named.unionByName(_tagged(docs, templates)).groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.min("at").cast("bigint").alias("at"))
