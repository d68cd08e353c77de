"""License scans: MinHash bands over overlapping text windows, then exact containment.

All of it is DataFrame expressions; no Python runs on the executors.

Texts are lower-cased and split to words [a-z0-9]+; shingles are five words.  A template of
n shingles is sought in windows of n shingles that start every n / 4.  A window and a template
collide if all ``ROWS`` MinHash values of one of ``BANDS`` bands are equal.  At the least similarity of a
window that is well placed and holds ``CONTAINMENT`` of a template (0.5) that happens with a
probability of 1 - (1 - 0.5 ** ROWS) ** BANDS, over 0.9999.  A pair is a match if the
window, with one stride on either side, contains ``CONTAINMENT`` of the template's shingles.

*What need not be hashed.*  A MinHash value that a window shares with a template is
the hash of a shingle they share.  So windows that hold none of the shingles at which a template's values are attained
collide with no band; only the others get signatures.  Likewise only texts with a word of
such a shingle are cut to shingles.  Neither loses a collision.

A tag whose id is one word (MIT, ISC) has four words and no shingle: it isn't found, unlike these licenses' notices.
A null or empty text, or one of fewer than five words, matches nothing; an empty table gives an empty result; texts of any length are scanned
whole, at a cost that grows with their words and hits; repeated rows match alike;
rows of one doc_id and different texts are kept apart; a document may match several templates, and
each is reported with its best window (greatest containment, then first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.llm.runtime import core, identity, written

SHINGLE, ROWS, BANDS, CONTAINMENT = 5, 2, 32, 0.8
#: Windows of a template of n shingles start every max(1, n / STRIDES).
STRIDES = 4

# Words that many texts have.
COMMON = ("a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "copy", "for", "free", "from", "general", "if", "in", "included", "is", "it", "not", "of", "on", "or", "person", "persons", "public", "required", "rights", "source", "subject", "terms", "that", "the", "this", "to", "under", "was", "with", "without", "work", "writing", "you")

# The notices by which licenses ask to be named (id, category, text).
TEMPLATES = (
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "copyleft", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "copyleft", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "public-domain", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "permissive", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "permissive", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("BSD-2-Clause", "permissive", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    ("Zlib", "permissive", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("GPL-2.0-only", "copyleft", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("EPL-2.0", "copyleft", "made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "public-domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

# SPDX ids of two words or more, by which one-line tags name a license.
SPDX = (
    ("permissive", "Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0"),
    ("copyleft", "AGPL-3.0-only AGPL-3.0-or-later CC-BY-SA-4.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MPL-2.0"),
    ("noncommercial", "CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0"),
    ("public-domain", "CC0-1.0"),
)
# The Creative Commons terms and versions that short notices name.
CREATIVE = (("BY", "permissive"), ("BY-SA", "copyleft"), ("BY-ND", "no-derivatives"), ("BY-NC", "noncommercial"), ("BY-NC-SA", "noncommercial"), ("BY-NC-ND", "noncommercial"))
CREATIVE_VERSIONS = ("3.0", "4.0")

_TAGS = tuple((i, c, f"SPDX-License-Identifier: {i}") for c, ids in SPDX for i in ids.split())
_SHORT = tuple((f"CC-{k}-{v}", c, f"Licensed under CC {k} {v}.") for k, c in CREATIVE for v in CREATIVE_VERSIONS)
#: All that is sought: notices, and tags and short forms made of the ids above.
KNOWN = TEMPLATES + _TAGS + tuple(t for t in _SHORT if t not in TEMPLATES)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingle_hashes(own: Column) -> Column:
    """The hashes of the shingles of a word array, in order."""
    some = F.size(own) >= SHINGLE
    places = F.when(some, F.sequence(F.lit(1), F.greatest(F.size(own) - (SHINGLE - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.element_at(own, i + k) for k in range(SHINGLE))))


def part(own: str, first: Column, last: Column) -> Column:
    """Items first to last of an array column, cut at its end.  (slice() would copy the whole array each time.)"""
    return F.transform(F.sequence(first, F.least(last, F.size(own) - 1)), lambda i: F.get(F.col(own), i))


def shingle_texts(own: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.size(own) - (SHINGLE - 1), F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.concat_ws(" ", F.slice(own, i, SHINGLE))))


def bands(hashes: str) -> Column:
    """(band, key) of a column of shingle hashes: a band's key is a hash of its ROWS MinHash values.

    It takes a column's name: an expression would be evaluated anew for each value, as lambdas hold no results.
    """

    def least(j: Column) -> Column:
        return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, j)))

    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(*(least(b * ROWS + k) for k in range(ROWS))).alias("key")))


def templates(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """(template, license, category, own, hashes, n, stride); known is a fixed list in the code, so its size is bounded."""
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(i).alias("license"), F.lit(c).alias("category"), F.lit(t).alias("text")) for k, (i, c, t) in enumerate(known)))
    t = spark.range(1).select(F.explode(rows).alias("t")).select("t.*").withColumn("own", words(F.col("text")))
    t = t.where(F.size("own") >= SHINGLE).withColumn("hashes", shingle_hashes(F.col("own"))).withColumn("n", F.size("hashes"))
    return t.withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("n") / STRIDES).cast("int")))


def attained(t: DataFrame) -> DataFrame:
    """(template, n, stride, hash, gate): the shingles at which the templates' MinHash values are attained, each with one of its words.

    Any word would do; the longest that isn't among COMMON lets the fewest other texts pass.
    """
    least = F.transform(F.sequence(F.lit(0), F.lit(ROWS * BANDS - 1)), lambda j: F.array_min(F.transform("hashes", lambda x: F.struct(F.xxhash64(x, j), x.alias("hash"))))["hash"])
    each = t.select("template", "n", "stride", "own", "hashes", F.explode(F.array_distinct(least)).alias("hash"))
    at = F.array_position("hashes", F.col("hash")).cast("int")
    longest = F.array_max(F.transform(F.slice("own", at, SHINGLE), lambda w: F.struct(~w.isin(*COMMON), F.length(w), w.alias("word"))))["word"]
    return each.select("template", "n", "stride", "hash", longest.alias("gate"))


def matches(keyed: DataFrame, known: tuple = KNOWN) -> DataFrame:
    """(doc_id, uid, template, license, category, start, containment) of keyed (doc_id, uid, text)."""
    spark = keyed.sparkSession
    t = templates(spark, known)
    sought = attained(t)
    # Bounded by the fixed list of templates: at most ROWS * BANDS shingles of each, and one class of windows.
    found = sought.select("hash", "gate", "n", "stride").distinct().collect()
    gates = F.array(*(F.lit(g) for g in sorted({r.gate for r in found})))
    classes: dict[tuple[int, int], list[int]] = {}
    for r in sorted(found):
        classes.setdefault((r.n, r.stride), []).append(r.hash)

    texts = keyed.where("text is not null").select("doc_id", "uid", words(F.col("text")).alias("own")).where(F.arrays_overlap("own", gates))
    cut = texts.withColumn("hashes", shingle_hashes(F.col("own")))
    hits = F.filter(F.transform("hashes", lambda h, i: F.struct(i.alias("at"), h.alias("hash"))), lambda x: x["hash"].isin(sorted({r.hash for r in found})))
    # No filter on the hits: it would be pushed below the arrays, which would then be made anew for each shingle.
    hit = cut.select("doc_id", "uid", "own", "hashes", hits.alias("hits"))

    def windows(n: int, stride: int, own: list[int]) -> Column:
        """The windows of a class that hold one of its hits, each once, cut out of the document: no array of it is copied for a hit."""
        mine = F.filter("hits", lambda x: x["hash"].isin(own))
        span = lambda x: F.sequence(F.greatest(F.lit(0), F.ceil((x["at"] - (n - 1)) / stride).cast("int")), F.floor(x["at"] / stride).cast("int"))
        starts = F.array_distinct(F.flatten(F.transform(mine, lambda x: F.transform(span(x), lambda w: w * stride))))
        low = lambda s: F.greatest(F.lit(0), s - stride)
        return F.transform(starts, lambda s: F.struct(F.lit(n).alias("n"), s.alias("start"), part("hashes", s, s + (n - 1)).alias("inner"), part("own", low(s), s + (n + stride + SHINGLE - 2)).alias("region")))

    window = hit.select("doc_id", "uid", F.explode(F.flatten(F.array(*(windows(n, stride, own) for (n, stride), own in sorted(classes.items()))))).alias("w")).select("doc_id", "uid", "w.*")

    t_bands = t.select("template", "n", F.explode(bands("hashes")).alias("b")).select("template", "n", "b.band", "b.key")
    w_bands = window.select("doc_id", "uid", "n", "start", "region", F.explode(bands("inner")).alias("b")).select("doc_id", "uid", "n", "start", "region", "b.band", "b.key")
    met = w_bands.join(F.broadcast(t_bands), ["n", "band", "key"]).dropDuplicates(["doc_id", "uid", "template", "start"]).drop("n", "band", "key")

    texts_of = t.select("template", "license", "category", shingle_texts(F.col("own")).alias("shingles"))
    share = F.size(F.array_intersect("shingles", shingle_texts(F.col("region")))) / F.size("shingles")
    sure = met.join(F.broadcast(texts_of), "template").withColumn("containment", share).where(F.col("containment") >= CONTAINMENT)
    best = sure.groupBy("doc_id", "uid", "template", "license", "category").agg(F.max(F.struct("containment", (-F.col("start")).alias("before"))).alias("best"))
    return best.select("doc_id", "uid", "template", "license", "category", (-F.col("best.before")).alias("start"), F.col("best.containment").alias("containment"))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", known: tuple = KNOWN) -> DataFrame:
    """Per row: doc_id, n_templates, licenses and categories (sorted, comma-joined), best_containment (0 if none), found (template, license, start, containment)."""
    keyed, uid = identity(core(docs, key, text), "doc_id", "text")
    keyed = keyed.select("doc_id", F.col(uid).alias("uid"), "text")
    own = written(matches(keyed, known), "licenses").groupBy("doc_id", "uid").agg(
        F.count("*").alias("n_templates"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.max("containment").alias("best_containment"),
        F.sort_array(F.collect_list(F.struct("template", "license", "start", "containment"))).alias("found"),
    )
    own = own.withColumnsRenamed({"doc_id": "_d", "uid": "_u"})
    out = keyed.drop("text").join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("uid") == F.col("_u")), "left")
    return out.select("doc_id", F.coalesce("n_templates", F.lit(0)).alias("n_templates"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("best_containment", F.lit(0.0)).alias("best_containment"), "found")
