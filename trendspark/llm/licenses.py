"""License scans by diagonal voting.

The words of each text and of each license template are cut into rolling word
k-grams. Their hashes are joined; a hit at word d of a text and word t of a
template votes for the diagonal d - t. Votes are summed by diagonal,
neighbouring diagonals (words were put in or left out) merge, and the span under
a merged diagonal is verified: it must hold enough of the template's k-grams, and
the text's own words there are compared with the template's: enough of them, all
that tell its license from others, none that make another license of it. Of
spans that overlap the one with the most k-grams stays. Base phrases are found
beside that, exactly.

The template table is a parameter of a few hundred k-grams and is broadcast;
only hits and the words of texts with a span to verify are shuffled. The latter
are found by a bitmap of hashed texts, 8 MB at any size of the corpus. Rows with
equal identifier and text share their hits, which are counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.llm.common import text_or_empty
from trendspark.session import cut_lineage

K = 3
BITMAP = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# --- fixed values: phrases of the base and their labels ---
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# --- fixed values: notices of public licenses and their labels ---
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
               "software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met: Redistributions of source code must retain the above copyright notice"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International "
                    "License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                    "International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
            "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in "
                    "any form or by any means"),
    ("bsd", "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met: Redistributions of source code must retain the above "
            "copyright notice"),
    ("proprietary", "All rights reserved."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
             "Documentation License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
              "and accompanying documentation covered by this license"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("eupl", "Licensed under the European Union Public Licence (EUPL)"),
    ("eupl", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission"),
    ("cc0", "Licensed under CC0 1.0 Universal."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
            "work"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("wtfpl", "Do What The Fuck You Want To Public License"),
    ("odbl", "This database is made available under the Open Database License"),
    ("artistic", "This program is free software; you can redistribute it under the terms of the Artistic License"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("public-domain", "This work has been released into the public domain by its author"),
    # Short grants.
    *((f"cc-by{part}", f"Licensed under CC BY{part.upper()}") for part in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd")),
    *((label, f"licensed under the {name}") for label, name in (
        ("lgpl", "GNU Lesser General Public License"), ("agpl", "GNU Affero General Public License"), ("mpl", "Mozilla Public License"),
        ("epl", "Eclipse Public License"), ("isc", "terms of the ISC license"), ("isc", "ISC license"))),
    # Identifier lines.
    *((label, f"SPDX-License-Identifier: {name}") for name, label in (
        ("MIT", "mit"), ("Apache", "apache"), ("GPL", "gpl"), ("LGPL", "lgpl"), ("AGPL", "agpl"), ("BSD", "bsd"), ("ISC", "isc"),
        ("MPL", "mpl"), ("BSL", "boost"), ("EPL", "epl"), ("EUPL", "eupl"), ("CC0", "cc0"), ("Zlib", "zlib"),
        ("Unlicense", "unlicense"), ("WTFPL", "wtfpl"), ("CC-BY-4.0", "cc-by"), ("CC-BY-SA-4.0", "cc-by-sa"))),
)

# --- fixed values: names of licenses, which a text may mention without being under them ---
MENTIONS = (
    ("cc-by-sa", "CC BY-SA"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nd", "CC BY-ND"),
    ("cc-by-nc-sa", "CC BY-NC-SA"),
    ("cc-by-nc-nd", "CC BY-NC-ND"),
    ("cc0", "CC0 1.0 Universal"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("gfdl", "GNU Free Documentation License"),
    ("mpl", "Mozilla Public License"),
    ("epl", "Eclipse Public License"),
    ("eupl", "European Union Public Licence"),
    ("boost", "Boost Software License"),
    ("ofl", "SIL Open Font License"),
    ("odbl", "Open Database License"),
    ("cddl", "Common Development and Distribution License"),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "BSD 3-Clause License"),
    ("isc", "under the ISC License"),
    ("isc", "ISC License Copyright"),
)
MENTIONED = 0.5  # score of a name without a notice

# --- fixed values: names that a span must hold if its template does, and the words that make another
# license of the same name, which it must hold or lack as its template does ---
NAMES = {"mit": (), "apache": (), "bsd": (), "mozilla": (), "isc": (), "boost": (), "eclipse": (), "eupl": (), "cc0": (),
         "gpl": (), "lgpl": (), "agpl": (), "mpl": (), "bsl": (), "epl": (), "zlib": (), "unlicense": (), "wtfpl": (),
         "gnu": ("lesser", "affero", "library"), "cc": ("sa", "nc", "nd"), "organization": (), "font": (), "licensed": (), "spdx": (),
         "commons": ("sharealike", "alike", "noncommercial", "commercial", "noderivatives", "noderivs", "derivatives", "derivs")}


def words_of(text: Column) -> Column:
    """Words of a text (null: none), A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text_or_empty(text), UPPER, LOWER), NOT_WORD), "")


def _shifted(words: Column, n: int) -> Column:
    """Array of structs w0, w1, ... of n words that follow each other (the last ones with nulls)."""
    rest = [F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))) for i in range(1, n)]
    return F.arrays_zip(*[x.alias(f"w{i}") for i, x in enumerate([words, *rest])])


def grams(rows: DataFrame, words: Column, keep: list[str], k: int = K) -> DataFrame:
    """One row per rolling k-gram: the ``keep`` columns, ``at`` (word from 0) and ``gram``."""
    zipped = rows.select(*keep, F.posexplode(_shifted(words, k)).alias("at", "g"))
    cells = [F.col("g")[f"w{i}"] for i in range(k)]
    return zipped.where(cells[-1].isNotNull()).select(*keep, "at", F.xxhash64(*cells).alias("gram"))


def template_grams(spark, templates, k: int = K) -> DataFrame:
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)],
                                 "template int, label string, body string")
    table = grams(rows, words_of(F.col("body")), ["template", "label"], k).withColumnRenamed("at", "t_at")
    return table.withColumn("t_grams", F.count(F.lit(1)).over(Window.partitionBy("template")))


def _places(words: Column, phrase: str) -> Column:
    """Word positions at which the phrase starts."""
    want = phrase.split(" ")
    found = F.transform(_shifted(words, len(want)), lambda g, i: F.when(
        F.coalesce(F.forall(F.array(*[g[f"w{n}"].eqNullSafe(F.lit(w)) for n, w in enumerate(want)]), lambda x: x),
                   F.lit(False)), i.cast("long")))
    return F.filter(found, lambda x: x.isNotNull())


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + MENTIONS, k: int = K,
                  gap: int = 4, coverage: float = 0.6) -> DataFrame:
    """Verified spans: the identifier, ``key`` (hash of the text), ``label``, ``template``,
    ``first_word``, ``last_word`` (start of the last k-gram), ``covered`` (share of
    the template's k-grams found).

    ``gap``: how far two neighbouring diagonals with votes may be apart to merge; less
    than a template's k-grams, so that a short notice stays apart from its repetitions.
    """
    spark = docs.sparkSession
    table = template_grams(spark, templates, k)
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(F.col(text_col))).alias("key"),
                       F.col(text_col).alias("body"))
    hits = (grams(text, words_of(F.col("body")), ["id", "key"], k)
            .join(F.broadcast(table), "gram")
            .select("id", "key", "label", "template", "t_grams", "at", "t_at"))
    # Votes by diagonal; a k-gram of the template that repeats on it counts once.
    votes = hits.groupBy("id", "key", "label", "template", "t_grams", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.collect_set("t_at").alias("t_ats"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    by = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > F.least(F.lit(gap), F.col("t_grams") - 1)),
                     F.lit(True)).cast("int")
    merged = (votes.withColumn("new", new)
              .withColumn("band", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .groupBy("id", "key", "label", "template", "t_grams", "band")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("t_ats")))).alias("found"),
                   F.min("lo").alias("first_word"), F.max("hi").alias("last_word"),
                   F.min(F.array_min("t_ats")).alias("t_lo"), F.max(F.array_max("t_ats")).alias("t_hi")))
    spans = merged.withColumn("covered", F.col("found") / F.col("t_grams"))
    # A true span is about as long as its template.
    spans = spans.where((F.col("covered") >= coverage)
                        & (F.col("last_word") - F.col("first_word") + 1 <= F.col("t_grams") + 2 * gap))
    spans = best_spans(verified(cut_lineage(spans, "license-candidates"), text, template_words(spark, templates), k, gap, coverage), k)
    return spans.select(F.col("id").alias(id_col), "key", "label", "template", "first_word", "last_word", "covered")


def template_words(spark, templates) -> DataFrame:
    """``t_words`` of every template, and those a span of it must hold (``need``) or lack (``foreign``)."""
    rows = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(templates)], "template int, body string")
    rows = rows.select("template", F.array_distinct(words_of(F.col("body"))).alias("t_words"))
    holds = {name: F.array_contains("t_words", name) for name in NAMES}
    every = F.array(*[F.lit(w) for name, others in NAMES.items() for w in (name, *others)])
    others = F.concat(*[F.when(holds[name], F.array(*[F.lit(w) for w in words])).otherwise(F.array().cast("array<string>"))
                        for name, words in NAMES.items() if words])
    return rows.select("template", "t_words", F.array_intersect("t_words", every).alias("need"),
                       F.array_except(others, "t_words").alias("foreign"))


def verified(spans: DataFrame, text: DataFrame, table: DataFrame, k: int, gap: int, coverage: float) -> DataFrame:
    """The ``spans`` whose words pass; ``text`` has ``id``, ``key`` and ``body``. At either end
    up to ``gap`` words are looked at beyond a span, where its template goes on."""
    place = F.pmod(F.col("key"), F.lit(BITMAP))
    bits = spans.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))  # at most 2,049 rows of 4 KB
    own = (text.withColumn("bit", F.bitmap_bit_position(place))
           .join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("part"))
           .where(F.expr("shiftright({}, cast(bit % 8 as int)) & 1 = 1".format(
               "cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")))
           .select(F.col("id").alias("d_id"), F.col("key").alias("d_key"), words_of(F.col("body")).alias("words")))
    # The words are made below the join, once a text; each span takes its slice of them.
    by_text = spans.groupBy("id", "key").agg(F.collect_list(F.struct(
        "label", "template", "found", "covered", "first_word", "last_word",
        F.greatest(F.col("first_word") - F.least("t_lo", F.lit(gap)), F.lit(0)).alias("lo"),
        (F.col("last_word") + k + F.least(F.col("t_grams") - 1 - F.col("t_hi"), F.lit(gap))).alias("hi"))).alias("spans"))
    sliced = by_text.join(own, F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_key") == F.col("key"))).select(
        "id", "key", F.explode(F.transform("spans", lambda s: F.struct(
            s.alias("s"), F.slice("words", s["first_word"] + 1, s["last_word"] - s["first_word"] + k).alias("inside"),
            F.slice("words", s["lo"] + 1, (s["hi"] - s["lo"]).cast("int")).alias("around")))).alias("x"))
    judged = sliced.select("id", "key", "x.s.*", "x.inside", "x.around").join(F.broadcast(table), "template")
    right = judged.where((F.size(F.array_intersect("t_words", "inside")) >= coverage * F.size("t_words"))
                         & (F.size(F.array_except("need", "around")) == 0)
                         & (F.size(F.array_intersect("foreign", "around")) == 0))
    return right.select("id", "key", "label", "template", "found", "covered", "first_word", "last_word").distinct()


def best_spans(spans: DataFrame, k: int) -> DataFrame:
    """Of spans that share words, those with the most k-grams (then the larger share, then the first template)."""
    by = Window.partitionBy("id", "key").orderBy("first_word", "last_word", "template")
    before = F.max("last_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("first_word") > before + k - 1), F.lit(True)).cast("int")
    heaps = (spans.withColumn("new", new)
             .withColumn("heap", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .groupBy("id", "key", "heap").agg(F.array_sort(F.collect_list(F.struct(
                 (-F.col("found")).alias("worse"), (-F.col("covered")).alias("less"), "template", "first_word", "last_word",
                 "label", "covered"))).alias("ranked")))

    def add(kept, s):
        meets = F.exists(kept, lambda o: (s["first_word"] < o["last_word"] + k) & (o["first_word"] < s["last_word"] + k))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(s)))

    return heaps.select("id", "key", F.explode(F.aggregate("ranked", F.slice("ranked", 1, 0), add)).alias("s")).select(
        "id", "key", "s.*")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, mentions=MENTIONS,
         k: int = K) -> DataFrame:
    """One row per input row: the identifier, ``n_words``, ``n_base``, ``first_word``,
    ``last_word`` (of the base), ``base_labels``, ``labels`` and ``score``: the largest share
    of a notice found, but ``MENTIONED`` at least where a license is named, by a base
    phrase or otherwise. A bare name, which a text may only talk about, so scores
    less than a grant.

    Null and empty texts have no words and no labels. Rows that repeat get equal
    rows. Other columns are not read. An empty table gives an empty result.
    """
    strength = F.when(F.col("template") < len(templates), F.col("covered")).otherwise(MENTIONED)
    spans = (license_spans(docs, id_col, text_col, tuple(templates) + tuple(mentions), k)
             .groupBy(F.col(id_col).alias("s_id"), F.col("key").alias("s_key"))
             .agg(F.collect_set("label").alias("found"), F.max(strength).alias("covered")))
    spans = cut_lineage(spans, "license-spans")
    words = words_of(F.col(text_col))
    low = F.translate(text_or_empty(F.col(text_col)), UPPER, LOWER)
    maybe = [F.lit(True)] * len(BASE)
    for i, (phrase, _) in enumerate(BASE):
        for w in phrase.split(" "):
            maybe[i] = maybe[i] & F.contains(low, F.lit(w))
    places = F.array(*[F.when(m, _places(words, p)).otherwise(F.array().cast("array<bigint>")) for m, (p, _) in zip(maybe, BASE)])
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(F.col(text_col))).alias("key"),
                       F.size(words).cast("long").alias("n_words"), places.alias("places"))
    all_places = F.flatten("places")
    base = F.filter(F.array(*[F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]),
                    lambda x: x.isNotNull())
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).alias("first_word"), F.array_max(all_places).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, F.coalesce("found", none)))).alias("labels"),
        F.greatest(F.when(F.size(all_places) > 0, MENTIONED).otherwise(0.0),
                   F.least(F.coalesce("covered", F.lit(0.0)), F.lit(1.0))).alias("score"))
