"""License scans by MinHash bands over overlapping windows, DataFrame functions only.

Words are lower-cased runs of letters and digits; shingles have ``k`` words.
Templates are put into classes by length; a class has windows of twice its
length at every multiple of it, so each occurrence lies whole in one window.
Shingles of no template cannot add to a containment and are left out of the
window sets.  A window and a template of its class are compared if any of the
class's one-row MinHash bands agrees: with Jaccard similarity s of the two sets
they meet with probability 1 - (1 - s) ** bands.  A class has ``bands`` bands, or as
many more as its smallest template needs to meet a full window with probability
``MEET``: s is 1/32 for one shingle among the 32 of a window of the smallest
class.  Candidates are verified by exact
containment: the share of the template's shingles in the window.

Defined results: null, empty and short texts match nothing; a template needs at
least ``k`` words (else ValueError); equal templates all match; repeated rows give
one result per id and license; a null id is kept as null; an empty table gives an
empty result; only the two named columns are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Notices and headers as their licenses word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)
#: Least probability that a window meets a template that it contains.
MEET = 0.999
_SEPARATORS = r"[^\p{L}\p{N}]+"


class LicenseScan:
    """Scan texts for templates ``(license, text)`` at containment ``least``."""

    def __init__(self, templates=TEMPLATES, k: int = 5, least: float = 0.8, bands: int = 48, broadcast_shingles: int = 200_000):
        self.templates, self.k, self.least, self.bands = list(templates), k, least, bands
        self.broadcast_shingles = broadcast_shingles
        for name, text in self.templates:
            if len(re.findall(r"[^\W_]+", text)) < k:
                raise ValueError(f"template {name} has fewer than {k} words")

    @staticmethod
    def size_class(words: int) -> int:
        """The smallest power of two, at least 16, that is not below the template's words."""
        size = 16
        while size < words:
            size *= 2
        return size

    def _shingles(self, text: Column) -> Column:
        """Hashes of the text's k-word shingles, in order."""
        words = F.split(F.trim(F.regexp_replace(F.lower(text), _SEPARATORS, " ")), " ")
        none = F.expr("CAST(array() AS array<bigint>)")

        def hashed(w: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(w) - self.k)
            return F.when(F.size(w) >= self.k, F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(self.k))))).otherwise(none)

        # As a lambda's argument the words are made once, not for each shingle.
        return F.get(F.transform(F.array(words), hashed), F.lit(0))

    def class_bands(self) -> dict[int, int]:
        """Number of bands of each size class."""
        sizes: dict[int, list[int]] = {}
        known: dict[int, set] = {}
        for _, text in self.templates:
            words = re.findall(r"[^\W_]+", text.lower())
            wanted = {tuple(words[i : i + self.k]) for i in range(len(words) - self.k + 1)}
            sizes.setdefault(self.size_class(len(words)), []).append(len(wanted))
            known.setdefault(self.size_class(len(words)), set()).update(wanted)
        out = {}
        for size, counts in sizes.items():
            held = min(2 * size, len(known[size]))

            def least_similarity(n: int) -> float:
                shared = math.ceil(self.least * n - 1e-9)
                return shared / max(n, held + n - shared)

            s = min(map(least_similarity, counts))
            out[size] = max(self.bands, math.ceil(math.log(1 - MEET) / math.log1p(-s)) if 0 < s < 1 else 1)
        return out

    def _bands(self, grams: Column) -> Column:
        """(band, smallest hash of the set under the band's hash function)."""
        last = F.expr("CASE class " + " ".join(f"WHEN {c} THEN {n - 1}" for c, n in self.class_bands().items()) + " END")

        def lowest(band: Column) -> Column:
            return F.array_min(F.transform(grams, lambda x: F.xxhash64(x, band)))

        return F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(b.alias("band"), lowest(b).alias("low")))

    def _template_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, text, self.size_class(len(re.findall(r"[^\W_]+", text)))) for i, (name, text) in enumerate(self.templates)]
        table = spark.createDataFrame(rows, "template int, license string, text string, class int")
        return table.select("template", "license", "class", F.array_distinct(self._shingles(F.col("text"))).alias("wanted"))

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, license, containment, start_word, end_word)``, the best window of each."""
        templates = self._template_table(docs.sparkSession)
        known = templates.select("class", F.explode("wanted").alias("gram")).distinct()
        if sum(len(text.split()) for _, text in self.templates) <= self.broadcast_shingles:
            # The templates are a parameter whose size was just checked.
            known, templates = F.broadcast(known), F.broadcast(templates)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.posexplode(self._shingles(text)).alias("pos", "gram"))
        hits = rows.join(known, "gram")
        window = (F.col("pos") / F.col("class")).cast("int")
        placed = hits.select("id", "key", "class", "pos", "gram", F.explode(F.array(window, window - 1)).alias("window")).where("window >= 0")
        sets = placed.groupBy("id", "key", "class", "window").agg(F.collect_set("gram").alias("held"), F.min("pos").alias("start_word"), F.max("pos").alias("last"))
        banded = sets.withColumn("b", F.explode(self._bands(F.col("held")))).select("*", "b.band", "b.low").drop("b")
        template_bands = templates.withColumn("b", F.explode(self._bands(F.col("wanted")))).select("template", "class", "b.band", "b.low")
        met = banded.join(template_bands, ["class", "band", "low"]).groupBy("id", "key", "class", "window", "template").agg(
            F.first("held").alias("held"), F.first("start_word").alias("start_word"), F.first("last").alias("last")
        )
        shares = met.join(templates.drop("class"), "template").withColumn("containment", F.size(F.array_intersect("held", "wanted")) / F.size("wanted"))
        good = shares.where(F.col("containment") >= self.least)
        best = F.max(F.struct("containment", (-F.col("start_word")).alias("s"), (F.col("last") + self.k).alias("e"))).alias("best")
        return good.groupBy("id", "license").agg(best).select(
            "id", "license", F.col("best.containment").alias("containment"), (-F.col("best.s")).cast("long").alias("start_word"), F.col("best.e").cast("long").alias("end_word")
        )
