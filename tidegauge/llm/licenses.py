"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Lines that speak of rights are cut into sentences, long sentences into windows
that overlap by half, and each that speaks of rights itself is compared with the
templates' sentences; the whole text of a licence file is compared with the
whole templates too. Scores are plain cosines: all words of a passage count in
its norm. A file without a licence of its own gets that of the licence file in
the nearest directory above it. Directories are resolved first, each distinct
one once, by joins on paths; the files then join their own directory, where
directories with more than a thousandth of all files are dealt out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import shared

#: What licences' headers and the short licences say.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version. Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Use of this source code is governed by a BSD style license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License. Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "The person who associated this work has dedicated the work to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2. This program is free software; you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved. Confidential and proprietary.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
CUE = re.compile(r"licen[sc]|copyright|spdx|public domain|rights reserved|permission is hereby|redistribution and use", re.I)
TOKEN = re.compile(r"[a-z]+|[0-9]+")
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"


#: All templates together have at most this many characters, as every task holds them.
MOST_TEMPLATES = 4_000_000


@dataclass(frozen=True)
class Params:
    least: float = 0.45  # cosine of a match, at least
    least_words: int = 2  # distinct words shared with the template, at least
    window: int = 64  # words of a passage, at most; the windows of a longer sentence overlap by half


def sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[A-Za-z0-9])\.\s", text) if x]


def passages(line: str, window: int) -> Iterator[str]:
    """The sentences of a line; of a longer one its windows, so that words far from a header do not dilute it."""
    for sentence in sentences(line):
        words = sentence.split()
        for i in range(0, max(1, len(words) - window // 2), window // 2):
            yield " ".join(words[i : i + window])


def weights(templates: Mapping[str, str] = TEMPLATES) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """idf over the templates' sentences, that of words none has, and unit vectors of sentences and whole templates.

    A word that no template has weighs like one that a single sentence has.
    """
    if sum(map(len, templates.values())) > MOST_TEMPLATES:
        raise ValueError(f"templates have more than {MOST_TEMPLATES} characters")
    parts = [(name, Counter(TOKEN.findall(s.lower()))) for name, t in templates.items() for s in sentences(t)]
    seen = Counter(w for _, c in parts for w in c)
    rarest = math.log(1 + len(parts))
    idf = {w: math.log((1 + len(parts)) / n) for w, n in seen.items()}
    whole = [(name, Counter(TOKEN.findall(t.lower()))) for name, t in templates.items()]
    vectors = []
    for name, c in parts + whole:
        v = {w: n * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        if norm:
            vectors.append((name, {w: x / norm for w, x in v.items()}))
    return idf, rarest, vectors


class Matcher:
    """The best template of a passage, with the cosine of their TF-IDF vectors."""

    def __init__(self, p: Params = Params(), templates: Mapping[str, str] = TEMPLATES):
        self.p, self.known = p, {}
        self.idf, self.rarest, self.vectors = weights(templates)
        self.posting = defaultdict(list)  # word -> (vector, weight)
        for i, (_, v) in enumerate(self.vectors):
            for w, x in v.items():
                self.posting[w].append((i, x))

    def cosines(self, passage: str) -> dict[int, tuple[float, int]]:
        """Cosine and shared words of each template vector that shares one."""
        own = {w: n * self.idf.get(w, self.rarest) for w, n in Counter(TOKEN.findall(passage.lower())).items()}
        norm = math.sqrt(sum(x * x for x in own.values()))
        dots, both = defaultdict(float), Counter()
        for w in sorted(own.keys() & self.posting.keys()):
            for i, x in self.posting[w]:
                dots[i] += own[w] * x
                both[i] += 1
        return {i: (dot / norm, both[i]) for i, dot in dots.items()}

    def __call__(self, passage: str) -> tuple[str | None, float]:
        if passage in self.known:
            return self.known[passage]
        best: tuple[str | None, float] = (None, 0.0)
        for i, (score, both) in self.cosines(passage).items():
            name, v = self.vectors[i]
            if score >= self.p.least and both >= min(self.p.least_words, len(v)) and (-score, name) < (-best[1], best[0] or ""):
                best = (name, score)
        if len(self.known) >= 10_000:
            self.known.clear()
        if len(passage) < 500:
            self.known[passage] = best
        return best


def own_licences(files: DataFrame, p: Params = Params(), templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """path, dir, name, license, score of each file by its own text; null where nothing matches."""

    def run(batches):
        match = Matcher(p, templates)
        for batch in batches:
            found = []
            for name, text in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = text.as_py() or ""
                parts = {x for line in text.split("\n") if CUE.search(line) for x in passages(line, p.window) if CUE.search(x)} if CUE.search(text) else set()
                if name and re.match(LICENCE_FILE, name):
                    parts.add(text)
                best = min(((-s, n) for n, s in map(match, parts) if n), default=None)
                found.append((best[1], -best[0]) if best else (None, None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["path", "dir", "name", "license", "score"])

    path = F.col("path").cast("string")
    rows = files.select(path.alias("path"), F.regexp_replace(path, r"/?[^/]*$", "").alias("dir"), F.regexp_extract(path, r"[^/]*$", 0).alias("name"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "path string, dir string, name string, license string, score double")


def scan(files: DataFrame, p: Params = Params(), templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """path, license, score, origin and licensed_by of every file (path, text).

    templates maps licences to headers or full texts. origin is own, inherited or
    null. Of several passages of a file, and of several licence files in a
    directory, the highest score counts, then the name. A null path has no
    directory and inherits nothing; a null or empty text has no licence of its
    own; a very long text is scored passage by passage, a licence file's also as a
    whole; rows that repeat a path are files of their own. An empty table gives no
    rows; other columns are ignored.
    """
    own = shared.staged(own_licences(files, p, templates), "licences")
    granted = own.filter(F.col("license").isNotNull() & F.col("name").rlike(LICENCE_FILE))
    best = granted.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "path")).alias("b")).select(F.col("dir").alias("_above"), "b.license", (-F.col("b.s")).alias("score"), F.col("b.path").alias("licensed_by"))
    # a directory and all above it, the nearest first; their number is the depth of the path
    placed = own.filter(F.col("path").isNotNull())
    parts = F.split("dir", "/")
    above = placed.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_above")).distinct()
    above = shared.staged(above, "directories")
    nearest = shared.dealt_join(above, best, "_above", "inner").groupBy("dir").agg(F.max_by(F.struct("license", "score", "licensed_by"), F.length("_above")).alias("_up"))
    up = nearest.schema["_up"].dataType
    joined = shared.dealt_join(placed, shared.staged(nearest, "nearest"), "dir", "left").unionByName(own.filter(F.col("path").isNull()).withColumn("_up", F.lit(None).cast(up)))
    has = F.col("license").isNotNull()
    return joined.select(
        "path",
        F.when(has, F.col("license")).otherwise(F.col("_up.license")).alias("license"),
        F.round(F.when(has, F.col("score")).otherwise(F.col("_up.score")), 6).alias("score"),
        F.when(has, "own").when(F.col("_up").isNotNull(), "inherited").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("_up.licensed_by")).alias("licensed_by"),
    )


def virtual_files(docs: DataFrame) -> DataFrame:
    """Documents as files of repositories: the source is the repository, the digits of doc_id the directories.

    Every hundredth document is the licence file of its upper directory, every
    tenth of its lower one.
    """
    id_ = F.col("doc_id").cast("long")
    upper = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("none")), F.concat(F.lit("u"), F.floor(id_ / 1000).cast("string")))
    lower = F.concat_ws("/", upper, F.concat(F.lit("v"), F.floor(id_ / 100).cast("string")))
    path = F.when(id_ % 100 == 0, F.concat_ws("/", upper, F.concat(F.lit("COPYING."), F.translate(id_.cast("string"), "0123456789", "abcdefghij")))).when(id_ % 10 == 0, F.concat_ws("/", lower, F.concat(F.lit("LICENSE."), F.translate(id_.cast("string"), "0123456789", "abcdefghij")))).otherwise(F.concat_ws("/", lower, F.concat(id_.cast("string"), F.lit(".txt"))))
    return docs.select(id_.alias("doc_id"), F.when(id_.isNotNull(), path).alias("path"), "text")
