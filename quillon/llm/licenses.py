"""License scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance down directories.

Templates are the full texts of licences (``license_texts``) and notices: standard headers, titles, one-line notices.
A file's lines and paragraphs are compared with the notices; runs of its paragraphs that line up with those of a full
text, and a licence file as a whole, are compared with that text. All are sparse TF-IDF vectors; a file's own licence is
that of the nearest template at or above the threshold, so texts that share most of their words (two and three clauses,
versions 2 and 3) are told apart by what differs. Document frequencies come from all texts: each task counts the texts
that hold each template word, and the counts are summed; a word that no template holds cannot add to a product and
weighs as a word that no text holds. Only template words are counted, so the statistics have a fixed size whatever the
corpus.

A file without a licence of its own takes that of the nearest ancestor directory with a licence file, by a join of the
ancestors of all directories with the licence directories. Shallow directories, which are ancestors of very many, are
dealt to several join keys each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch, Shared, bounded_batches, materialize


def _gnu(program: str, name: str, version: str) -> str:
    """Fixed text: the standard header of the GNU licences."""
    return (
        f"{program} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; "
        f"either version {version} of the License, or (at your option) any later version. {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


#: Fixed list: notices by SPDX identifier.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "MIT License"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _gnu("This program", "GNU General Public License", "2"), "GNU General Public License Version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _gnu("This program", "GNU General Public License", "3"), "GNU General Public License Version 3, 29 June 2007"),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", _gnu("This library", "GNU Lesser General Public License", "2.1"), "GNU Lesser General Public License Version 2.1, February 1999"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", _gnu("This library", "GNU Lesser General Public License", "3"), "GNU Lesser General Public License Version 3, 29 June 2007"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", _gnu("This program", "GNU Affero General Public License", "3"), "GNU Affero General Public License Version 3, 19 November 2007"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "BSD 2-Clause License"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "BSD 3-Clause License"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ),
    "ISC": ("Licensed under the ISC License.", "ISC License"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Proprietary": ("All rights reserved. Unauthorized copying of this file is strictly prohibited.",),
}

THRESHOLD = 0.75
#: Directories of less depth are dealt to so many join keys.
SHALLOW, SALTS = 3, 32
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"


def read_texts() -> dict[str, str]:
    """The full licence texts by SPDX identifier."""
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def notices_of(notices: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """The notices, and the identifier line of each licence."""
    return {name: (*given, f"SPDX-License-Identifier: {name}") for name, given in notices.items()}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Index:
    """Templates as normalised sparse vectors, inverted by word."""

    def __init__(self, templates: list[tuple[object, str]], idf: dict[str, float], rare: float):
        self.idf, self.rare = idf, rare
        self.names: list[object] = []
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for name, text in templates:
            weights = self.weigh(words_of(text))
            norm = math.sqrt(sum(w * w for w in weights.values()))
            for word, w in weights.items():
                self.postings.setdefault(word, []).append((len(self.names), w / norm))
            self.names.append(name)
        self.most = {word: max(w for _, w in held) for word, held in self.postings.items()}

    def weigh(self, words: list[str]) -> dict[str, float]:
        return {w: (1 + math.log(n)) * self.idf.get(w, self.rare) for w, n in Counter(words).items()}

    def near(self, words: list[str]) -> list[tuple[float, int]]:
        """Cosine and number of the templates at or above the threshold."""
        known = {w for w in words if w in self.postings}
        if not known:
            return []
        weights = self.weigh(words)
        norm = math.sqrt(sum(w * w for w in weights.values()))
        # No template is nearer than if it had the most weight that any has for each word, nor, by Cauchy-Schwarz, than
        # the share of the stretch's length that lies on template words.
        if sum(self.most[w] * weights[w] for w in known) < (THRESHOLD - 1e-9) * norm or math.sqrt(sum(weights[w] ** 2 for w in known)) < THRESHOLD * norm - 1e-9:
            return []
        products: dict[int, float] = {}
        for w in known:
            for at, x in self.postings[w]:
                products[at] = products.get(at, 0.0) + x * weights[w]
        return [(min(1.0, p / norm), at) for at, p in products.items() if p >= THRESHOLD * norm - 1e-12]


class Scanner:
    """The indexes of notices, of the paragraphs of full texts, and of full texts."""

    def __init__(self, given: tuple[dict[str, tuple[str, ...]], dict[str, str], dict[str, int], int]):
        notices, full, frequency, texts = given
        idf = {w: math.log((1 + texts) / (1 + n)) + 1 for w, n in frequency.items()}
        rare = math.log(1 + texts) + 1
        self.notices = Index([(name, x) for name in sorted(notices) for x in notices[name]], idf, rare)
        parts = {name: list(paragraphs(x.split("\n"))) for name, x in sorted(full.items())}
        self.paragraphs = Index([((i, j), " ".join(p)) for i, ps in enumerate(parts.values()) for j, p in enumerate(ps) if words_of(" ".join(p))], idf, rare)
        self.wholes = Index(sorted(full.items()), idf, rare)
        self.lengths = [len(ps) for ps in parts.values()]

    def scan(self, text: str | None, whole: bool) -> tuple[str | None, float]:
        """A file's own licence, or None, and the cosine of the nearest stretch that is near enough (0 if none)."""
        if not text:
            return None, 0.0
        lines = text.split("\n")
        found = [(c, self.notices.names[at]) for line in lines for c, at in self.notices.near(words_of(line))]
        held = [words_of(" ".join(p)) for p in paragraphs(lines)]
        runs = set()
        for i, words in enumerate(held):
            found += [(c, self.notices.names[at]) for c, at in self.notices.near(words)]
            for _, at in self.paragraphs.near(words):
                licence, j = self.paragraphs.names[at]
                runs.add((max(0, i - j), max(0, i - j + self.lengths[licence])))
        stretches = [sum(held[a:b], []) for a, b in sorted(runs)] + [words_of(text)] * whole
        found += [(c, self.wholes.names[at]) for words in stretches for c, at in self.wholes.near(words)]
        found += [(c, self.notices.names[at]) for c, at in self.notices.near(words_of(text))] if whole else []
        if not found:
            return None, 0.0
        cosine, name = min(found, key=lambda m: (-round(m[0], 12), m[1]))
        return name, cosine


def paragraphs(lines: list[str]) -> Iterator[list[str]]:
    """Runs of lines with a letter or digit; a line of comment marks alone divides as an empty one does."""
    held: list[str] = []
    for line in [*lines, ""]:
        if any(map(str.isalnum, line)):
            held.append(line)
        elif held:
            yield held
            held = []


def document_frequencies(df: DataFrame, text: str, vocabulary: frozenset[str]) -> tuple[dict[str, int], int]:
    """In how many texts each word of the vocabulary stands, and the number of texts: sums of each task's counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = Counter(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for x in batch.column(0).slice(at, 256).to_pylist():
                    texts += 1
                    if x:
                        counts.update(vocabulary.intersection(words_of(x)))
        yield pa.RecordBatch.from_arrays([pa.array(["", *counts]), pa.array([texts, *counts.values()], pa.int64())], ["word", "n"])

    sums = df.select(F.col(text).cast("string")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in sums.collect()}  # a row for each template word at most
    texts = found.pop("", 0)
    return {w: found.get(w, 0) for w in vocabulary}, texts


def _ancestors(directory: Column) -> Column:
    """A directory and each above it, and their depths; the root is the empty path."""
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))


def scan(df: DataFrame, key: str, path: str, text: str, notices: dict = NOTICES, full_texts: dict[str, str] | None = None) -> DataFrame:
    """``key``, ``path``, ``own_license``, ``cosine``, ``license``, ``inherited_from`` of each row.

    ``license`` is the file's own, else that of the nearest ancestor directory (its own directory included) whose
    licence file (LICENSE, COPYING, NOTICE, UNLICENSE, with any ending) has one, else null; ``inherited_from`` is that
    directory. Several licence files of one directory: the largest cosine, then the first name. Null or empty texts have
    no licence of their own; a null path inherits nothing; repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """
    notices, full = notices_of(notices), read_texts() if full_texts is None else full_texts
    vocabulary = frozenset(w for x in [*(n for given in notices.values() for n in given), *full.values()] for w in words_of(x))
    frequency, texts = document_frequencies(df, text, vocabulary)
    shared = Shared(df.sparkSession, (notices, full, frequency, texts))
    folder = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    out = T.StructType([df.schema[key], *(T.StructField(n, T.StringType()) for n in ("path", "folder")), T.StructField("is_file", T.BooleanType()), T.StructField("own_license", T.StringType()), T.StructField("cosine", T.DoubleType())])
    rows = df.select(key, F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    rows = rows.select(key, "path", folder.alias("folder"), F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(_FILE), F.lit(False)).alias("is_file"), "text")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.built(Scanner)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [scanner.scan(x, f) for x, f in zip(part.column(4).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], out.names)

    own = materialize(bounded_batches(rows).mapInArrow(scanned, out), "licenses")
    with Scratch(df.sparkSession, "license-folders") as scratch:
        folders = own.filter("is_file and own_license is not null").groupBy(F.col("folder").alias("dir"))
        folders = folders.agg(F.min(F.struct(-F.col("cosine"), "own_license")).alias("best")).select("dir", F.col("best.own_license").alias("dir_license"))
        depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
        folders = scratch.table(folders.withColumn("salt", F.explode(F.when(depth < SHALLOW, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))), "folders")
        # Directories of files without a licence of their own meet the licence directories; the deepest is the nearest.
        bare = own.filter("own_license is null and folder is not null").select("folder").distinct()
        salt = F.when(F.col("depth") < SHALLOW, F.pmod(F.xxhash64("folder"), F.lit(SALTS)).cast("int")).otherwise(0)
        above = bare.select("folder", F.inline(_ancestors(F.col("folder")))).withColumn("salt", salt).join(folders, ["dir", "salt"])
        nearest = above.groupBy("folder").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("n")).select(F.col("folder").alias("f"), "n.dir", "n.dir_license")
        nearest = materialize(nearest, "license-inherited")
    joined = own.join(nearest, (own["folder"] == nearest["f"]) & own["own_license"].isNull(), "left")
    return joined.select(key, "path", "own_license", "cosine", F.coalesce("own_license", "dir_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("dir")).alias("inherited_from"))
