"""Operator 1: license scans by sparse TF-IDF cosine, with directory inheritance.

1. Document frequencies of the templates' words over the whole corpus; any
   other word counts as one that no document has. The vocabulary is the
   templates', so its table is bounded.
2. Every line of a text that holds two words of the vocabulary, one of them a
   MARK, and every run of such lines, is a header candidate; of lines of more
   than LONG words only the stretches around each of their marks. A header is the
   candidate whose TF-IDF vector has the largest cosine with a template, if
   that is HEADER or more. A text is a license file if its name says so, or if
   the whole text's cosine is FILE or more.
3. A file's license holds for its directory and below. A text without header
   takes the license of the nearest ancestor directory that has one: distinct
   directories are joined with their ancestors, then documents with their
   directory, in salted groups.

Defined results: null and empty texts have no license of their own but inherit;
a null path has no directory and inherits nothing; equal scores go to the first
license by name, then the first line; two license files of a directory: the
higher score, then the first license by name; equal rows each give a row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm.common import salted_join, stored

#: Whole texts of two short licenses.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
#: Statements of common licenses.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", _BSD),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", _MIT),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."),
}
#: Words without which a line is no license header, and names of license files.
MARKS = frozenset("license licence licensed licenses copyright permission rights redistribution cc cc0 gpl mit bsd apache mozilla domain".split())
FILE_NAMES = re.compile(r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$")
HEADER, FILE, CALLED, LONG, REACH = 0.6, 0.5, 0.4, 48, 12
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


VOCABULARY = frozenset(w for t in TEMPLATES.values() for s in t for w in words(s))
_HINT = re.compile("(?i)" + "|".join(sorted(MARKS, key=len)))


class Matcher:
    """Cosines with the templates under document frequencies."""

    def __init__(self, frequency: dict[str, int], documents: int):
        top = math.log(1 + documents) + 1
        self.idf = {w: top - math.log(1 + frequency.get(w, 0)) for w in VOCABULARY}
        self.other = top
        self.names, self.of = [], {}
        for name in sorted(TEMPLATES):
            for text in TEMPLATES[name]:
                v = self.vector(words(text))
                size = math.sqrt(sum(x * x for x in v.values()))
                for w, x in v.items():
                    self.of.setdefault(w, []).append((len(self.names), x / size))
                self.names.append(name)

    def vector(self, found: list[str]) -> dict[str, float]:
        return {w: n * self.idf.get(w, self.other) for w, n in Counter(found).items()}

    def best(self, found: list[str]) -> tuple[float, str | None]:
        """The largest cosine and its license; only words of the templates are looked at, by an inverted index."""
        v = self.vector(found)
        norm, dots = math.sqrt(sum(x * x for x in v.values())), [0.0] * len(self.names)
        for w in self.of.keys() & v.keys():
            for template, x in self.of[w]:
                dots[template] += x * v[w]
        score, name = 0.0, None
        for template, dot in enumerate(dots):
            if dot > 0 and dot / norm > score + 1e-12:
                score, name = dot / norm, self.names[template]
        return score, name


def candidates(text: str) -> list[list[str]]:
    """Word lists of header candidates, in order."""
    out, run = [], []
    for line in [*text.split("\n"), ""]:
        found = words(line) if _HINT.search(line) else []
        marks = [i for i, w in enumerate(found) if w in MARKS]
        if not marks or sum(w in VOCABULARY for w in found) < 2:
            if len(run) > 1:
                out.append([w for x in run for w in x])
            run = []
            continue
        if len(found) > LONG:
            begin = max(0, marks[0] - REACH)
            for a, b in zip(marks, [*marks[1:], len(found) + 3 * REACH], strict=True):
                if b - a > REACH:
                    out.extend(_inner(found[begin : a + REACH]))
                    begin = max(0, b - REACH)
        else:
            out.append(found)
            run.append(found)
    return out


def _inner(found: list[str]) -> list[list[str]]:
    """Stretches from the first to the last vocabulary word around each mark: prose beside a statement is no part of it."""
    out, j = [], -1
    for mark, w in enumerate(found):
        if w not in MARKS or mark <= j:
            continue  # a mark within the last stretch has the same one
        i = j = mark
        while i > 0 and (found[i - 1] in VOCABULARY or (i > 1 and found[i - 2] in VOCABULARY)):
            i -= 1
        while j + 1 < len(found) and (found[j + 1] in VOCABULARY or (j + 2 < len(found) and found[j + 2] in VOCABULARY)):
            j += 1
        out.append(found[i : j + 1])
    return out


def _count(batches):
    seen, n = Counter(), 0
    for batch in batches:
        for text in batch.column(0):
            seen.update(VOCABULARY.intersection(words(text.as_py() or "")))
            n += 1
    seen["\0"] = n
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Documents that hold each word of the vocabulary, and all documents."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {r.word: r.n for r in rows.collect()}  # a row for each word of the templates
    return seen, seen.pop("\0", 0)


def _score(matcher: Matcher):
    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or ""
                score, name = 0.0, None
                for found in candidates(text):
                    s, t = matcher.best(found)
                    if s > score + 1e-12:
                        score, name = s, t
                called = bool(path and FILE_NAMES.match(path.rpartition("/")[2]))
                whole, template = matcher.best(words(text))
                file = whole >= (CALLED if called else FILE)
                own = name if score >= HEADER else template if file else None
                file = file or called and own is not None  # a license file may hold little but its header
                rows.append((own, round(max(score, whole) if own else score, 6), file))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], ["doc_id", "path", "own", "score", "is_file"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, path, text): doc_id, license, score, origin (header, file, inherited or none) and license_dir."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    seen, n = frequencies(docs)
    rows = stored(docs.mapInArrow(_score(Matcher(seen, n)), "doc_id long, path string, own string, score double, is_file boolean"), "licenses")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    rows = rows.withColumn("dir", folder)
    licensed = rows.filter("is_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("own"))).alias("b")).select(F.col("dir").alias("license_dir"), F.col("b.own").alias("given"))
    licensed = stored(licensed, "license-dirs")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")))
    dirs = rows.select("dir").filter("dir is not null").distinct().withColumn("a", F.explode(above)).select("dir", "a.depth", "a.up")
    near = dirs.join(licensed, F.col("up") == F.col("license_dir")).groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "given")).alias("n")).select("dir", "n.license_dir", "n.given")
    out = salted_join(rows, stored(near, "license-near"), ["dir"], F.xxhash64("doc_id", "path"))
    inherited = F.col("own").isNull() & F.col("given").isNotNull()
    return out.select(
        "doc_id",
        F.coalesce("own", "given").alias("license"),
        "score",
        F.when(F.col("own").isNotNull() & F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("license_dir")).alias("license_dir"),
    )


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """documents as files <source>/<lang>/<doc_id>.txt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
