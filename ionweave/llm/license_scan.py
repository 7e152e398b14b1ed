"""License scans: sparse TF-IDF cosine to templates, then nearest-ancestor inheritance.

A file is compared with each template line by line (headers and notices), as a
whole (licence files), and by windows of as many terms as the template has
(notices wrapped over lines or inside a long one): every window that holds an
anchor is scored, the best of each run of overlapping ones is a unit, and its
line is where it starts.  A window yields to a longer match of another license
that covers more than half of it with a cosine less by under ``CLOSE``
(BSD-2-Clause is the beginning of BSD-3-Clause).
A match also needs the template's decisive terms: what stands of the license's name in
it, its version with the word before ("version 3"), and exactly its qualifiers (lesser, affero, noncommercial, ...), so a
notice of a license without a template is not given a similar one's name.
Terms are lower-cased words; weights are
log-frequency times inverse document frequency, and the document frequencies
of all terms are counted over all files.  A cosine of ``COSINE`` or more is a match; the best template wins, ties
go to the first by name.

Exact prefilter: a template is only compared with texts that hold one of its
anchors, its heaviest terms in order until the rest weighs less than ``COSINE``
of its norm - without an anchor no cosine can reach the threshold.  Nor can it
in a file whose terms make up less than ``COSINE`` of the norm of each template.
The few files left get the frequencies of their terms by a join; the templates'
own terms are all that is broadcast.

A file named like a licence (LICENSE, COPYING, ...) that matches licenses its
directory.  A file without a match of its own takes the license of its nearest
ancestor directory: each distinct directory is expanded to its ancestors, joined
with the licensed ones, and the deepest wins; hot ancestors (the root) and hot
directories are dealt over parts.

Cases: null text counts as empty and matches nothing; null paths are scanned
and inherit nothing; ``doc_id`` is carried as it is, also null; of several licence
files in a directory the best score, then the first path, counts; repeated rows give
repeated results; further columns are ignored; long lines and texts are read whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join, look_up, read_table, slices

COSINE = 0.8
CLOSE = 0.1
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice|copyright)([-._].*)?$"
#: Short notices as their licences recommend or projects commonly write them.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the BSD 2-Clause License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 3-Clause License.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License - v 2.0"),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",),
}


def with_identifiers(notices: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """``notices`` and the SPDX line of every license, the GNU ones also with their suffixes."""
    out = {}
    for name, texts in notices.items():
        suffixes = ("", "-only", "-or-later") if "GPL" in name else ("",)
        lines = [f"SPDX-License-Identifier: {name}{x}" for x in suffixes]
        out[name] = (*texts, *[x for x in lines if x not in texts])
    return out


TEMPLATES = with_identifiers(NOTICES)
#: Terms that make another license of a text: a unit holds the same of them as its template.
QUALIFIERS = frozenset(("lesser", "affero", "noncommercial", "nc", "sharealike", "sa", "noderivatives", "noderivs", "nd", "agpl", "lgpl"))
_VERSION = re.compile(r"-(\d+(?:\.\d+)+)$")
_TERM = re.compile(r"[^\W_]+")
#: Terms counted in a task before they are handed on.
_HELD = 100_000


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def decisive(name: str, words: list[str]) -> tuple[frozenset[str], frozenset[str], list[str]]:
    """What a unit needs to match a template with ``words``: terms of the license's name, qualifiers, version.

    The version is a run of terms: its numbers as they stand in the template, with the term before them.
    """
    version = _VERSION.search(name)
    plain = terms(name[: version.start()] if version else name)
    numbers = terms(version[1]) if version else []
    whole = all(t in words for t in plain)
    named = frozenset(t for t in plain if t in words and (whole or not t.isdigit()))
    run = []
    if numbers and numbers[0] in words:
        at = end = words.index(numbers[0])
        while end < len(words) and words[end : end + 1] == numbers[end - at : end - at + 1]:
            end += 1
        run = words[max(0, at - 1) : end]
    return named, QUALIFIERS & frozenset(words), run


def _holds(words: list[str], run: list[str]) -> bool:
    return not run or any(words[i : i + len(run)] == run for i, t in enumerate(words) if t == run[0])


def _template_rows(templates) -> list[tuple[str, list[str]]]:
    return [(name, terms(text)) for name in sorted(templates) for text in templates[name]]


class Matcher:
    """Templates as unit TF-IDF vectors with their anchors; ``frequency`` has the templates' terms."""

    def __init__(self, templates, frequency: dict[str, int], files: int):
        self.files = files
        self.idf = {}
        rows = _template_rows(templates)
        for _, words in rows:
            for t in words:
                self.idf[t] = self.weight(frequency.get(t, 0))
        self.once = self.weight(1)
        self.names, self.vectors, self.own, self.sizes, self.needs, anchors = [], [], [], [], [], set()
        self.postings: dict[str, list[int]] = {}
        for name, words in rows:
            vector = self._vector(Counter(words))
            norm = math.sqrt(sum(x * x for x in vector.values())) or 1.0
            vector = {t: x / norm for t, x in vector.items()}
            rest, own = 1.0, set()
            for t in sorted(vector, key=lambda t: (-vector[t], t)):
                if rest < COSINE * COSINE - 1e-9:
                    break
                own.add(t)
                rest -= vector[t] ** 2
            anchors |= own
            for t in own:
                self.postings.setdefault(t, []).append(len(self.names))
            self.own.append(frozenset(own))
            self.sizes.append(len(words))
            self.names.append(name)
            self.vectors.append(vector)
            self.needs.append(decisive(name, words))
        self.any_anchor = frozenset(anchors)

    def weight(self, n: int) -> float:
        """Inverse document frequency of a term that ``n`` files hold."""
        return math.log((1 + self.files) / (1 + n)) + 1e-9

    def _vector(self, counts: Counter, idf: dict[str, float] | None = None) -> dict[str, float]:
        """``idf`` has the terms besides the templates' that more than one file holds."""
        other = idf or {}
        return {t: (1 + math.log(n)) * (self.idf[t] if t in self.idf else other.get(t, self.once)) for t, n in counts.items()}

    def _possible(self, seen: set[str]) -> list[int]:
        """Templates that some unit with terms of ``seen`` may match: a cosine is at most the norm of the shared part."""
        rivals = {i for t in self.postings.keys() & seen for i in self.postings[t]}
        return [i for i in sorted(rivals) if sum(x * x for t, x in self.vectors[i].items() if t in seen) >= COSINE * COSINE - 1e-9]

    def open_terms(self, text: str | None) -> list[str] | None:
        """The terms whose frequencies ``scan`` needs besides the templates', None if nothing can match."""
        seen = set(terms(text or ""))
        return sorted(seen - self.idf.keys()) if self._possible(seen) else None

    def best(self, words: list[str], idf: dict[str, float] | None = None) -> tuple[float, str | None]:
        """(cosine, name) of the best template for a unit's terms, (0, None) below the threshold."""
        counts = Counter(words)
        rivals = {i for t in self.postings.keys() & counts.keys() for i in self.postings[t]}
        if not rivals:
            return 0.0, None
        vector = self._vector(counts, idf)
        norm = math.sqrt(sum(x * x for x in vector.values())) or 1.0
        qualifiers = QUALIFIERS & counts.keys()
        fit = [i for i in sorted(rivals) if self.needs[i][0] <= counts.keys() and self.needs[i][1] == qualifiers]
        found = [(sum(x * vector.get(t, 0.0) for t, x in self.vectors[i].items()) / norm, i) for i in fit]
        for score, i in sorted(found, key=lambda x: (-round(x[0], 12), x[1])):
            if score < COSINE - 1e-12:
                break
            if _holds(words, self.needs[i][2]):
                return score, self.names[i]
        return 0.0, None

    def _slide(self, words: list[str], i: int, low: int, high: int, idf: dict[str, float]) -> int:
        """Start, from ``low`` to ``high``, of the window most like template i; the first of equals."""
        size, template = self.sizes[i], self.vectors[i]
        best, at = -1.0, low
        fresh = True
        for start in range(low, high + 1):
            if not fresh:
                for t, step in ((words[start - 1], -1), (words[start + size - 1], 1)):
                    n = counts[t]
                    old = (1 + math.log(n)) * weight[t] if n else 0.0
                    weight[t] = weight.get(t) or self._vector({t: 1}, idf)[t]
                    counts[t] = n + step
                    new = (1 + math.log(n + step)) * weight[t] if n + step else 0.0
                    dot += (new - old) * template.get(t, 0.0)
                    square += new * new - old * old
            if fresh or square < 1e-6:  # too small for differences
                counts = Counter(words[start : start + size])
                weight = self._vector(dict.fromkeys(counts, 1), idf)
                vector = self._vector(counts, idf)
                dot = sum(x * template.get(t, 0.0) for t, x in vector.items())
                square = sum(x * x for x in vector.values())
                fresh = False
            score = round(dot / (math.sqrt(square) or 1.0), 9)
            if score > best:
                best, at = score, start
        return at

    def _windows(self, words: list[str], idf: dict[str, float]) -> list[tuple[int, int]]:
        """(begin, end) in ``words`` of the best window of each run of windows that hold an anchor, for every template."""
        out = set()
        for i in self._possible(set(words)):
            size, last = self.sizes[i], len(words) - self.sizes[i]
            if last <= 0:
                continue
            runs: list[list[int]] = []
            for p, t in enumerate(words):
                if t in self.own[i]:
                    low, high = max(0, p - size + 1), min(p, last)
                    if runs and low <= runs[-1][1] + 1:
                        runs[-1][1] = high
                    else:
                        runs.append([low, high])
            for low, high in runs:
                at = self._slide(words, i, low, high, idf)
                out.add((at, at + size))
        return sorted(out)

    def scan(self, text: str | None, idf: dict[str, float] | None = None) -> tuple[str | None, float, int | None]:
        """(name, cosine, line) of the best unit; line 0 is the whole text, None is no match."""
        lines = [terms(line) for line in (text or "").split("\n")]
        words = [t for line in lines for t in line]
        if self.any_anchor.isdisjoint(words):
            return None, 0.0, None
        ends = list(accumulate(map(len, lines)))
        units = [(n, end - len(line), end, False) for n, (line, end) in enumerate(zip(lines, ends), 1) if not self.any_anchor.isdisjoint(line)]
        if len(lines) > 1:
            units.append((0, 0, len(words), False))
        units += [(bisect_right(ends, begin) + 1, begin, end, True) for begin, end in self._windows(words, idf or {})]
        found = [(*self.best(words[begin:end], idf), line, begin, end, window) for line, begin, end, window in units]
        found = [u for u in found if u[1]]
        longest = [u for u in found if not (u[5] and any(self._yields(u, v) for v in found))]
        # of equals the first line counts, then the longest unit
        score, name, line, *_ = max(longest, key=lambda u: (round(u[0], 12), -u[2], u[4] - u[3]), default=(0.0, None, None))
        return name, score, line

    @staticmethod
    def _yields(unit: tuple, other: tuple) -> bool:
        (score, name, _, begin, end), (best, rival, _, b, e) = unit[:5], other[:5]
        return name != rival and best > score - CLOSE and e - b > end - begin and 2 * (min(e, end) - max(b, begin)) > end - begin


def count_terms(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(term, n): how many files hold each term; the term "" stands for all files.

    Terms of one file are left out, except the templates': a file's term that is not listed is held by that file alone.
    """

    def rows(total: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    def count(batches):
        total: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                total[""] += 1
                if text:
                    total.update(set(terms(text)))
                if len(total) >= _HELD:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    listed = ["", *sorted({t for _, words in _template_rows(templates) for t in words})]
    counted = files.select(F.col("text").cast("string")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return cut(counted.where((F.col("n") > 1) | F.col("term").isin(listed)))


def train(counted: DataFrame, templates=TEMPLATES) -> Matcher:
    """Templates weighted by the counts of all files."""
    listed = ["", *sorted({t for _, words in _template_rows(templates) for t in words})]
    frequency = {r.term: r.n for r in counted.where(F.col("term").isin(listed)).collect()}  # at most one row per template term
    return Matcher(templates, frequency, frequency.pop("", 0))


def match_files(files: DataFrame, matcher: Matcher, counted: DataFrame) -> DataFrame:
    """(doc_id, path, license, score, line) of every row of files(doc_id, path, text)."""
    held = files.sparkSession.sparkContext.broadcast(matcher)

    def open_files(batches):
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            found = [held.value.open_terms(t) for t in texts]
            kept = [t if f is not None else None for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "path", "text", "terms"])

    def run(batches):
        for batch in slices(batches, 64):
            found = []
            for text, own, counts in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                found.append(held.value.scan(text, {t: held.value.weight(n) for t, n in zip(own or [], counts or [])}))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "path", "license", "score", "line"])

    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(open_files, "doc_id long, path string, text string, terms array<string>")
    rows = cut(rows.withColumn("id", F.monotonically_increasing_id()))  # the ids stay as the lineage ends here
    few = rows.where(F.col("terms").isNotNull())
    words = few.select("id", F.explode("terms").alias("term"))
    priced = hot_join(words, counted, words.groupBy("term").agg(F.count("*").alias("n")), "term", ["id"]).where(F.col("n").isNotNull())
    priced = priced.groupBy("id").agg(F.collect_list(F.struct("term", "n")).alias("priced"))
    ready = few.join(priced, "id", "left").select("doc_id", "path", "text", F.col("priced.term").alias("own"), F.col("priced.n").alias("counts"))
    shape = "doc_id long, path string, license string, score double, line int"
    none = (F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("line"))
    return rows.where(F.col("terms").isNull()).select("doc_id", "path", *none).union(ready.mapInArrow(run, shape))


def inherit(matched: DataFrame) -> DataFrame:
    """Adds inherited_from: the licence file whose directory is the nearest ancestor."""
    base = F.element_at(F.split("path", "/"), -1)
    matched = matched.withColumn("dir", F.regexp_replace("path", "(^|/)[^/]*$", ""))
    granted = matched.where(F.col("license").isNotNull() & base.rlike(LICENCE_FILE))
    granted = granted.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("g"))
    granted = cut(granted.select(F.col("dir").alias("above"), F.col("g.path").alias("giver"), F.col("g.license").alias("given")))
    bare = matched.where(F.col("license").isNull() & F.col("path").isNotNull()).groupBy("dir").agg(F.count("*").alias("n"))
    bare = cut(bare)
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))
    above = bare.select("dir", F.explode(F.transform(depths, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))).alias("a"))
    above = above.select("dir", "a.depth", "a.above")
    near = look_up(above, granted, above.groupBy("above").agg(F.count("*").alias("n")), "above", ["dir"]).where(F.col("giver").isNotNull())
    near = cut(near.groupBy("dir").agg(F.max_by(F.struct("giver", "given"), "depth").alias("near")))
    out = look_up(matched, near, bare, "dir", ["path"])
    return out.select("doc_id", "path", F.coalesce("license", "near.given").alias("license"), "score", "line", F.when(F.col("license").isNull(), F.col("near.giver")).alias("inherited_from"))


def matches(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``match_files`` with templates weighted by these files, kept."""
    counted = count_terms(files, templates)
    return cut(match_files(files, train(counted, templates), counted))


def scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, path, license, score, line, inherited_from) of files(path, text) with or without doc_id."""
    if "doc_id" not in files.columns:
        files = files.withColumn("doc_id", F.lit(None).cast("long"))
    return inherit(matches(files, templates))


#: Documents of one source whose ids share a directory of the query, per level.
TREE = (10_000, 1000)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source and id, ``<source>/<id div 10000>/<id div 1000>/<id>``.

    The table has no paths.  A document with a notice of its own stands as its
    directory's licence file, ``LICENSE-<id>``, so the others inherit from the nearest.
    """
    docs = read_table(spark, sf_dir, "documents")
    source = F.coalesce("source", F.lit("unknown"))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    levels = [F.coalesce(F.floor(F.col("doc_id") / n).cast("string"), F.lit("none")) for n in TREE]
    found = matches(docs.select("doc_id", F.concat_ws("/", source, *levels, ident).alias("path"), "text"))
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    named = F.when(F.col("license").isNotNull(), F.concat(folder, F.lit("/LICENSE-"), name)).otherwise(F.col("path"))
    return inherit(found.withColumn("path", named))


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLE_SQL: dict[str, str] = {}
