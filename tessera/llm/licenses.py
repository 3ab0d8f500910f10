"""License scan by conditional compression.

A notice is the wording of a template with at most DIFFERENCES of its words different
(none, if it has few words); license names and numbers may not differ. So if a template
is cut into one piece more than words may differ, one of its pieces stands in the notice
word for word. Candidate blocks are the stretches of a text around such pieces, wide
enough for the template they are from, merged where they meet: no notice lies outside.

Every block is compressed alone and with each template as a raw zstandard dictionary;
the template that a block's content comes from saves the most bytes. The templates that
have a piece in the block are ranked by bytes saved, as a share of what they save on
themselves, and confirmed in that order by their exact wording: the template's words are
aligned with the block's at the least number of word differences, for every place where a
run of words can end. Ranks order, they leave none out: beside other notices a short one
may have nothing left to save.
Runs within the allowed differences are notices; of those of one template that overlap
the one with fewest differences stays, and all that don't overlap it are kept. Where
notices of several templates overlap, the longest stays, then the one with fewer
differences, then the one that saves more, then the one of the first template.

Texts without any of the pieces' longest words are passed over after one search for
them all (an automaton); others are cut into words whole.

Defined results: a null or empty text has no blocks, an empty table no rows. Case,
punctuation and line breaks don't matter to the wording. Repeated rows are scanned
alike; other columns are not touched, whatever their names. Texts are read once,
without a shuffle. Very long texts are scanned whole; blocks of very many words in parts
that overlap by the longest template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load

#: Notices as their licenses word them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0 text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "BSD notice": "Released under the BSD License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "BSD-3-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "BSL-1.0 text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
        "and to permit third-parties to whom the Software is furnished to do so"
    ),
    "Zlib text": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions"
    ),
    "LGPL header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}
#: What licenses are called.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL v3", "GPLv3", "GPL-3.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL v2", "GPLv2", "GPL-2.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0"],
    "BSD": ["BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "ISC": ["ISC License"],
    "EPL-2.0": ["Eclipse Public License 2.0", "EPL-2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND-4.0"],
}
#: Words that may not differ, besides those with digits.
FIRM = set("mit apache gnu lesser affero library mozilla boost eclipse bsd isc cc by by-sa by-nc by-nd not".split())


def short_forms() -> dict[str, str]:
    """What stands for a license in few words: a tag, "under" its name, and names long enough to mean nothing else."""
    out = {}
    for name, calls in NAMES.items():
        out[f"{name} tag"] = f"SPDX-License-Identifier: {name}"
        for n, call in enumerate(calls):
            out[f"{name} under-{n}"] = f"under {call}"
            out[f"{name} under-the-{n}"] = f"under the {call}"
            if len(call.split()) > 3:
                out[f"{name} name-{n}"] = call
    return out


TEMPLATES = NOTICES | short_forms()
LEVEL = 9
#: Largest share of a template's words that may differ; templates of fewer words than LONG must match exactly.
DIFFERENCES, LONG = 0.1, 10
#: Words of a block that are scanned at once.
PART = 4000
NEVER = 1 << 20
WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in WORDS.finditer(text)]


def firm(word: str) -> bool:
    return word in FIRM or any(c.isdigit() for c in word)


def align(template: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every end of a run of words: the least number of differences of the template against such a run, and where the run begins."""
    n = len(words)
    at = np.arange(n + 1)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    cost, begin = np.zeros(n + 1, np.int64), at.copy()
    for t in template:
        price = NEVER if firm(t) else 1
        swap = cost[:-1] + price * (ids != number.get(t, -1))
        skip = cost[1:] + price
        best = np.concatenate([[cost[0] + price], np.minimum(swap, skip)])
        source = np.concatenate([[0], np.where(swap <= skip, begin[:-1], begin[1:])])
        # what costs one word more to the left may still be less
        cost = np.minimum.accumulate(best - at) + at
        begin = source[np.maximum.accumulate(np.where(best == cost, at, 0))]
    return cost, begin


def apart(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of runs (differences, begin, end), those with fewest differences, then the longest, then the first, that don't overlap one another."""
    kept: list[tuple[int, int, int]] = []
    begins: list[int] = []
    for d, a, b in sorted(runs, key=lambda r: (r[0], r[1] - r[2], r[1])):
        k = bisect_left(begins, a)
        if (k == 0 or kept[k - 1][2] <= a) and (k == len(kept) or kept[k][1] >= b):
            kept.insert(k, (d, a, b))
            begins.insert(k, a)
    return kept


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.texts = [t.lower() for t in templates.values()]
        self.words = [[w for w, _, _ in words_of(t)] for t in templates.values()]
        self.allowed = [int(DIFFERENCES * len(w)) if len(w) >= LONG else 0 for w in self.words]
        raw = [zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for t in self.texts]
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d) for d in raw]
        # what a template saves on itself
        self.most = [max(1, len(self.alone.compress(t.encode())) - len(c.compress(t.encode()))) for t, c in zip(self.texts, self.given, strict=True)]
        self.longest = max((len(w) + d for w, d in zip(self.words, self.allowed, strict=True)), default=0)
        #: word -> (piece, the word's place in it, the piece's place in its template, template)
        self.pieces: dict[str, list[tuple[list[str], int, int, int]]] = {}
        for k, (words, d) in enumerate(zip(self.words, self.allowed, strict=True)):
            edges = [len(words) * i // (d + 1) for i in range(d + 2)]
            for a, z in zip(edges, edges[1:], strict=False):
                if z > a:
                    piece = words[a:z]
                    at = max(range(len(piece)), key=lambda i: len(piece[i]))
                    self.pieces.setdefault(piece[at], []).append((piece, at, a, k))
        self.finder = ahocorasick.Automaton()
        for w in self.pieces:
            self.finder.add_word(w, w)
        self.finder.make_automaton()

    def blocks(self, words: list[str]) -> list[tuple[int, int, set[int]]]:
        """Runs of words around pieces, wide enough for their templates, merged where they meet; long ones in overlapping parts. Each with the templates that have a piece in it."""
        found = []
        for i, w in enumerate(words):
            for piece, at, place, k in self.pieces.get(w, ()):
                p = i - at
                if p >= 0 and words[p : p + len(piece)] == piece:
                    a = p - place - self.allowed[k]
                    found.append((max(0, a), min(len(words), p - place + len(self.words[k]) + self.allowed[k]), k))
        merged: list[tuple[int, int, list[tuple[int, int, int]]]] = []
        for a, z, k in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], z), merged[-1][2])
            else:
                merged.append((a, z, []))
            merged[-1][2].append((a, z, k))
        step = max(PART, 2 * self.longest)
        out = []
        for a, z, of in merged:
            for x in range(a, max(a + 1, z - self.longest), step - self.longest):
                y = min(x + step, z)
                out.append((x, y, {k for b, e, k in of if b < y and e > x}))
        return out

    def rank(self, block: str, templates: Iterable[int]) -> list[tuple[float, int]]:
        """Of these templates, the share of what they save on themselves that they save on the block; best first."""
        data = block.lower().encode("utf-8", "surrogatepass")
        plain = len(self.alone.compress(data))
        saved = [(plain - len(self.given[k].compress(data)), k) for k in templates]
        return sorted(((s / self.most[k], k) for s, k in saved), key=lambda x: (-x[0], x[1]))

    def confirm(self, block: str, words: list[str], templates: Iterable[int]) -> list[tuple[int, int, int, int, int]]:
        """(first word, last word + 1, differences, rank, template) of the block's notices: winners first, but none is left out for what it saves."""
        have, hits = set(words), []
        for place, (_, k) in enumerate(self.rank(block, templates)):
            need, d = self.words[k], self.allowed[k]
            if sum(w not in have for w in need) <= d:
                cost, begin = align(need, words)
                runs = [(int(cost[e]), int(begin[e]), int(e)) for e in np.flatnonzero(cost <= d) if begin[e] < e]
                hits += [(a, b, c, place, k) for c, a, b in apart(runs)]
        return hits

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, int]]]:
        """Number of blocks, and confirmed spans (start, end, template, differences) in order."""
        if not text or next(self.finder.iter(text.lower()), None) is None:
            return 0, []
        all_words = words_of(text)
        plain = [w for w, _, _ in all_words]
        found = self.blocks(plain)
        hits = set()
        for a, z, templates in found:
            block = text[all_words[a][1] : all_words[z - 1][2]]
            hits |= {(a + x, a + y, d, place, k) for x, y, d, place, k in self.confirm(block, plain[a:z], templates)}
        # the longest first: apart() takes what is least
        best = {}
        for a, b, d, place, k in sorted(hits, key=lambda h: h[2:]):
            best.setdefault((a, b), (d, place, k))
        kept: list[tuple[int, int, int]] = []
        begins: list[int] = []
        for a, b in sorted(best, key=lambda r: (all_words[r[0]][1] - all_words[r[1] - 1][2], best[r], r)):
            i = bisect_left(begins, a)
            if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
                kept.insert(i, (a, b))
                begins.insert(i, a)
        return len(found), [(all_words[a][1], all_words[b - 1][2], self.names[best[a, b][2]], best[a, b][0]) for a, b in kept]


_scanners: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None) -> DataFrame:
    """Columns of `keep`, n_blocks, n_licenses, licenses (names in order, without repeats) and spans (name:start:end). Columns of `keep` may have these names too."""
    templates = dict(TEMPLATES if templates is None else templates)
    source = docs.select(F.col("text").alias("__text"), *(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)))
    mine = {"n_blocks": T.LongType(), "n_licenses": T.LongType(), "licenses": T.StringType(), "spans": T.StringType()}
    schema = T.StructType([*(T.StructField(f"k{n}", f.dataType) for n, f in enumerate(docs.select(*keep).schema.fields)), *(T.StructField(k, t) for k, t in mine.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(templates.items())
        s = _scanners.setdefault(key, None) or Scanner(templates)
        _scanners[key] = s
        for b in batches:
            got = [s.scan(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[1:],
                    pa.array([n for n, _ in got], pa.int64()),
                    pa.array([len(h) for _, h in got], pa.int64()),
                    pa.array([",".join(sorted({x[2].split()[0] for x in h})) for _, h in got], pa.string()),
                    pa.array([",".join(f"{x[2].split()[0]}:{x[0]}:{x[1]}" for x in h) for _, h in got], pa.string()),
                ],
                schema.names,
            )

    return source.mapInArrow(run, schema).toDF(*keep, *mine)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"), ["doc_id"])
