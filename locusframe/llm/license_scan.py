"""License scans by conditional compression.

Words that speak of licenses make regions, with what is around them. Where a region shares neighbouring words with a
license template, at about one offset, the words there are a candidate block. It is compressed alone and
with every such template as a raw dictionary; the template that saves most is the likeliest one. Each is
confirmed by the exact differences in wording: every word of the template has to be in the block, in order,
but for the few that the template leaves open, and numbers have to agree.

A region may be as long as a text: its words are gone over once, and a block is no longer than its
template with what may be added to it.
"""

import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_batches

# License notices and the openings of license texts, as their owners word them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer.",
    ),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work under CC0 1.0."),
    ("proprietary", "All rights reserved."),
]

CUE = re.compile(
    r"licen[cs]|copyright|all\W+rights\W+reserved|permission\W+(?:is\W+hereby|to\W+use)|redistribut|warrant|"
    r"public\W+domain|creative\W+commons|\bCC[ -](?:BY|0)|\bCC0\b",
    re.I,
)
# One of these is in every cue; looking for them first passes most texts quickly.
CUE_PARTS = ("licen", "copyright", "reserved", "permission", "redistribut", "warrant", "domain", "commons",
             "cc0", "cc by", "cc-by", "cc 0", "cc-0")
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
# Part of a template's words that may be missing.
MAX_MISSING = 0.05


def words_of(text: str) -> list[str]:
    return [m.lower() for m in _WORD.findall(text)]


def _allowed(template: list[str]) -> tuple[int, int]:
    """How many words of a template may be missing, and how many may be added between its words."""
    size = len(template)
    return int(MAX_MISSING * size), min(max(2, size // 4), max(size - 2, 0))


class Templates:
    """The compressors and the pairs of words of all templates, built once per task."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        import zstandard

        self.templates = [(name, text, words_of(text)) for name, text in templates]
        self.alone = zstandard.ZstdCompressor(level=9, write_content_size=False)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.given = [
            zstandard.ZstdCompressor(
                level=9,
                dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=raw),
                write_content_size=False,
                write_dict_id=False,
            )
            for _, text, _ in self.templates
        ]
        # Where each pair of neighbouring words stands in the templates.
        self.pairs: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        for i, (_, _, words) in enumerate(self.templates):
            for at, pair in enumerate(zip(words, words[1:])):
                self.pairs[pair].append((i, at))

    def candidates(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """`(template, first word, end word)` of the blocks that share enough pairs with a template."""
        met: dict[int, list[int]] = defaultdict(list)
        for at, pair in enumerate(zip(words, words[1:])):
            for i, place in self.pairs.get(pair, ()):
                met[i].append(at - place)
        for i, starts in met.items():
            template = self.templates[i][2]
            missing, added = _allowed(template)
            # Every word that is missing or added parts some neighbours; the others are here.
            least = max(1, len(template) - 1 - added - 2 * missing)
            starts.sort()
            low, beyond = 0, -len(words)
            for high, start in enumerate(starts):
                while start - starts[low] > missing + added:
                    low += 1
                if high - low + 1 >= least and starts[high] > beyond:
                    # The block may begin anywhere around here.
                    first, last = max(0, starts[low] - added), min(len(words) - 1, start + missing + added)
                    beyond = start + missing
                    yield i, first, min(len(words), last + len(template) + added)

    def reduction(self, block: bytes, i: int) -> float:
        """The part of the block's compressed size that a template saves."""
        return 1 - len(self.given[i].compress(block)) / len(self.alone.compress(block))

    def differences(self, words: list[str], template: list[str]) -> tuple[int, int, int] | None:
        """Words `(missing, added, end)` against a template that begins here, or None if a number or too much differs."""
        matcher = SequenceMatcher(None, template, words, autojunk=False)
        blocks = [b for b in matcher.get_matching_blocks() if b.size]
        if not blocks:
            return None
        kept = {i for b in blocks for i in range(b.a, b.a + b.size)}
        gone = [w for i, w in enumerate(template) if i not in kept]
        missing, most = _allowed(template)
        if len(gone) > missing or any(c.isdigit() for w in gone for c in w):
            return None
        end = blocks[-1].b + blocks[-1].size
        added = end - blocks[0].b - len(kept)
        return (len(gone), added, end) if added <= most else None

    def best(self, words: list[str], template: list[str]) -> tuple[int, int, int, int] | None:
        """The fewest differences `(missing, added, first, end)` of a template that begins at one of the words."""
        missing, added = _allowed(template)
        heads, out = set(template[: missing + 1]), None
        for first, word in enumerate(words):
            if word in heads:
                found = self.differences(words[first : first + len(template) + added], template)
                if found and (out is None or found[:2] < out[:2]):
                    out = (*found[:2], first, first + found[2])
        return out

    def found(self, region: str) -> list[tuple[str, float, int, int, int, int]]:
        """Confirmed `(license, reduction, missing, added, start, end)` of a region of a text."""
        spans = [(m.start(), m.end()) for m in _WORD.finditer(region)]
        words = [region[a:b].lower() for a, b in spans]
        ranked = []
        for i, low, high in self.candidates(words):
            block = region[spans[low][0] : spans[high - 1][1]].encode()
            ranked.append((self.reduction(block, i), i, low, high))
        out = []
        # The likeliest first; ties go to the longer template, which says more.
        for reduction, i, low, high in sorted(ranked, key=lambda r: (-round(r[0], 3), -len(self.templates[r[1]][2]), r[1:])):
            name, _, template = self.templates[i]
            found = self.best(words[low:high], template)
            if found:
                missing, added, first, end = found
                start, stop = spans[low + first][0], spans[low + end - 1][1]
                out.append((name, round(reduction, 4), missing, added, start, stop))
        return out


def _longest_gap(templates: list[tuple[str, str]]) -> int:
    """The most characters of a template without a cue, and half as many for what may be added."""
    gaps = [0]
    for _, text in templates:
        places = [0, *(at for m in CUE.finditer(text) for at in m.span()), len(text)]
        gaps += [b - a for a, b in zip(places[::2], places[1::2])]
    return max(gaps) * 3 // 2


# Characters around a cue that its region has too; parts of a notice have no cue.
AROUND = _longest_gap(TEMPLATES)


def regions(text: str) -> list[tuple[int, int]]:
    """Cues and what is around them, in parts that do not overlap."""
    folded = text.lower()
    if not any(part in folded for part in CUE_PARTS):
        return []
    out: list[tuple[int, int]] = []
    for m in CUE.finditer(text):
        start, end = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        # Words of usual length are not cut.
        while 0 < start and not text[start - 1].isspace() and start > m.start() - AROUND - 50:
            start -= 1
        while end < len(text) and not text[end].isspace() and end < m.end() + AROUND + 50:
            end += 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


SCHEMA = "id {kind}, license string, start bigint, end bigint, reduction double, missing int, added int, block string"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document and confirmed license.

    `start` and `end` bound the words of the template in code points, `missing` and `added` count the words
    that differ from it. Of several blocks with one license the one with the fewest differences is
    given, then the first. NULL and empty texts have none; rows are scanned one by one, repeated ones
    too, and other columns are not read.
    """
    kind = dict(docs.dtypes)[id_column]
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def run(batches):
        templates = Templates()
        types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            out = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, best = value.as_py() or "", {}
                for begin, stop in regions(text):
                    for name, reduction, missing, added, start, end in templates.found(text[begin:stop]):
                        row = (missing + added, begin + start, begin + end, -reduction, missing, added)
                        if name not in best or row < best[name]:
                            best[name] = row
                for name in sorted(best):
                    _, start, end, reduction, missing, added = best[name]
                    out.append((key, name, start, end, -reduction, missing, added, text[start:end]))
            columns = list(zip(*out)) if out else [[] for _ in names]
            arrays = [pa.array(columns[0], batch.schema.field(0).type)]
            arrays += [pa.array(c, t) for c, t in zip(columns[1:], types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = bounded_batches(docs).select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")
    )
    return rows.mapInArrow(run, SCHEMA.format(kind=kind))
