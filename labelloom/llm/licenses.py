"""Operator 10, license scans by conditional compression.

Texts that speak of licences are found by Spark's own functions. In tasks the words around hints, over line ends, are cut
into candidate blocks. A block is compressed with zstandard alone and with every template as raw dictionary; templates
are ranked by the size reduction, as a share of what they save on their own wording, so that neither other text in the
block nor a template's length counts. The winners, those that save ``WIN`` of it, are confirmed in this order by exact
wording: template and block are aligned word by word, the differences returned, and few enough of them confirm. What
stands before and behind a confirmed place is a block again. No template is confirmed that compression did not
put among the winners.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, slices, table

HINT = r"(?i)licen[sc]|copyright|warrant|redistribut|permission\W+is|public\W+domain|\bCC\W+BY|\bCC0\b|SPDX"
#: Share of a template's words that must stand in a place, in order; share of its own saving that makes a winner, or names an unconfirmed one.
CONFIRM, WIN = 0.85, 0.25
#: Other words, as many before as behind, in which a template's own saving is measured: alone, a short one's would be that of a text too short to compress.
COMPANY = 10
#: Words that a short block has around its hints, where a notice's few words count; long ones have as many as a template has without
#: a hint. Words of a block at most, cut with an overlap of the longest template.
NEAR, BLOCK = 10, 1_200
#: Two places of about one length, up to this ratio, cannot overlap: the one with fewer differences stands.
ALIKE = 0.67
#: Reductions that a task remembers.
CACHE = 10_000

#: Fixed value: the disclaimer that both BSD licences end with.
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Notices by which licences are named in texts, the headers of files, and whole texts of short licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work: CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    + _AS_IS,
    "BSD-3-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_HINT = re.compile(HINT, re.ASCII)


def words(text: str) -> list[str]:
    return [x.lower() for x in _WORD.findall(text)]


def hints(text: str, starts: list[int]) -> list[tuple[int, str]]:
    """(place of the word, kind) of each hint, for a text whose words begin at ``starts``."""
    return [(bisect_right(starts, m.start()) - 1, m.group()[:2].lower()) for m in _HINT.finditer(text)]


class Matcher:
    """The templates, prepared once a task."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.names = list(templates)
        self.words = [words(t) for t in templates.values()]
        self.bags = [Counter(w) for w in self.words]
        self.slack = [2 + len(w) // 5 for w in self.words]
        told = [sorted({at for at, _ in hints(t, [m.start() for m in _WORD.finditer(t)])}) for t in templates.values()]
        #: The most words that a template has before its first hint, between two, or from its last one on.
        self.reach = max(b - a for w, at in zip(self.words, told, strict=True) for a, b in zip([-1, *at], [*at, len(w)], strict=True)) + max(self.slack)
        self.with_dict = [zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]
        other = [hashlib.md5(bytes([k])).hexdigest()[: 3 + k % 7] for k in range(2 * COMPANY)]
        among = lambda w: " ".join([*other[:COMPANY], *w, *other[COMPANY:]]).encode()
        self.own = [max(1, self._saved(k, among(w))) for k, w in enumerate(self.words)]
        self.known: dict[str, list[float]] = {}

    def _saved(self, k: int, raw: bytes) -> int:
        return len(self.plain.compress(raw)) - len(self.with_dict[k].compress(raw))

    def reductions(self, have: list[str]) -> list[float]:
        """For each template, the size reduction of a block's words under it, as a share of that of its own words among others."""
        block = " ".join(have)
        if block not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            raw = block.encode("utf-8", "surrogatepass")
            alone = len(self.plain.compress(raw))
            self.known[block] = [(alone - len(z.compress(raw))) / own for z, own in zip(self.with_dict, self.own, strict=True)]
        return self.known[block]

    def ranked(self, have: list[str]) -> list[tuple[float, int]]:
        """(reduction, template), the largest first, ties to the earlier template."""
        return sorted(((r, k) for k, r in enumerate(self.reductions(have))), key=lambda x: (-x[0], x[1]))

    def enough(self, k: int, have: list[str]) -> bool:
        """Whether words hold, in any order, as many of the template's as confirm it: what fails here cannot be aligned."""
        there = Counter(have)
        return sum(min(n, there[w]) for w, n in self.bags[k].items()) >= CONFIRM * len(self.words[k])

    def aligned(self, k: int, have: list[str], a: int, b: int) -> tuple[float, list[list[str]], int, int]:
        """Share of the template's words found in order in words a to b, the wording that differs ([kind, template, text]), and from where to where."""
        want, slack = self.words[k], self.slack[k]
        long_ = difflib.SequenceMatcher(None, want, have[a:b], autojunk=False).find_longest_match()
        if not long_.size:
            return 0.0, [["delete", " ".join(want), ""]], a, a
        first = max(a, a + long_.b - long_.a - slack)
        near = have[first : min(b, a + long_.b + len(want) - long_.a + slack)]
        ops = difflib.SequenceMatcher(None, want, near, autojunk=False).get_opcodes()
        same = [x for x in ops if x[0] == "equal"]
        start, end, told = same[0][3], same[-1][4], []
        for kind, i, j, c, d in ops:
            # Before the first and behind the last words found stands other text: no more of it differs than the template has there.
            if d <= start and kind != "equal":
                c = max(c, d - (j - i))
            elif c >= end and kind != "equal":
                d = min(d, c + (j - i))
            if kind != "equal" and (i < j or start < c < end):
                told.append([kind, " ".join(want[i:j]), " ".join(near[c:d])])
        return sum(x[2] - x[1] for x in same) / len(want), told, first + start, first + end

    def places(self, k: int, have: list[str], a: int, b: int, hints_at: list[int], rank: int, saving: float) -> list[tuple]:
        """(differences, -share, start, end, template, rank, saving, wording) of each place of the words a to b where a winner's wording stands."""
        if bisect_left(hints_at, a) == bisect_left(hints_at, b) or not self.enough(k, have[a:b]):
            return []
        share, ops, start, end = self.aligned(k, have, a, b)
        if share < CONFIRM:
            return []
        out = [(len(ops), -share, start, end, k, rank, saving, ops)]
        for c, d in ((a, start), (end, b)):
            if d - c >= CONFIRM * len(self.words[k]):
                left = self.reductions(have[c:d])
                if left[k] >= WIN:
                    out += self.places(k, have, c, d, hints_at, 1 + sum(r > left[k] for r in left), left[k])
        return out

    def blocks(self, hints_at: list[int], n: int, reach: int) -> list[tuple[int, int]]:
        """Word ranges of candidate blocks: hints near each other with the words around them; long ones cut with an overlap."""
        out: list[list[int]] = []
        for at in hints_at:
            if out and at - reach <= out[-1][1]:
                out[-1][1] = min(n, at + reach)
            else:
                out.append([max(0, at - reach), min(n, at + reach)])
        longest = max(map(len, self.words)) * 5 // 4 + 2
        return [(c, min(b, c + BLOCK)) for a, b in out for c in range(a, max(a + 1, b - longest), BLOCK - longest)]

    def scan(self, text: str) -> list[tuple[int, str | None, float, int, float, list, bool]]:
        """(line, license, saving, rank, share, differences, confirmed) by line and template."""
        spans = [m.span() for m in _WORD.finditer(text)]
        have, starts = [text[a:b].lower() for a, b in spans], [a for a, _ in spans]
        ends = [m.start() for m in re.finditer("\n", text)]
        hints_at = sorted({at for at, _ in hints(text, starts) if at >= 0})
        line = lambda at: bisect_right(ends, starts[at])
        found: dict[tuple[int, int, int], tuple] = {}
        for a, b in dict.fromkeys(x for reach in (NEAR, self.reach) for x in self.blocks(hints_at, len(have), reach)):
            for rank, (saving, k) in enumerate(self.ranked(have[a:b]), 1):
                if saving < WIN:
                    break
                for x in self.places(k, have, a, b, hints_at, rank, saving):
                    found.setdefault((k, x[2], x[3]), x)
        rows, taken = [], []
        for x in sorted(found.values(), key=lambda x: (x[0], x[1], x[3] - x[2] < 0, x[2] - x[3], x[4])):
            _, share, start, end, k, rank, saving, ops = x
            size = end - start
            if all(end <= c or d <= start or min(size, d - c) < ALIKE * max(size, d - c) for c, d in taken):
                rows.append((line(start), k, self.names[k], saving, rank, -share, ops, True))
                taken.append((start, end))
        left: dict[int, tuple[int, int]] = {}
        for at in hints_at:
            if not any(c <= at < d for c, d in taken) and line(at) not in left:
                left[line(at)] = (max([at - NEAR, 0, *(d for _, d in taken if d <= at)]), min([at + NEAR, len(have), *(c for c, _ in taken if c > at)]))
        for at, (a, b) in left.items():
            saving, k = self.ranked(have[a:b])[0]
            share, ops, _, _ = self.aligned(k, have, a, b)
            rows.append((at, k, self.names[k] if saving >= WIN else None, saving, 1, share, ops, False))
        return [(r[0], *r[2:]) for r in sorted(rows, key=lambda r: r[:2])]


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, line (from 0), license, saving, rank, wording (share of its words found), differences (JSON), confirmed.

    ``saving`` is the size reduction of the block as a share of that of the template's own words, ``rank`` the template's
    place in its block by it. A row for each place where a template's wording stands, by the line it begins on; a short
    notice can stand within a longer one. A row besides, not confirmed, for each line with hints outside of such places:
    the template that saves most there, or null. Null, empty and other texts have no rows, nor has an empty table. Texts
    of any length are scanned whole, in blocks of bounded length. Rows that repeat a doc_id are scanned each. Ties between
    templates go to the earlier. Columns other than doc_id and text are not read.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates)
        for batch in slices(batches):
            ids, got = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = matcher.scan(text)
                ids += [doc_id] * len(found)
                got += found
            line, name, saving, rank, share, ops, ok = zip(*got, strict=True) if got else ((),) * 7
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "line": pa.array(line, pa.int32()), "license": pa.array(name, pa.string()), "saving": pa.array(saving, pa.float64()), "rank": pa.array(rank, pa.int32()), "wording": pa.array(share, pa.float64()), "differences": pa.array([json.dumps(x) for x in ops], pa.string()), "confirmed": pa.array(ok, pa.bool_())})

    spoken = docs.where(F.col("text").rlike(HINT)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(spoken, match, "doc_id long, line int, license string, saving double, rank int, wording double, differences string, confirmed boolean")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
