"""License scans by patience alignment.

A text is compared with the notice of every license as sequences of words. Words that occur once on both sides
are anchors; their longest increasing subsequence is kept, and the gaps between neighbours are aligned again in
the same way, in which further words are unique. Coverage is the share of the notice's words that are aligned.
A find needs the wanted coverage, a notice of fewer than SHORT words all its words: there one word decides. It also
needs the words that name the license, one after the other. Of finds that overlap, the one that covers more words of
its notice stays, of equals the one that starts first, then the smaller name. Further templates, whole license
texts among them, come as a parameter or from a folder (``read_templates``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SHORT = 10

#: The wording of common license notices, and of short licenses as a whole, as their publishers ask authors to write it; without version numbers and names.
NOTICES = {
    "Apache": "Licensed under the Apache License, Version",
    "Apache-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL": "This work is licensed under the GNU General Public License, version",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MPL": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "CC-BY-NC": "Licensed under CC BY-NC",
    "CC-BY": "This work is licensed under a Creative Commons Attribution International License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "BSD-line": "Released under the BSD License",
    "CC-BY-line": "Licensed under CC BY",
    "CC-BY-SA": "Licensed under CC BY-SA",
    "CC-BY-ND": "Licensed under CC BY-ND",
    "CC-BY-NC-SA": "Licensed under CC BY-NC-SA",
    "CC-BY-NC-ND": "Licensed under CC BY-NC-ND",
    "MPL-line": "Licensed under the Mozilla Public License, Version",
    "LGPL": "This work is licensed under the GNU Lesser General Public License, version",
    "AGPL": "This work is licensed under the GNU Affero General Public License, version",
    "EPL": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}

#: The words that tell a notice's license from others: a find must have them, one after the other. Notices without an entry name no license.
NAMES = {
    "Apache": "Apache License",
    "Apache-header": "Apache License",
    "MIT": "MIT License",
    "BSD-3-Clause-text": "endorse or promote products",
    "GPL": "GNU General Public License",
    "GPL-header": "GNU General Public License",
    "MPL": "Mozilla Public License",
    "CC-BY-NC": "CC BY-NC",
    "CC-BY": "Creative Commons Attribution International",
    "BSD-line": "BSD License",
    "CC-BY-line": "CC BY",
    "CC-BY-SA": "CC BY-SA",
    "CC-BY-ND": "CC BY-ND",
    "CC-BY-NC-SA": "CC BY-NC-SA",
    "CC-BY-NC-ND": "CC BY-NC-ND",
    "MPL-line": "Mozilla Public License",
    "LGPL": "GNU Lesser General Public License",
    "AGPL": "GNU Affero General Public License",
    "EPL": "Eclipse Public License",
}

#: Templates that are read from a folder.
MOST = 1000


def read_templates(spark, folder: str) -> dict[str, str]:
    """Whole license texts from the text files of a folder, named by the files: they are sent to every task, so more than MOST files are an error."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.txt)?$", 1).alias("name"), "value").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} templates in {folder}")
    return {r.name: r.value for r in rows}


_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence with increasing second members, by piles of patience."""
    tops: list[int] = []
    pile: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back[i] = pile[at - 1] if at else -1
        tops[at : at + 1] = [b]
        pile[at : at + 1] = [i]
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of ``a`` and ``b``, increasing in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        here, there = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if there[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if here[w] == 1 and w in place])
        if not anchors:
            continue
        found += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(ends, ends[1:], strict=False)]
    return sorted(found)


class Scanner:
    """Finds notices in texts. A find is a stretch of at most twice the notice's words that covers ``least`` of them."""

    def __init__(self, notices: dict[str, str], least: float):
        self.least = least
        self.notices = {k: words_of(v) for k, v in notices.items() if words_of(v)}
        self.counts = {k: Counter(v) for k, v in self.notices.items()}
        self.names = {k: words_of(NAMES[k]) for k in self.notices if k in NAMES and notices[k] == NOTICES.get(k)}
        self.least_of = {k: 1.0 if len(v) < SHORT else least for k, v in self.notices.items()}
        self.known = set().union(*self.notices.values()) if self.notices else set()

    def __call__(self, text: str | None) -> list[dict]:
        if not text:
            return []
        words = words_of(text)
        have = Counter(filter(self.known.__contains__, words))
        # a notice can be covered only if enough of its words, each as often as it has them, occur at all
        possible = [k for k, c in self.counts.items() if sum(min(n, have[w]) for w, n in c.items()) >= self.least_of[k] * len(self.notices[k])]
        if not possible:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        plain = [text[x:y].lower() for x, y in spans]  # lower() of a whole text may differ in its words from that of each word
        # of finds that overlap, the one that covers more words of its notice stays
        kept: list[dict] = []
        for f in sorted((f for k in possible for f in self.finds(k, plain, spans)), key=lambda f: (-f["coverage"] * len(self.notices[f["license"]]), f["start"], f["license"])):
            if all(f["end"] <= g["start"] or f["start"] >= g["end"] for g in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f["start"])

    def finds(self, name: str, words: list[str], spans: list[tuple[int, int]]) -> Iterator[dict]:
        notice, own = self.notices[name], self.counts[name]
        need, width = self.least_of[name] * len(notice), 2 * len(notice)
        hit = np.fromiter((w in own for w in words), np.int64, len(words))
        total = np.r_[0, np.cumsum(hit)]
        ends = np.minimum(np.arange(len(words)) + width, len(words))
        at = 0
        for i in np.flatnonzero((hit > 0) & (total[ends] - total[:-1] >= need)).tolist():
            if i < at:
                continue
            pairs = align(words[i : i + width], notice)
            if len(pairs) >= need and pairs[0][0] == 0 and self.named(name, pairs):
                first, last = i, i + pairs[-1][0]
                at = last + 1
                yield {"license": name, "coverage": len(pairs) / len(notice), "start": spans[first][0], "end": spans[last][1]}

    def named(self, name: str, pairs: list[tuple[int, int]]) -> bool:
        """Whether the license's name is aligned word by word, with nothing in between; a number may part "Attribution" from "International" in CC-BY."""
        own, notice = self.names.get(name), self.notices[name]
        if not own:
            return True
        place = {b: a for a, b in pairs}
        starts = [i for i in range(len(notice) - len(own) + 1) if notice[i : i + len(own)] == own]
        gap = 2 if name == "CC-BY" else 0
        return any(all(i + j in place for j in range(len(own))) and place[i + len(own) - 1] - place[i] <= len(own) - 1 + gap for i in starts)


FOUND = "array<struct<license:string,coverage:double,start:int,end:int>>"


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, found): one row for each row of ``docs`` (doc_id, text), with what is found in the whole text, in order.

    start and end are places of characters. A null or empty text has no finds (an empty array); repeated notices
    are found each; a null doc_id and repeated rows are kept; an empty table gives no rows; further columns are
    ignored. One pass over the texts, no shuffle.
    """
    chosen = NOTICES if notices is None else notices

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(chosen, least)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([scan(t) for t in batch.column("text").to_pylist()], kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(mapped, f"doc_id long, found {FOUND}")
