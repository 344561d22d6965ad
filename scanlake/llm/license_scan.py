"""License scans (operator 5) by conditional compression.

A candidate block is the text around words that license notices use, within their paragraph; marks that begin lines of a comment
are no words. Windows of a block, little longer than a template, are compressed alone and with the template as a zstandard raw
dictionary, in lower case: the template is ranked by how much smaller the window becomes, as a share of what it can explain. Windows that
lack too many of its words, in any order, are not compressed. Those that save LEAST_SAVED are confirmed by the exact wording, best
first: the template's words are laid along the window's words, and a template is found if at most a share of its words is missing or
changed. Blocks are told by content, so a notice that fills a corpus is compressed once a worker.

A license is told by its parts: `licenses` gives a row for each license of a document, whose grant, conditions and disclaimer may
stand in several paragraphs. Tags of the form SPDX-License-Identifier are templates like others; a tag that joins licenses by OR, AND or
WITH is first written out as a tag for each.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import CACHE, batch_of, slices, texts

# Identifiers and wordings of common license notices; whole licenses where they are short, else their headers.
WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0 terms": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD disclaimer": WARRANTY,
    "BSD-2-Clause conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software',
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 long": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER',
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT rights": "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0 copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}
# Other short references, headers with their versions, and license identifiers that tags hold.
OR_LATER = "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES |= {
    "BSD-2-Clause short": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause short": "Licensed under the BSD 3-Clause License.",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL.",
    "GPL-2.0-or-later header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License " + OR_LATER.format(2),
    "GPL-3.0-or-later header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License " + OR_LATER.format(3),
    "GPL-2.0 short": "Licensed under the GNU GPL v2.",
    "GPL-3.0 short": "Licensed under the GNU GPL v3.",
    "LGPL-2.1-or-later header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + OR_LATER.format(2.1),
    "LGPL-3.0-or-later header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + OR_LATER.format(3),
    "MIT short": "Licensed under the MIT License.",
    "MIT reference": "Distributed under the terms of the MIT license.",
    "MPL-2.0 short": "Licensed under the Mozilla Public License 2.0.",
}
IDENTIFIERS = (
    "0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 "
    "EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 PostgreSQL Python-2.0 Unlicense WTFPL Zlib"
)
TEMPLATES |= {f"{i} tag": f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS.split()}
#: The parts that make a license text whole; of other licenses each template stands for the license.
WHOLE = {
    "Apache-2.0": {"Apache-2.0 header", "Apache-2.0 terms"},
    "BSD-2-Clause": {"BSD-3-Clause", "BSD-2-Clause conditions", "BSD disclaimer"},
    "BSD-3-Clause": {"BSD-3-Clause", "BSD-2-Clause conditions", "BSD-3-Clause endorsement", "BSD disclaimer"},
    "ISC": {"ISC", "ISC warranty"},
    "MIT": {"MIT grant", "MIT rights", "MIT conditions", "MIT warranty"},
    "MPL-2.0": {"MPL-2.0", "MPL-2.0 copy"},
    "Unlicense": {"Unlicense", "Unlicense grant"},
}
#: Parts that several licenses share, with those licenses from the most to the least telling, and what they are without any of them.
SHARED = {
    "BSD disclaimer": (("BSD-3-Clause", "BSD-2-Clause"), "BSD"),
    "BSD-2-Clause conditions": (("BSD-3-Clause",), "BSD-2-Clause"),
    "BSD-3-Clause": (("BSD-3-Clause", "BSD-2-Clause"), "BSD-3-Clause"),
    "GPL header": (("GPL-3.0-or-later", "GPL-2.0-or-later", "GPL-3.0", "GPL-2.0"), "GPL"),
    "GPL warranty": (("GPL-3.0-or-later", "GPL-2.0-or-later", "GPL-3.0", "GPL-2.0"), "GPL"),
    "LGPL header": (("LGPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0"), "LGPL"),
}
CUE = re.compile(rb"licen[sc]|copyright|permission|redistribut|distributed|public domain|warrant|free (?:software|to copy)", re.I)
#: Bytes of text on either side of a cue that make a block, at most to the ends of its paragraph; twice the longest template if that is more.
AROUND = 512
#: What ends a paragraph, and what begins a line of a comment.
BLANK = re.compile(rb"\n[ \t\r]*\n")
MARK = re.compile(r"^[ \t]*(?:/\*+|//+|--+|[#*;%!>|]+|(?:rem|dnl)\b)", re.M)
LEAST_SAVED, MOST_CHANGED = 0.3, 0.1
WORD = re.compile(r"[\w.+/:-]*\w")
#: A tag of several licenses, in lower case.
TAG = re.compile(r"spdx-license-identifier:\s*(\(*[\w.+-]+\)*(?:[ \t]+(?:or|and|with)[ \t]+\(*[\w.+-]+\)*)+)")


def tags(found: re.Match) -> str:
    return "".join(f"spdx-license-identifier: {i} " for i in re.findall(r"[\w.+-]+", found[1]) if i not in ("or", "and", "with"))


def by_license(names: set[str]) -> dict[str, set[str]]:
    """The templates that a document has, by license. A shared part goes with a license that other parts tell, else it stands for itself."""
    parts: dict[str, set[str]] = {}
    for name in sorted(names - SHARED.keys()):
        parts.setdefault(name.split(" ")[0], set()).add(name)
    # Conditions first: they tell a license that the parts after them may go with.
    for name in sorted(names & SHARED.keys(), key=lambda n: (n != "BSD-2-Clause conditions", n)):
        licenses, other = SHARED[name]
        parts.setdefault(next((i for i in licenses if i in parts), other), set()).add(name)
    return parts


class Templates:
    def __init__(self, templates: dict[str, str]):
        raw = lambda t: zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        small = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.names, self.words = list(templates), [WORD.findall(t.lower()) for t in templates.values()]
        lines = [" ".join(w).encode() for w in self.words]
        self.plain = zstandard.ZstdCompressor(**small)
        self.given = [zstandard.ZstdCompressor(dict_data=raw(t), **small) for t in lines]
        self.most = [len(self.plain.compress(t)) for t in lines]
        self.bags = [Counter(w) for w in self.words]
        self.around = max(AROUND, 2 * max((len(t.encode()) for t in templates.values()), default=0))
        self.known: dict[bytes, list[tuple]] = {}

    def of(self, block: bytes) -> list[tuple[str, float, int, int]]:
        """(license, share saved, words of the template that are missing, words added among them) of each found."""
        if block not in self.known:
            if len(self.known) >= CACHE // 16:
                self.known.clear()
            self.known[block] = self._found(block)
        return self.known[block]

    def _found(self, block: bytes) -> list[tuple[str, float, int, int]]:
        """The best confirmed templates are taken out of the block, and the rest is ranked again, until nothing is confirmed."""
        own, found = WORD.findall(TAG.sub(tags, MARK.sub(" ", block.decode("utf-8", "replace").lower()))), []
        while confirmed := self._all_confirmed(own):
            taken = np.zeros(len(own), dtype=bool)
            for _, _, i, share, missing, added, first, last in confirmed:
                if not taken[first:last].any():
                    taken[first:last] = True
                    found.append((self.names[i], round(-share, 6), missing, added))
            own = [w if not t else "\n" for w, t, before in zip(own, taken, np.r_[False, taken[:-1]], strict=True) if not (t and before)]
        return sorted(found)

    def _all_confirmed(self, own: list[str]) -> list[tuple]:
        counted = Counter(own)
        return sorted(c for i, bag in enumerate(self.bags) if (counted & bag).total() >= (1 - MOST_CHANGED) * len(self.words[i]) for c in self._confirmed(i, own))

    def _confirmed(self, i: int, own: list[str]):
        """Where a template is found, by windows that a notice of so many words cannot miss and that hold little else, as prose around hides what is saved."""
        template, bag = self.words[i], self.bags[i]
        n, step = len(template), max(1, len(template) // 4)
        changed = MOST_CHANGED * n
        for at in range(0, len(own), step):
            part = own[at : at + n + int(changed) + step]
            if (Counter(part) & bag).total() < n - changed:
                continue
            text = " ".join(part).encode()
            alone = len(self.plain.compress(text))
            share = (alone - len(self.given[i].compress(text))) / min(alone, self.most[i])
            if share >= LEAST_SAVED:
                missing, added, first, last = wording(template, part)
                if missing + added <= changed:
                    yield 2 * missing + added - n, first - last, i, -share, missing, added, at + first, at + last


def wording(template: list[str], block: list[str]) -> tuple[int, int, int, int]:
    """How many template words are missing, how many others stand between, and the part of the block that was used."""
    runs = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return len(template), 0, 0, 0
    # The runs around the longest one that stand close enough to belong to one notice.
    at = max(range(len(runs)), key=lambda i: runs[i].size)
    lo = hi = at
    while lo and runs[lo].b - runs[lo - 1].b - runs[lo - 1].size <= len(template) // 4:
        lo -= 1
    while hi + 1 < len(runs) and runs[hi + 1].b - runs[hi].b - runs[hi].size <= len(template) // 4:
        hi += 1
    same, first, last = sum(r.size for r in runs[lo : hi + 1]), runs[lo].b, runs[hi].b + runs[hi].size
    return len(template) - same, last - first - same, first, last


def blocks(text: bytes, around: int = AROUND) -> list[tuple[int, int]]:
    """Byte ranges of candidate blocks: cues with what stands around them in their paragraph, merged where they overlap."""
    found: list[tuple[int, int]] = []
    for cue in CUE.finditer(text):
        before = [m.end() for m in BLANK.finditer(text, max(0, cue.start() - around), cue.start())]
        a = before[-1] if before else max(0, cue.start() - around)
        after = BLANK.search(text, cue.end(), cue.end() + around)
        b = after.start() if after else min(len(text), cue.end() + around)
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def _scanned(docs: DataFrame, templates: dict[str, str], rows_of, fields: list[tuple[str, str]]) -> DataFrame:
    """rows_of(doc, found) gives the rows of one document; found: (start, end, template, saved, missing, added) of each template found."""
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([("doc_id", pa.int64()), *((name, kinds[kind]) for name, kind in fields)])

    def run(batches):
        known = Templates(templates)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(a, b, *f) for a, b in blocks(text or b"", known.around) for f in known.of(text[a:b])]
                rows += [(doc, *row) for row in rows_of(found)]
            yield batch_of(schema, *[[r[i] for r in rows] for i in range(len(schema))])

    whole = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return whole.mapInArrow(run, ", ".join(["doc_id long", *(f"{name} {kind}" for name, kind in fields)]))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each template found in a block: doc_id, start and end (bytes of the block), license, saved, n_missing, n_added.

    Null and empty texts have none; every cue of a text of any length is tried; repeated rows are each reported; a null doc_id
    is returned as null; other columns are ignored; an empty table gives an empty result. Of templates that fit the same words, the one that
    explains most counts, in words less changes; then the longer, then the first. saved: the bytes that the template saves, as a share of the smaller of
    the notice's window and template.
    """
    fields = [("start", "long"), ("end", "long"), ("license", "string"), ("saved", "double"), ("n_missing", "long"), ("n_added", "long")]
    return _scanned(docs, templates, lambda found: found, fields)


def licenses(docs: DataFrame) -> DataFrame:
    """A row for each license of a document: doc_id, license, whole, parts, start, end, saved, n_missing, n_added.

    parts: the templates found, in order of name; whole: all parts of the license's text are there, or a header or notice of a license that has
    no parts. start and end: bytes from the first block with a part to the last. saved is the largest of the parts', the counts
    are sums. Edge cases are those of `license_scan`.
    """

    def merged(found: list[tuple]) -> list[tuple]:
        rows = []
        for name, parts in sorted(by_license({f[2] for f in found}).items()):
            own = [f for f in found if f[2] in parts]
            whole = WHOLE[name] <= parts if name in WHOLE else any(not p.endswith((" tag", " short")) and p not in SHARED for p in parts)
            rows.append((name, whole, sorted(parts), min(f[0] for f in own), max(f[1] for f in own), max(f[3] for f in own), sum(f[4] for f in own), sum(f[5] for f in own)))
        return rows

    fields = [("license", "string"), ("whole", "boolean"), ("parts", "array<string>"), ("start", "long"), ("end", "long"), ("saved", "double"), ("n_missing", "long"), ("n_added", "long")]
    return _scanned(docs, TEMPLATES, merged, fields)
