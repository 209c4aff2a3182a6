"""License scans by conditional compression.

A block of text that states a license compresses much better once the compressor has seen the
license's wording. Candidate blocks are compressed alone and with each template as a raw
Zstandard dictionary; templates are ranked by how much smaller the block gets, and all that save
enough are confirmed by their exact wording: words of the template that the block lacks or has otherwise.
Blocks long for a template are looked through in overlapping windows around cues, sized by the
template.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.llm.shared import table

# Wording of common notices. Public texts, stated as they are; a name and year are
# left out. Long texts stand in the parts in which they are quoted.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "MIT-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-text": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1-text": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "BSD-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "ISC-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to '
        "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "MPL-2.0-text": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0-text": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
}

# How licenses are named in one sentence, and the sentences that name them. Apart from
# an SPDX tag they end with the name, so that what stands before them needn't be known.
TITLES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"],
    "Unlicense": ["Unlicense"],
}
TAG = "SPDX-License-Identifier: {}"
#: Variants of a license in tags.
TAGGED = {"GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "LGPL-2.1": ["LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"]}
SENTENCES = ("licensed under the {}", "licensed under {}", "licensed under the terms of the {}", "distributed under the {}", "distributed under {}", "released under the {}", "available under the {}")


def notices() -> dict[str, list[str]]:
    """Tags and short sentences of each license, as ``<license>-notice``. Together they are one dictionary; each is a statement, word for word."""
    return {f"{name}-notice": [*(TAG.format(v) for v in (name, *TAGGED.get(name, ()))), *(s.format(t) for t in titles for s in SENTENCES)] for name, titles in TITLES.items()}


# Words that tell licenses apart. A statement that has one more or one less than the
# template is no statement of it; nor is one that lacks a number of the template.
NAMES = ("affero", "apache", "boost", "bsd", "commons", "eclipse", "general", "gnu", "isc", "lesser", "library", "mit", "mozilla", "noncommercial", "noderivatives", "sharealike", "not")

NOTICES = notices()

#: A line with one of these may be part of a license statement.
CUE = r"(?i)licen[cs]e|\bgpl\b|copyright|permission|redistribut|warrant|public domain"
#: A template's wording is looked at when it saves this share of a block's compressed size or of its own, ...
LEAST_SAVED = 0.2
#: ... and confirmed when at most this share of the template's words differ, and none that tells licenses apart.
MOST_DIFFERENT = 0.1
#: A template's windows in longer blocks reach so many of its lengths around a cue; the next has a cue so many lengths on.
REACH, STEP = 2, 0.5

_CUE = re.compile(CUE)
_WORD = re.compile(r"\w+(?:[.\-+]\w+)*")
_NUMBER, _PART = re.compile(r"\d"), re.compile(r"[.\-+]")
#: Start, end, number of differing words, missing words, added words.
Wording = tuple[int, int, int, list[str], list[str]]
MATCH = T.StructType().add("start", "long").add("end", "long").add("license", "string").add("alone", "long").add("with_template", "long").add("saved", "double").add("rank", "integer").add("different", "long").add("missing", T.ArrayType(T.StringType())).add("added", T.ArrayType(T.StringType())).add("confirmed", "boolean")


def candidate_blocks(text: str, longest: int) -> Iterator[tuple[int, int]]:
    """Spans that may state a license: windows around cues, reaching ``longest`` characters either way, joined where they overlap.

    A window stops at an empty line. Lines short of a cue inside it belong to the statement.
    """
    start = end = -1
    for m in _CUE.finditer(text):
        above = text.rfind("\n\n", max(0, m.start() - longest), m.start())
        a = above + 2 if above >= 0 else max(0, m.start() - longest)
        b = text.find("\n\n", m.end(), m.end() + longest)
        b = min(len(text), m.end() + longest) if b < 0 else b
        if a <= end:
            end = max(end, b)
            continue
        if end >= 0:
            yield start, end
        start, end = a, b
    if end >= 0:
        yield start, end


class Scanner:
    """Compressors and words of the templates."""

    def __init__(self, templates: Mapping[str, str], notices: Mapping[str, list[str]] | None = None) -> None:
        self.notices = {k: [_joined(_words(x)) for x in said] for k, said in (notices or {}).items()}
        self.templates = dict(templates)
        texts = self.templates | {k: " ".join(said) for k, said in (notices or {}).items()}
        self.alone = zstandard.ZstdCompressor(level=3)
        dictionary = lambda t: zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = {k: zstandard.ZstdCompressor(level=3, dict_data=dictionary(t)) for k, t in texts.items()}
        self.words = {k: _words(t) for k, t in self.templates.items()}
        # those of which no word may differ, as they stand in joined words
        self.exact = {k: _joined(w) for k, w in self.words.items() if MOST_DIFFERENT * len(w) < 1}
        self.own = {k: len(self.alone.compress(t.encode())) for k, t in self.templates.items()}
        self.longest = max((len(t) for t in self.templates.values()), default=0)

    def passages(self, text: str) -> Iterator[tuple[int, int, list[str]]]:
        """Blocks of a text and the templates they are held against.

        These are each line with a cue, each run of lines around cues as long as the longest
        template and, for templates short against such a run, windows around its cues; for
        notices, windows in runs that are too long to be looked at as a whole.
        """
        seen, every = set(), [*self.templates, *self.notices]
        for a, b in candidate_blocks(text, self.longest):
            cues = list(_CUE.finditer(text, a, b))
            for m in cues:
                line = (max(a, text.rfind("\n", 0, m.start()) + 1), b if (e := text.find("\n", m.end(), b)) < 0 else e)
                # a line without end, as in a text of one line, is cut around the cue
                line = max(line[0], m.start() - self.longest), min(line[1], m.end() + self.longest)
                if line not in seen:
                    seen.add(line)
                    yield *line, every
            if (a, b) not in seen and b - a <= 4 * self.longest:
                seen.add((a, b))
                yield a, b, every
            if b - a > 4 * self.longest and self.notices:
                last = -math.inf
                for m in cues:
                    if m.start() >= last + self.longest / 2:
                        last = m.start()
                        yield max(a, m.start() - self.longest), min(b, m.end() + self.longest), list(self.notices)
            for name, template in self.templates.items():
                if b - a > 2 * REACH * len(template):
                    last = -math.inf
                    for m in cues:
                        if m.start() >= last + STEP * len(template):
                            last = m.start()
                            yield max(a, m.start() - REACH * len(template)), min(b, m.end() + REACH * len(template)), [name]

    def scan(self, text: str) -> list[dict]:
        found = []
        for a, b, names in self.passages(text):
            block = text[a:b].encode("utf-8", "surrogatepass")
            plain = len(self.alone.compress(block))
            size = {k: len(self.given[k].compress(block)) for k in names}
            # short templates, of which no word may differ, save a few bytes only: any saving will do
            least = {k: LEAST_SAVED * min(plain, self.own[k]) if k in self.words and k not in self.exact else 1 for k in names}
            near = [k for k in names if plain - size[k] >= least[k]]
            if not near:
                continue
            have = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text, a, b)]
            matcher = SequenceMatcher(None, [], [h[0] for h in have], autojunk=False)
            joined = _joined([h[0] for h in have])
            for name in near:
                if name in self.notices:
                    sure = [(have[i][1], have[j - 1][2], 0, [], []) for i, j in _places(self.notices[name], joined)]
                else:
                    sure = self.statements(name, have, matcher) if name not in self.exact or self.exact[name] in joined else []
                spans = [(*x, True) for x in sure]
                if not sure and name in self.words and plain - size[name] >= LEAST_SAVED * plain and have:
                    spans = [(*self.wording(name, have), False)]
                if not spans:
                    continue
                if len(size) < len(self.given):
                    size = {k: len(c.compress(block)) for k, c in self.given.items()}
                rank = 1 + sum((n, k) < (size[name], name) for k, n in size.items())
                for start, end, different, missing, added, confirmed in spans:
                    found.append({"start": start, "end": end, "license": name, "alone": plain, "with_template": size[name], "saved": 1 - size[name] / plain, "rank": rank, "different": different, "missing": missing, "added": added, "confirmed": confirmed})
        return _distinct(found)

    def statements(self, name: str, have: list[tuple[str, int, int]], matcher: SequenceMatcher) -> list[Wording]:
        """Each statement of the template that its wording confirms, among the words of a block."""
        want = self.words[name]
        most = int(MOST_DIFFERENT * len(want))
        # words in a row that a statement with the most differences still has
        least = max(1, (len(want) - most) // (most + 1))
        matcher.set_seq1(want)
        out, parts = [], [(0, len(have))]
        while parts:
            low, high = parts.pop()
            i, j, size = matcher.find_longest_match(0, len(want), low, high)
            if size < least:
                continue
            first, last, different, missing, added = self.compared(want, have, max(low, j - i - most), min(high, j - i + len(want) + most))
            if different <= most and not any(part in NAMES for w in [*missing, *added] for part in _PART.split(w)) and not any(_NUMBER.search(w) for w in missing):
                out.append((have[first][1], have[last - 1][2], different, missing, added))
            else:
                first, last = j, j + size
            parts += [(low, first), (last, high)]
        return out

    def wording(self, name: str, have: list[tuple[str, int, int]]) -> Wording:
        """Where the template's words stand in a block, and how they differ there."""
        first, last, *how = self.compared(self.words[name], have, 0, len(have))
        return (have[first][1], have[last - 1][2], *how)

    def compared(self, want: list[str], have: list[tuple[str, int, int]], a: int, b: int) -> tuple[int, int, int, list[str], list[str]]:
        """First and last place of the template's words in a to b, how many words differ there, which are missing, and which are added."""
        blocks = [x for x in SequenceMatcher(None, want, [h[0] for h in have[a:b]], autojunk=False).get_matching_blocks() if x.size]
        if not blocks:
            return a, b, len(want), want, []
        first, last = a + blocks[0].b, a + blocks[-1].b + blocks[-1].size
        mine, theirs = ({k for x in blocks for k in range(at(x), at(x) + x.size)} for at in (lambda x: x.a, lambda x: a + x.b))
        missing, added = [w for k, w in enumerate(want) if k not in mine], [have[k][0] for k in range(first, last) if k not in theirs]
        return first, last, max(len(want), last - first) - len(mine), missing, added


def _joined(words: list[str]) -> str:
    return f"\0{chr(0).join(words)}\0"


def _places(said: list[str], joined: str) -> Iterator[tuple[int, int]]:
    """Numbers of the first word of each place where one of the sentences stands, and of the word behind it."""
    for sentence in said:
        at = joined.find(sentence)
        while at >= 0:
            i = joined.count("\0", 0, at)
            yield i, i + sentence.count("\0") - 1
            at = joined.find(sentence, at + 1)


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _distinct(found: list[dict]) -> list[dict]:
    """One row for each span and license, the best ranked; a confirmed span hides unconfirmed ones that overlap it."""
    best: dict[tuple, dict] = {}
    for f in sorted(found, key=lambda f: (not f["confirmed"], f["different"], f["rank"])):
        best.setdefault((f["start"], f["end"], f["license"]), f)
    sure = [f for f in best.values() if f["confirmed"]]
    # a notice inside a longer statement of its license is part of that
    own = {id(f) for f in sure if f["license"].endswith("-notice") and any(o["license"].startswith(f["license"][:-7]) and not o["license"].endswith("-notice") and o["start"] <= f["start"] and f["end"] <= o["end"] for o in sure)}
    sure = [f for f in sure if id(f) not in own]
    out = sure + [f for f in best.values() if not f["confirmed"] and not any(f["start"] < s["end"] and s["start"] < f["end"] for s in sure)]
    return sorted(out, key=lambda f: (f["start"], f["end"], f["rank"], f["license"]))


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", notices: Mapping[str, list[str]] = NOTICES) -> DataFrame:
    """License statements in whole texts, one row each.

    Returns:
        ``id_col, start, end`` (code points, end exclusive), ``license``, ``alone`` and
        ``with_template`` (compressed bytes), ``saved`` (share), ``rank`` among templates,
        ``different`` (how many words), ``missing`` and ``added`` (these words; a replaced one
        is one of each), ``confirmed``. Texts without a cue, null and empty ones have no
        rows. Ids may repeat or be null. No shuffle; texts without a cue never reach Python.
    """
    sent = dict(templates), dict(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*sent)
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1)):
                found = scanner.scan(text.as_py())
                rows += found
                ids += [i] * len(found)
            kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
            columns = [pa.array([r[f.name] for r in rows], kinds[f.dataType.simpleString()]) for f in MATCH]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *columns], names=[id_col, *MATCH.fieldNames()])

    rows = docs.filter(F.col(text_col).rlike(CUE)).select(id_col, F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *MATCH]))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
