"""License notices found by conditional compression.

Candidate blocks are where a document shares a run of three words with a template (four, if the template has twenty words or more;
a notice with a fifth of them changed still has such a run), laid out along the template: the words that the whole notice would take up there. Each block is compressed with zstandard alone and with each
template as raw dictionary; the template that takes the most off the size is the winner. A winner is confirmed by the
exact word differences between block and template: none that touches a deciding word (name, version, NC, SA, ND, Lesser,
Affero), and few enough elsewhere, or nothing but placeholders filled in.

Defined results: null and empty texts have no blocks; texts of any length are scanned whole; of overlapping confirmed blocks
one without a wrong word stays, then the longer, the one with the larger reduction, the earlier, the first by name; repeated rows repeat.
"""

from __future__ import annotations

import difflib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, LONG_GRAM, LONG = 3, 4, 20
BLOCKS_KEPT = 50_000  # judgements of equal blocks that a task remembers
MOST_DIFFERENT = 0.2  # share of a template's words that may differ, besides the deciding ones
LEAST_REDUCTION = 0.2
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
HOLDER = "placeholder"  # a word of a template that stands for up to six words of a notice
HOLDER_WORDS = 6
# Words that tell licences apart, and those after which a number is a version.
DECIDING = frozenset("affero agpl apache artistic attribution boost bsd cc cc0 cddl commons creative eclipse epl gnu gpl isc lesser lgpl library mit mozilla mpl nc nd nocommercial noncommercial noderivatives noderivs public sa sharealike unlicense zero zlib".split())
BEFORE_VERSION = DECIDING | {"v", "ver", "version", "versions", "license", "by"}
NUMBER = re.compile(r"v?(\d+(?:\.\d+)*)")

# Wordings of widely used public licences and of the notices by which files name them.
_AS_IS_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AS_IS_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_AS_IS_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CREATIVE = "This work is licensed under a Creative Commons {} 4.0 International License."
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD": _BSD_OPENING,
    "BSD-2-Clause": f"{_BSD_OPENING} {_BSD_TWO} {_AS_IS_BSD}",
    "BSD-3-Clause": f"{_BSD_OPENING} {_BSD_TWO} {_BSD_THREE} {_AS_IS_BSD}",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": _CREATIVE.format("Attribution"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": _CREATIVE.format("Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _CREATIVE.format("Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _CREATIVE.format("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _CREATIVE.format("Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _CREATIVE.format("Attribution-ShareAlike"),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": _GNU.format("Affero General Public License", "3") + " " + _NO_WARRANTY.format("Affero General Public License"),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": _GNU.format("General Public License", "2") + " " + _NO_WARRANTY.format("General Public License"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _GNU.format("General Public License", "3"),
    "GPL-3.0-notice": _GNU.format("General Public License", "3") + " " + _NO_WARRANTY.format("General Public License"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS_ISC,
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": _GNU.format("Lesser General Public License", "3"),
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS_MIT,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-opening": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "all-rights-reserved": "All rights reserved.",
    "copyright": "Copyright (c) placeholder. All rights reserved.",
}


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with where they begin and end."""
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def folded(text: str) -> bytes:
    """A text as it is compressed: in lower case with single spaces, so that only the wording counts."""
    return " ".join(text.lower().split()).encode()


def differences(template: list[str], block: list[str]) -> list[tuple[str, str, str]]:
    """(operation, words of the template, words of the block) wherever the wording is not the template's."""
    match = difflib.SequenceMatcher(None, template, block, autojunk=False)
    return [(op, " ".join(template[a:b]), " ".join(block[c:d])) for op, a, b, c, d in match.get_opcodes() if op != "equal"]


def deciding(words: list[str]) -> list[tuple[str, ...]]:
    """What each word says about which licence it is; empty for the others. Spellings of one version are the same."""
    out = []
    before = ""
    for word in words:
        word = "license" if word in ("licence", "license") else word
        number = NUMBER.fullmatch(word)
        if number and (word[0] == "v" or before in BEFORE_VERSION):
            said: tuple[str, ...] = (re.sub(r"(\.0)+$", "", number[1]),)
        else:
            said = tuple(part for part in word.split("-") if part in DECIDING or part == "license")
        out.append(said)
        before = word.split("-")[-1]
    return out


def other_licence(template: list[str], block: list[str]) -> bool:
    """Whether a difference touches a deciding word; what fills a placeholder does not count, nor a further 'license'."""
    ours, theirs = deciding(template), deciding(block)
    match = difflib.SequenceMatcher(None, template, block, autojunk=False)
    for op, a, b, c, d in match.get_opcodes():
        if op != "equal" and not (a < b and all(w == HOLDER for w in template[a:b])):
            wanted, found = ([w for said in part for w in said] for part in (ours[a:b], theirs[c:d]))
            if "license" in wanted and "license" not in found or [w for w in wanted if w != "license"] != [w for w in found if w != "license"]:
                return True
    return False


class Scanner:
    """Templates ready for scanning: an index of their word runs, and a compressor for each."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: [w for w, _, _ in words_of(text)] for name, text in sorted(templates.items())}
        self.index = defaultdict(list)
        for name, words in self.words.items():
            size = LONG_GRAM if len(words) >= LONG else GRAM
            for at in range(len(words) - size + 1):
                if HOLDER not in words[at : at + size]:
                    self.index[tuple(words[at : at + size])].append((name, at))
        self.first_words = {gram[0] for gram in self.index}
        options = {"level": 19, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**options)
        self.given = {name: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(folded(text).ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for name, text in sorted(templates.items())}
        self.judged: dict[str, tuple | None] = {}
        self.cue = re.compile("|".join(sorted(map(re.escape, {g[1] for g in self.index}), key=len, reverse=True)), re.IGNORECASE) if self.index else None

    def candidates(self, words: list[str]) -> list[tuple[int, int]]:
        """Blocks (begin, end), in words, where a template laid along a shared run of words would lie."""
        blocks = set()
        for k, word in enumerate(words):
            if word in self.first_words:
                for name, at in [*self.index.get(tuple(words[k : k + GRAM]), ()), *self.index.get(tuple(words[k : k + LONG_GRAM]), ())]:
                    own = self.words[name]
                    begin, end = max(0, k - at), min(len(words), k - at + len(own))
                    more = HOLDER_WORDS * own.count(HOLDER)
                    if HOLDER in own[:at]:  # the notice starts further left, at the template's first word
                        early = max(0, begin - more)
                        begin = next((j for j in range(k - 1, early - 1, -1) if words[j] == own[0]), begin)
                    elif more:
                        late = min(len(words), end + more)
                        end = next((j + 1 for j in range(k + GRAM, late) if words[j] == own[-1]), end)
                    blocks.add((begin, end))
        return sorted(blocks)

    def verdict(self, block: str) -> tuple[str, float, int, list[tuple[str, str, str]]] | None:
        """judge, remembered for equal blocks."""
        if block not in self.judged:
            if len(self.judged) >= BLOCKS_KEPT:
                self.judged.clear()
            self.judged[block] = self.judge(block)
        return self.judged[block]

    def judge(self, block: str) -> tuple[str, float, int, list[tuple[str, str, str]]] | None:
        """The confirmed template of a block, its size reduction, how many words are wrong, and the differences; None without one."""
        raw = folded(block)
        size = len(self.alone.compress(raw))
        ranked = sorted(((1 - len(c.compress(raw)) / size, name) for name, c in self.given.items()), key=lambda x: (-x[0], x[1]))
        words = [w for w, _, _ in words_of(block)]
        for reduction, name in ranked:
            if reduction < LEAST_REDUCTION:
                return None
            found = differences(self.words[name], words)
            missing = sum(max(len(a.split()) - a.split().count(HOLDER), 0 if HOLDER in a.split() else len(b.split())) for _, a, b in found)
            if missing <= MOST_DIFFERENT * len(self.words[name]) and not other_licence(self.words[name], words):
                return name, reduction, missing, found
        return None

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """How many blocks were judged, and the confirmed notices of a text."""
        if self.cue is None or not self.cue.search(text):
            return 0, []
        words = words_of(text)
        blocks = self.candidates([w for w, _, _ in words])
        found = []
        for begin, end in blocks:
            start, stop = words[begin][1], words[end - 1][2]
            judged = self.verdict(text[start:stop])
            if judged:
                found.append({"license": judged[0], "start": start, "stop": stop, "reduction": judged[1], "wrong": judged[2], "differences": [{"op": o, "template": a, "found": b} for o, a, b in judged[3]]})
        kept: list[dict] = []
        for notice in sorted(found, key=lambda n: (n.pop("wrong") > 0, -(n["stop"] - n["start"]), -n["reduction"], n["start"], n["license"])):
            if all(notice["stop"] <= k["start"] or notice["start"] >= k["stop"] for k in kept):
                kept.append(notice)
        return len(blocks), sorted(kept, key=lambda n: n["start"])


def notices(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_blocks, notices (license, start, stop, reduction, differences) of every row; places are in characters."""
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        difference = pa.struct([("op", pa.string()), ("template", pa.string()), ("found", pa.string())])
        notice = pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("reduction", pa.float64()), ("differences", pa.list_(difference))])
        for batch in batches:
            found = [scanner.scan(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(notice))], names=["doc_id", "n_blocks", "notices"])

    kind = dict(docs.dtypes)["doc_id"]
    fields = "license string, start int, stop int, reduction double, differences array<struct<op string, template string, found string>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_blocks int, notices array<struct<{fields}>>")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, licenses, spans, best_reduction, n_differences of every row."""
    found = notices(docs)
    return found.select(
        "doc_id",
        "n_blocks",
        F.array_join(F.array_sort(F.array_distinct("notices.license")), ",").alias("licenses"),
        F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["license"], n["start"], n["stop"])), ",").alias("spans"),
        F.round(F.array_max("notices.reduction"), 6).alias("best_reduction"),
        F.aggregate("notices", F.lit(0), lambda total, n: total + F.size(n["differences"])).alias("n_differences"),
    )
