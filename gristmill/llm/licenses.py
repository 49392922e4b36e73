"""Licence scan by sentence rules (operator 9).

Texts are cut into pieces at punctuation and line breaks, each normalised (lower case, everything
but letters, digits and inner dots becomes one space, comment marks too). Pieces with one line
break between and no punctuation before it are read on as one sentence, so wrapped sentences are
found; the longest run of pieces that is a known licence sentence is one. Blank lines, those of
comment marks alone too, end a sentence and count as none. The resulting
sequence of identifiers is matched against ordered rules, the longest first; a rule's
identifiers must follow each other in order with at most `gap` foreign sentences between two.
A sentence serves one match. The tables are parameters of fixed size, so nothing that grows with
the corpus is broadcast or shuffled: the scan is one narrow pass.

Defined cases: null or empty texts match nothing; repeated sentences match each time; repeated
rows give repeated results; an empty table gives no rows; sentences of any length are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import map_rows

# Public licence texts, sentence by sentence, and the order in which they make a licence.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-1": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-3": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-4": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-1": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-2": "You may obtain a copy of the License at",
    "apache-3": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-4": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-old-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-2": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-5": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
RULES = (
    ("mit-whole", "MIT", ("mit-1", "mit-2", "mit-3", "mit-4")),
    ("apache-whole", "Apache-2.0", ("apache-1", "apache-2", "apache-3", "apache-4")),
    ("bsd3-whole", "BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4", "bsd-5")),
    ("bsd3-conditions", "BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4")),
    ("bsd2-whole", "BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-5")),
    ("bsd2-conditions", "BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("isc-whole", "ISC", ("isc-1", "isc-2")),
    ("mpl-header", "MPL-2.0", ("mpl-1", "mpl-2")),
    ("unlicense-whole", "Unlicense", ("unlicense-1", "unlicense-2")),
    ("gpl2-header", "GPL-2.0-or-later", ("gpl-old-1", "gpl-2")),
    ("agpl3-header", "AGPL-3.0-or-later", ("agpl-1", "gpl-2")),
    ("mit-full", "MIT", ("mit-1", "mit-2", "mit-3")),
    ("mit-grant", "MIT", ("mit-1", "mit-2")),
    ("apache-header", "Apache-2.0", ("apache-1", "apache-2")),
    ("gpl3-header", "GPL-3.0-or-later", ("gpl-1", "gpl-2")),
    ("mit-notice", "MIT", ("mit-notice",)),
    ("mit-notice-2", "MIT", ("mit-notice-2",)),
    ("apache-notice", "Apache-2.0", ("apache-notice",)),
    ("apache-line", "Apache-2.0", ("apache-1",)),
    ("gpl3-notice", "GPL-3.0-only", ("gpl3-notice",)),
    ("gpl2-notice", "GPL-2.0-only", ("gpl2-notice",)),
    ("gpl3-line", "GPL-3.0-or-later", ("gpl-1",)),
    ("gpl2-line", "GPL-2.0-or-later", ("gpl-old-1",)),
    ("lgpl-line", "LGPL-2.1-or-later", ("lgpl-1",)),
    ("agpl3-line", "AGPL-3.0-or-later", ("agpl-1",)),
    ("isc-line", "ISC", ("isc-1",)),
    ("unlicense-line", "Unlicense", ("unlicense-1",)),
    ("bsl-line", "BSL-1.0", ("bsl-1",)),
    ("bsd-conditions", "LicenseRef-BSD", ("bsd-1",)),
    ("bsd-notice", "LicenseRef-BSD", ("bsd-notice",)),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("cc-by-notice", "CC-BY-4.0", ("cc-by-notice",)),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("cc0-notice", "CC0-1.0", ("cc0-notice",)),
)
_END = re.compile(r"(?<=[.!?])[ \t]+|[\r\n]+")
_BREAK = re.compile(r"\r\n|\r|\n")
_WORD = re.compile(r"[0-9a-z.]*[0-9a-z][0-9a-z.]*")
_OTHER = re.compile(r"[^0-9a-z.]+")
SCHEMA = "doc_id long, license string, rule string, first_sentence long, last_sentence long, start_char long, end_char long"


@dataclass(frozen=True)
class LicenseParams:
    gap: int = 2


def normalise(sentence: str) -> str:
    return " ".join(x.strip(".") for x in _OTHER.sub(" ", sentence.lower()).split() if x.strip("."))


def _known(sentences: dict[str, str]) -> tuple[dict[str, str], frozenset[str]]:
    """Identifiers by normalised sentence, and the first words that known sentences begin with."""
    table: dict[str, str] = {}
    for name, sentence in sentences.items():
        whole = [normalise(x) for x in _END.split(sentence) if x]
        if len(whole) != 1:
            raise ValueError(f"{name} is not one sentence")
        table[whole[0]] = name
    return table, frozenset(x.split(" ")[0] for x in table)


def sentences_of(text: str):
    """(start, end) of each non-empty sentence, in code points."""
    at = 0
    for cut in _END.finditer(text):
        if cut.start() > at:
            yield at, cut.start()
        at = cut.end()
    if at < len(text):
        yield at, len(text)


def _wrapped(text: str, before: tuple[int, int], after: tuple[int, int]) -> bool:
    """Whether a sentence may go on from one piece to the next: over one line break, without punctuation."""
    return text[before[1] - 1] not in ".!?" and len(_BREAK.findall(text, before[1], after[0])) == 1


def known_sentences(text: str, table: dict[str, str], starts: frozenset[str]) -> list[tuple[int, str, int, int]]:
    """(sentence number, identifier, start, end) of each known sentence."""
    pieces: list[tuple[int, int, str]] = []
    joins: list[bool] = []  # with the piece before
    last = None
    for piece in sentences_of(text):
        word = _WORD.search(text[piece[0] : piece[1]].lower())
        if word:
            joins.append(last is not None and _wrapped(text, last, piece))
            pieces.append((*piece, word.group().strip(".")))
        last = piece if word else None
    found, number, i, fresh = [], -1, 0, True
    while i < len(pieces):
        best, name = 0, ""
        if pieces[i][2] in starts:
            sentence, j = "", i
            while j < len(pieces) and (j == i or joins[j]):
                sentence = f"{sentence} {normalise(text[pieces[j][0] : pieces[j][1]])}".lstrip()
                j += 1
                if sentence in table:
                    best, name = j, table[sentence]
                if not any(x.startswith(sentence + " ") for x in table):
                    break
        if best:
            number += 1
            found.append((number, name, pieces[i][0], pieces[best - 1][1]))
            i, fresh = best, True
        else:
            number += fresh or not joins[i]
            i, fresh = i + 1, False
    return found


def scan_text(text: str | None, known, rules, gap: int) -> list[tuple[str, str, int, int, int, int]]:
    """(license, rule, first and last sentence, start and end character) of each match in a text."""
    found = known_sentences(text, *known) if text else []
    out, free = [], [True] * len(found)
    for rule, licence, ids in sorted(rules, key=lambda r: -len(r[2])):
        for first in range(len(found)):
            chain: list[int] = []
            for j in range(first, len(found)):
                near = not chain or found[j][0] - found[chain[-1]][0] <= gap + 1
                if not near or len(chain) == len(ids):
                    break
                if free[j] and found[j][1] == ids[len(chain)]:
                    chain.append(j)
                elif not chain:
                    break
            if len(chain) == len(ids):
                for j in chain:
                    free[j] = False
                out.append((licence, rule, found[chain[0]][0], found[chain[-1]][0], found[chain[0]][2], found[chain[-1]][3]))
    return sorted(out, key=lambda x: (x[2], x[1]))


def license_scan(docs: DataFrame, sentences=None, rules=RULES, params: LicenseParams = LicenseParams()) -> DataFrame:
    """One row a match: doc_id, license, rule, sentence and character ranges."""
    sentences = sentences or SENTENCES

    def make():
        known = _known(sentences)
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4]
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

        def step(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, *m) for i, x in zip(ids, texts) for m in scan_text(x, known, rules, params.gap)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

        return step

    return map_rows(docs.select("doc_id", "text"), SCHEMA, make)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES: dict[str, str] = {}
