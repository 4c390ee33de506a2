"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultline.llm.words import map_texts, windows, words_of

# fixed values: public licence texts and the notices that name them
WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. ")
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. ")
TEMPLATES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
            "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. " + WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
            "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
            "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
            "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
            "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", BSD_TWO + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_TWO + BSD_THIRD + BSD_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                   "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
                "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
                "received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

NOTICES = (
    ("BSD-3-Clause", "This project is licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "This project is licensed under the BSD 2-Clause License."),
    ("ISC", "This project is licensed under the ISC License."), ("MIT", "Licensed under the MIT License."), ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    *((name, f"{head} licensed under the GNU {kind} General Public License, version {n}.".replace("  ", " "))
      for name, kind, n in (("GPL-2.0", "", "2"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3")) for head in ("This work is",)),
    *((name, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU " + kind + " General Public License as published by "
             "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
             "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
             + kind + " General Public License for more details. You should have received a copy of the GNU " + kind + " General Public License along with this "
             "program. If not, see <https://www.gnu.org/licenses/>.") for name, kind in (("LGPL-3.0", "Lesser"), ("AGPL-3.0", "Affero"))),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    *((f"CC-{short}-4.0", head + name) for short, long in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for head, name in (("Licensed under ", f"CC {short} 4.0."), ("", f"Creative Commons {long} 4.0 International"),
                         ("This work is licensed under a ", f"Creative Commons {long} 4.0 International License."))),
    ("All-rights-reserved", "All rights reserved."),
)


def all_templates() -> list[tuple[str, str]]:
    """Templates, notices and the full texts beside this file (named by licence)."""
    names = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0"}
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return [*TEMPLATES, *NOTICES, *((names.get(f.stem, f.stem), f.read_text(encoding="utf-8")) for f in files)]


MATCH = T.StructType([T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()),
                      T.StructField("line", T.IntegerType()), T.StructField("lines", T.IntegerType())])
FOUND = T.StructType([T.StructField("matches", T.ArrayType(MATCH))])


class Template(NamedTuple):
    licence: str
    grams: np.ndarray  # sorted distinct word bigrams


def ascii_words() -> np.ndarray:
    """Byte table of `[a-z0-9]` after A-Z are lower-cased: the words of a normalised text."""
    table = np.zeros(256, bool)
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    return table


def compile_templates(templates) -> list[Template]:
    out = []
    for name, text in templates:
        grams = np.unique(windows(words_of(pa.array([text], pa.string()), ascii_words(), lower=True).hash, 2))
        if not len(grams):
            raise ValueError(f"template of {name} has fewer than two words")
        out.append(Template(name, grams))
    return sorted(out, key=lambda t: len(t.grams))


def scan_licences(docs: DataFrame, templates=TEMPLATES, text: str = "text", least: float = 0.8, out: str = "licences", inside: bool = False) -> DataFrame:
    """Adds struct `licences` with `matches` (licence, dice, line, lines), each licence of a text once, by its best stretch.

    A text is compared as a whole, by stretches of lines without a line free of words between
    them, and line by line; words are runs of a-z and 0-9 with A-Z lower-cased, everything else separates. Dice is twice
    the shared bigrams over the sum of both sets' sizes. Only templates whose size lets Dice reach
    `least` are compared: size bounds prune them, and so does a stretch without a bigram of any
    template. Ties go to the earlier, longer stretch; matches are sorted by licence. Null, empty and one-word texts
    have no match. With `inside` every run of words is compared instead, wherever lines end (`window_matches`), and of
    licences that claim the same words the best stays. Templates are a parameter (pairs of name and text); columns pass through.
    """
    compiled = compile_templates(templates)

    def start():
        table = ascii_words()
        known = np.unique(np.concatenate([t.grams for t in compiled])) if compiled else np.zeros(0, np.uint64)

        def work(texts: pa.Array) -> list[pa.Array]:
            words = words_of(texts, table, lower=True)
            breaks = np.flatnonzero(words.raw == 10)
            line = np.searchsorted(breaks, words.start)
            grams = windows(words.hash, 2)
            hits = np.flatnonzero(np.isin(grams, known))
            rows = []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                lo, hi = np.searchsorted(hits, (a, b - 1))
                find = window_matches if inside else best_matches
                rows.append(find(grams, line, a, b, hits[lo:hi], compiled, least) if hi > lo else [])
            return [pa.array(rows, pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("line", pa.int32()), ("lines", pa.int32())])))]

        return work

    return map_texts(docs, text, out, FOUND, start)


def best_matches(grams: np.ndarray, line: np.ndarray, a: int, b: int, hits: np.ndarray, templates: list, least: float) -> list:
    """Best match of each licence among the stretches of words a to b that hold a bigram of a template."""
    own = line[a:b]
    edges = a + np.flatnonzero(np.diff(own, prepend=-9))  # first word of each line with words
    gaps = a + np.flatnonzero(np.diff(own, prepend=-9) > 1)  # and of each stretch
    stretches = {(a, b)}
    for cuts in (gaps, edges):
        ends = np.append(cuts[1:], b)
        at = np.unique(np.searchsorted(cuts, hits, "right") - 1)
        stretches |= {(int(cuts[i]), int(ends[i])) for i in at}
    best: dict = {}
    for i, j in sorted(stretches, key=lambda s: (s[0], -s[1])):
        if j - i < 2:
            continue
        held = np.unique(grams[i:j - 1])
        for t in templates:
            n, m = len(held), len(t.grams)
            if 2 * min(n, m) < least * (n + m):
                continue
            dice = 2 * len(np.intersect1d(held, t.grams, assume_unique=True)) / (n + m)
            if dice >= least and dice > best.get(t.licence, (0,))[0]:
                best[t.licence] = (dice, int(line[i] - line[a]), int(line[j - 1] - line[i] + 1))
    return [{"licence": k, "dice": v[0], "line": v[1], "lines": v[2]} for k, v in sorted(best.items())]


def window_matches(grams: np.ndarray, line: np.ndarray, a: int, b: int, hits: np.ndarray, templates: list, least: float) -> list:
    """Best match of each licence among all runs of words a to b.

    A best run starts and ends with a bigram of the template. For each start Dice of all ends is
    computed as long as the run has no more distinct bigrams than Dice allows. Runs are chosen by shared bigrams times Dice;
    one that has most of its words in a chosen run of another licence goes.
    """
    own = grams[a:b - 1]
    present = np.unique(grams[hits])
    found = []
    before = None
    for t in templates:
        m = len(t.grams)
        need, most = least * m / (2 - least) - 1e-9, m * (2 - least) / least + 1e-9
        if len(np.intersect1d(present, t.grams, assume_unique=True)) < need:
            continue
        if before is None:
            before = np.full(len(own), -1)
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            before[order[1:][same]] = order[:-1][same]
        at = hits - a
        place = np.minimum(np.searchsorted(t.grams, grams[hits]), m - 1)
        at = at[t.grams[place] == grams[hits]]
        hit = np.zeros(len(own), bool)
        hit[at] = True
        for i in at.tolist():
            size = int(most) + 1
            while True:
                part = slice(i, i + size)
                fresh = before[part] < i
                n = np.cumsum(fresh)
                if n[-1] > most or i + size >= len(own):
                    break
                size *= 2
            c = np.cumsum(fresh & hit[part])
            if c[-1] < need:
                continue
            dice = 2 * c / (n + m)
            j = int(np.argmax(dice))
            if dice[j] >= least:
                found.append((-float(c[j] * dice[j]), i, i + j + 1, float(dice[j]), t.licence))
    taken = np.full(len(own), -1)
    names: list = []
    best: dict = {}
    for _, i, j, dice, licence in sorted(found):
        if licence not in names:
            names.append(licence)
        number = names.index(licence)
        other = (taken[i:j] >= 0) & (taken[i:j] != number)
        if 2 * np.count_nonzero(other) > j - i:
            continue
        taken[i:j][~other] = number
        if dice > best.get(licence, (0,))[0]:
            best[licence] = (dice, int(line[a + i] - line[a]), int(line[a + j] - line[a + i] + 1))
    return [{"licence": k, "dice": v[0], "line": v[1], "lines": v[2]} for k, v in sorted(best.items())]
