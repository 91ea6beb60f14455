"""License scans by patience alignment.

Templates are whole texts and the notices that stand for them; a ``*`` marks the
words that tell a license from its neighbours (version, clause, variant), and a
template may forbid words within its span. The rarest marked word is a template's
key, as no span counts without it; a template without marks has so many of its
rarest words as keys that a text without any of them misses more than
``min_coverage`` allows. Around every occurrence of a key behind the last span
found a window of the text, as long on either side as the longest span, is
aligned with the template; first one that holds the key once, so that adjacent
copies stay apart:
words that occur once in both are anchors, the longest increasing subsequence of
the anchors holds the order, equal words beside them extend the match, and the
gaps between anchors are aligned in the same way. ``coverage`` is the share of
the template's words that align; a span counts as found from ``min_coverage``
on, if all marked words align, no forbidden word is left over within it, and at
least ``min_density`` of the text's words within it align as well, so that words
scattered over a page are no license. Overlapping spans are decided by coverage,
then by the longer template, then by name.

Whole texts are searched for keys; only texts with a key reach the aligner, a
text at a time, whatever its length.

Defined cases: null text has no licenses; coverage is 0, license null and spans
are empty where nothing is found; repeated rows get a row each; other columns are
kept, those named like a result are replaced by it; empty tables give empty
results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused, without

MIN_COVERAGE = 0.8
MIN_DENSITY = 0.6
KEYS_PER_TEMPLATE = 3

# License texts and notices, as their authors publish them; * marks words that must align.
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. *Neither the name of the copyright holder nor the names of its contributors may be used to *endorse or *promote products derived "
    "from this software without specific prior written permission."
)
_PERMISSION = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
    "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_NO_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU_NOTICE = (
    "is free software: you can redistribute it and/or modify it under the terms of the *GNU {kind} as published by the Free Software "
    "Foundation, either *version {version} of the License, or (at your option) any later version. {it} is distributed in the hope that it "
    "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {kind} for more details."
)
_GNU_KINDS = {"GPL": "*General *Public License", "LGPL": "*Lesser *General *Public License", "AGPL": "*Affero *General *Public License"}
_CC_WORDS = {"BY": "*Attribution", "SA": "*ShareAlike", "NC": "*NonCommercial", "ND": "*NoDerivatives"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _marked(words: str) -> str:
    """Every part of a name or version marked."""
    return re.sub(r"([^\W_]+)", r"*\1", words)


def _families() -> dict[str, tuple[str, ...]]:
    """The templates of licenses that differ by version and variant only."""
    out: dict[str, tuple[str, ...]] = {}
    for family, versions in (("GPL", ("1", "2", "3")), ("LGPL", ("2", "2.1", "3")), ("AGPL", ("3",))):
        kind = _GNU_KINDS[family]
        for v in versions:
            name, marked = f"{family}-{v if '.' in v else v + '.0'}", _marked(v)
            it = "This library" if family == "LGPL" else "This program"
            notice = f"{it} {_GNU_NOTICE.format(kind=kind, version=marked, it=it)}"
            out[name] = (notice, f"This work is licensed under the *GNU {kind}, version {marked}", f"Licensed under the *{family} version {marked}")
    for parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        spoken = "-".join(_CC_WORDS[p] for p in parts.split("-"))
        for v in _CC_VERSIONS:
            suffix = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            out[f"CC-{parts}-{v}"] = (f"Licensed under *CC {_marked(parts)} {_marked(v)}", f"This work is licensed under a *Creative *Commons {spoken} {_marked(v)} {suffix} License")
    return out


TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the *Apache License, Version *2.0",
        'Licensed under the *Apache License, Version *2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "Apache-1.1": ("Licensed under the *Apache License, Version *1.1",),
    "MIT": ("Released under the *MIT License", _PERMISSION + _NO_WARRANTY),
    "BSD-2-Clause": ("Released under the *BSD *2 *Clause License", _BSD_TWO + " " + _DISCLAIMER, _BSD_TWO),
    "BSD-3-Clause": ("Released under the *BSD *3 *Clause License", _BSD_TWO + _BSD_THIRD + " " + _DISCLAIMER, _BSD_TWO + _BSD_THIRD),
    "ISC": (
        "Released under the *ISC License",
        _USE + ", provided that the above copyright notice and this permission notice appear in all copies.",
        _USE + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_WARRANTY,
    ),
    "0BSD": (_USE + "." + _ISC_WARRANTY,),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
        "altered from any source distribution.",
    ),
    "BSL-1.0": ("Distributed under the *Boost Software License, Version *1.0",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    "MPL-1.1": ("This Source Code Form is subject to the terms of the *Mozilla Public License, v. *1.1",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the *Mozilla Public License, v. *2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the *Mozilla Public License, v. *2.0",
    ),
    "EPL-1.0": ("made available under the terms of the *Eclipse Public License *v1.0", "made available under the terms of the *Eclipse Public License *1.0"),
    "EPL-2.0": ("made available under the terms of the *Eclipse Public License *v2.0", "made available under the terms of the *Eclipse Public License *2.0"),
    "CC0-1.0": ("Licensed under *CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under *CC0"),
} | _families()
#: Words that no span of a template whose name begins so may hold beside its own.
FORBIDDEN = {"GPL": {"lesser", "affero", "library"}, "CC-": {"nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs"}, "BSD-2": {"neither", "endorse", "advertising"}, "Apache": {"proprietary"}}

_WORD = re.compile(r"[^\W_]+")


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence, increasing in the second place, of pairs sorted by the first."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [y], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """(place in text, place in template) of the words that align, in order."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(template[c:d], c) if in_template[w] == 1}
        anchors = _longest_increasing([(i, where[w]) for i, w in enumerate(text[a:b], a) if in_text[w] == 1 and w in where])
        x, y = a, c
        for i, j in anchors:
            matched.append((i, j))
            gaps.append((x, i, y, j))
            x, y = i + 1, j + 1
        if anchors:
            gaps.append((x, b, y, d))
    return sorted(matched)


def _least(words: list[str], share: float) -> int:
    """The least whole number of words that is ``share`` of them or more."""
    return next(n for n in range(max(0, math.floor(share * len(words)) - 1), len(words) + 2) if n >= share * len(words))


def _keys(words: list[str], marked: set[int], spread: Counter, min_coverage: float) -> set[str]:
    """The rarest of the marked words; without marks the rarest words that fill
    more places than may go missing."""
    if marked:
        return {min((words[i] for i in marked), key=lambda w: (w[-1].isdigit(), spread[w], -len(w), w))}
    times, spare = Counter(words), len(words) - _least(words, min_coverage)
    keys: set[str] = set()
    for w in sorted(times, key=lambda w: (spread[w], -len(w), w)):
        if len(keys) >= KEYS_PER_TEMPLATE and sum(times[k] for k in keys) > spare:
            break
        keys.add(w)
    return keys


class Template(NamedTuple):
    name: str
    words: list[str]
    keys: set[str]
    #: Places of the words that must align.
    marked: set[int]
    forbidden: set[str]


def prepared(templates: dict[str, tuple[str, ...]] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> list[Template]:
    cut = []
    for name, texts in templates.items():
        for t in texts:
            found = list(_WORD.finditer(t))
            cut.append((name, [m.group().lower() for m in found], {i for i, m in enumerate(found) if t[m.start() - 1 : m.start()] == "*"}))
    spread = Counter(w for _, ws, _ in cut for w in set(ws))
    out = []
    for name, ws, marked in cut:
        # A version's last part stands and falls with the one before it.
        marked |= {i + 1 for i in marked if ws[i][-1].isdigit() and i + 1 < len(ws) and ws[i + 1].isdigit()}
        forbidden = set().union(*(f for start, f in FORBIDDEN.items() if name.startswith(start))) - set(ws)
        out.append(Template(name, ws, _keys(ws, marked, spread, min_coverage), marked, forbidden))
    return out


def _possible(ws: list[str], template: list[str], reach: int, least: int) -> np.ndarray:
    """For every place, if a run of ``reach`` words around it has ``least`` words
    of the template's, in whatever order."""
    n, vocabulary = len(ws), set(template)
    upto = np.concatenate([[0], np.cumsum(np.fromiter((w in vocabulary for w in ws), bool, n))])
    at = np.arange(n)
    enough = np.concatenate([[0], np.cumsum(upto[np.minimum(at + reach, n)] - upto[:n] >= least)])
    return enough[1:] > enough[np.maximum(at - reach + 1, 0)]


def scan(text: str | None, templates, min_coverage: float = MIN_COVERAGE, min_density: float = MIN_DENSITY) -> list[tuple[str, float, int, int]]:
    """(name, coverage, start, end) in code points of the licenses of a text."""
    places = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text or "")]
    ws = [w for w, _, _ in places]
    keyed: dict[str, list[int]] = {}
    keys = set().union(*(t.keys for t in templates))
    for i, w in enumerate(ws):
        if w in keys:
            keyed.setdefault(w, []).append(i)
    found = []
    for name, template, own, marked, forbidden in templates:
        if not any(k in keyed for k in own):
            continue
        seen = -1
        reach = math.ceil(len(template) / min_density)
        tries = sorted((x, n, k) for k in own for n, x in enumerate(keyed.get(k, ())))
        possible = _possible(ws, template, reach, _least(template, min_coverage)) if tries else []
        for i, n, key in tries:
            if i <= seen or not possible[i]:
                continue
            lo, hi = max(seen + 1, i - reach), min(len(ws), i + reach)
            windows = [(lo, hi)]
            if template.count(key) == 1:
                same = keyed[key]
                left, right = same[n - 1] + 1 if n else 0, same[n + 1] if n + 1 < len(same) else hi
                windows = [(max(lo, left), min(hi, right)), *windows]
            pairs: list[tuple[int, int]] = []
            for a, b in dict.fromkeys(windows):
                if len(pairs) == len(template):
                    break
                # Stray matches at the ends are cut where they thin the span out.
                tried = _dense([(x + a, y) for x, y in align(ws[a:b], template)], min_density)
                if len(tried) > len(pairs) and tried[0][0] <= i <= tried[-1][0]:
                    pairs = tried
            if pairs and len(pairs) >= min_coverage * len(template) and _tells(ws, pairs, marked, forbidden):
                first, last = pairs[0][0], pairs[-1][0]
                found.append((name, len(pairs) / len(template), places[first][1], places[last][2], len(template)))
                seen = last
    found.sort(key=lambda f: (-f[1], -f[4], f[0], f[2]))
    kept: list[tuple] = []
    for f in found:
        if all(f[3] <= k[2] or f[2] >= k[3] for k in kept):
            kept.append(f)
    return sorted(((n, c, a, b) for n, c, a, b, _ in kept), key=lambda f: f[2])


def _tells(ws: list[str], pairs: list[tuple[int, int]], marked: set[int], forbidden: set[str]) -> bool:
    """Whether all marked words align and no forbidden one is left over."""
    if not marked <= {y for _, y in pairs}:
        return False
    rest = set(range(pairs[0][0], pairs[-1][0] + 1)) - {x for x, _ in pairs} if forbidden else ()
    return not any(ws[x] in forbidden for x in rest)


def _dense(pairs: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
    """The longest run of matches whose share of the words they span is at least
    ``least``, cutting the wider gap at either end first."""
    a, b = 0, len(pairs)
    while b - a > 1 and b - a < least * (pairs[b - 1][0] - pairs[a][0] + 1):
        if pairs[a + 1][0] - pairs[a][0] >= pairs[b - 1][0] - pairs[b - 2][0]:
            a += 1
        else:
            b -= 1
    return pairs[a:b]


def find_licenses(docs: DataFrame, text_col: str = "text", *, templates: dict[str, tuple[str, ...]] = TEMPLATES, min_coverage: float = MIN_COVERAGE, min_density: float = MIN_DENSITY) -> DataFrame:
    """``docs`` without the text, with n_licenses, license (that of the greatest
    coverage), coverage and license_spans (name:start:end, comma-joined)."""
    ready = prepared(templates, min_coverage)
    heads: dict[str, list[str]] = {}
    docs = without(docs, *({"n_licenses", "license", "coverage", "license_spans"} - {text_col}))
    for k in sorted(set().union(*(t.keys for t in ready))):
        heads.setdefault(k[0], []).append(re.escape(k[1:]))
    keys = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in heads.items())
    keyed = F.coalesce(F.col(text_col), F.lit("")).rlike(rf"(?i)(?<![a-z0-9])(?:{keys})")

    # Only texts go through Python: other columns stay as they are.
    @F.pandas_udf("n_licenses long, license string, coverage double, license_spans string")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        found = [scan(t, ready, min_coverage, min_density) if t else [] for t in texts]
        best = [max(f, key=lambda x: x[1], default=None) for f in found]
        return pd.DataFrame({
            "n_licenses": [len(f) for f in found], "license": pd.Series([b and b[0] for b in best], dtype=object), "coverage": [b[1] if b else 0.0 for b in best],
            "license_spans": [",".join(f"{n}:{s}:{e}" for n, _, s, e in f) for f in found],
        })

    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    found = unused(docs, "scanned")
    offered = F.when(keyed, F.col(text_col))
    return docs.select(*kept, scanned(offered).alias(found)).select(*kept, f"{found}.*")
