"""Licence scans: MinHash over overlapping windows of words, then exact containment.

Templates are grouped by length; for each group the text is cut into windows a little longer than its longest template, at
strides so short that a copy of any of its templates lies whole in one window. A window meets a template where one of its
BANDS minima equals the template's. `collision` gives the probability of that for the least similarity a match can have;
the tests hold it above 0.999 for every template. A window is a match where it holds at least CONTAINMENT of the
template's shingles, counted exactly; overlapping matches of a template become one, cut to its
shingles and cut again into copies. Of overlapping matches of several templates that stays which holds CONTAINMENT of the shingles that tell it
from the others, so a variant of a licence is not named by its relatives; of several such, the one that holds most.

Null, empty and blank texts match nothing. Repeated rows have equal matches. Texts of any length are scanned whole;
windows never reach over two texts.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import arrow_append, load, tune
from folio.llm.ngram_join import mix, word_hashes

#: Words of a shingle, minima (bands of one row) of a window, share of a template's shingles that a match holds.
SHINGLE, BANDS, CONTAINMENT = 2, 20, 0.75
#: How much longer the longest template of a group may be than its shortest.
CLASS = 1.6

# Notices and conditions of common licences.
_SHARE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_MIT_REST = ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_END = " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_CC = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-ND-4.0": "Attribution-NoDerivatives", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike", "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", *_CC, "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")
TEMPLATES = [
    *[(name, f"Licensed under {name[:-4].replace('-', ' ', 1)} 4.0.") for name in _CC],
    *[(name, f"This work is licensed under a Creative Commons {terms} 4.0 International License.") for name, terms in _CC.items()],
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", _SHARE.format("General Public License", "2")),
    ("GPL-3.0", _SHARE.format("General Public License", "3")),
    ("AGPL-3.0", _SHARE.format("Affero General Public License", "3")),
    ("LGPL-2.1", _LIBRARY.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _LIBRARY.format("Lesser General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_REST + _AS_IS),
    ("BSD", _BSD),
    ("BSD-2-Clause", _BSD + _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_TWO + _BSD_THIRD + _BSD_END),
    ("0BSD", _ISC + _ISC_END),
    ("ISC", _ISC + _ISC_KEEP + _ISC_END),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    *[(name, f"SPDX-License-Identifier: {name}") for name in _SPDX],
]

#: Bytes of text that are scanned at once.
CHUNK = 1 << 18
#: Letters lower-cased, other ASCII than letters and digits blank; byte for byte, so places in the text are kept.
FOLD = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SEEDS = np.random.default_rng(4).integers(1, 1 << 62, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    if len(words) < SHINGLE:
        return np.empty(0, np.uint64)
    h = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - SHINGLE + 1 + j]
    return mix(h)


def collision(similarity: float, bands: int = BANDS) -> float:
    """The probability that one of the minima of two sets of this similarity is equal."""
    return 1 - (1 - similarity) ** bands


class Group:
    """Templates of about a length, with the windows that suit them."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.members = members
        longest = max(len(np.atleast_1d(s)) for _, s in members) + SHINGLE - 1
        self.stride = max(2, longest // 4)
        blocks = -(-(longest - SHINGLE + 1) // self.stride) + 1
        self.width = blocks * self.stride  # shingles of a window: any template lies whole in one
        self.blocks = blocks
        self.sets = {k: np.unique(s) for k, s in members}
        self.minima = [[((s * seed).min(), k) for k, s in members] for seed in SEEDS]

    def least_similarity(self, k: int) -> float:
        """Of a window that holds a match of member k."""
        m = len(self.sets[k])
        held = np.ceil(CONTAINMENT * m)
        return float(held / (self.width + m - held))

    def collisions(self, hashed: np.ndarray, band: int) -> set[tuple[int, int]]:
        """(window, member) pairs with an equal minimum in a band; window w starts at shingle w * stride.

        hashed: the shingles' hashes in this band.
        """
        n = -(-len(hashed) // self.stride)
        low = hashed[:: self.stride].copy()
        for j in range(1, self.stride):
            part = hashed[j :: self.stride]
            np.minimum(low[: len(part)], part, out=low[: len(part)])
        win = low.copy()
        for j in range(1, min(self.blocks, n)):
            np.minimum(win[: n - j], low[j:], out=win[: n - j])
        return {(w, k) for value, k in self.minima[band] for w in np.flatnonzero(win == value).tolist()}


def copies(h: np.ndarray, own: np.ndarray, a: int, b: int, share: float) -> list[tuple[int, int, float]]:
    """The copies of a template in words a to b, cut where more than a quarter of its length has none of its shingles.

    Parts that hold too little are one with the parts beside them up to the next copy; where no part is a copy, a to b is one.
    """
    at = a + np.flatnonzero(np.isin(h[a : b - SHINGLE + 1], own))
    runs: list[tuple[bool, list[np.ndarray]]] = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > max(2, len(own) // 4)) + 1):
        whole = len(np.unique(h[part])) >= CONTAINMENT * len(own)
        if whole or not runs or runs[-1][0]:
            runs.append((whole, [part]))
        else:
            runs[-1][1].append(part)
    shares = [(parts[0][0], parts[-1][-1] + SHINGLE, len(np.unique(h[np.concatenate(parts)])) / len(own)) for _, parts in runs]
    return [(int(x), int(y), z) for x, y, z in shares if z >= CONTAINMENT] or [(a, b, share)]


def telling(found: list[dict], sets: list[np.ndarray]) -> None:
    """Sets `told` of each match: the least share of its template's shingles that an overlapping match of another licence lacks.

    Matches of one template are disjoint, so as many overlap in a place as there are templates at most.
    """
    live: list[dict] = []
    for m in sorted(found, key=lambda m: m["start"]):
        m["told"] = 1.0
        live = [x for x in live if x["end"] > m["start"]]
        for x in live:
            if x["license"] != m["license"]:
                for one, other in ((m, x), (x, m)):
                    own = np.setdiff1d(sets[one["template"]], sets[other["template"]])
                    if len(own):
                        one["told"] = min(one["told"], float(np.isin(own, one["held"]).mean()))
        live.append(m)


def best(found: list[dict], sets: list[np.ndarray]) -> list[dict]:
    """The matches in order. Of overlapping ones that stays which holds what tells it from the others; then the one that holds most shingles."""
    telling(found, sets)
    out: list[dict] = []
    starts: list[int] = []
    for m in sorted(found, key=lambda m: (-min(m["told"], CONTAINMENT), -len(m["held"]), m["start"], m["template"])):
        k = bisect.bisect_left(starts, m["end"])
        if not k or out[k - 1]["end"] <= m["start"]:
            starts.insert(k, m["start"])
            out.insert(k, m)
    return [{f: m[f] for f in ("license", "template", "start", "end", "containment")} for m in out]


class Templates:
    def __init__(self, rows: list[tuple[str, str]] = TEMPLATES):
        self.names = [name for name, _ in rows]
        hashed = [(k, shingles(word_hashes(text.encode().translate(FOLD))[0])) for k, (_, text) in enumerate(rows)]
        self.sets = [np.unique(s) for _, s in hashed]
        self.every = np.unique(np.concatenate(self.sets))
        self.least = np.array([np.ceil(CONTAINMENT * len(s)) for s in self.sets])
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, s in hashed:
            if len(s):
                classes.setdefault(int(np.ceil(np.log(len(s)) / np.log(CLASS))), []).append((k, s))
        self.groups = [Group(m) for _, m in sorted(classes.items())]

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text its matches: licence, start and end (code points), containment."""
        out: list[list[dict]] = [[] for _ in texts]
        at = 0
        while at < len(texts):
            raw: list[bytes] = []
            size = 0
            while at + len(raw) < len(texts) and (not raw or size < CHUNK):
                raw.append((texts[at + len(raw)] or "").encode("utf-8", "surrogatepass"))
                size += len(raw[-1]) + 1
            whole = b" ".join(raw).translate(FOLD)
            words, starts = word_hashes(whole)
            h = shingles(words)
            offsets = np.cumsum([0, *[len(r) + 1 for r in raw]])
            bounds = np.searchsorted(starts, offsets)
            if len(h):
                near = np.minimum(np.searchsorted(self.every, h), len(self.every) - 1)
                known = np.flatnonzero(self.every[near] == h)  # places of any template's shingles
                met: list[set[tuple[int, int]]] = [set() for _ in self.groups]
                for band, seed in enumerate(SEEDS):
                    hashed = h * seed
                    for group, pairs in zip(self.groups, met, strict=True):
                        pairs |= group.collisions(hashed, band)
                for group, pairs in zip(self.groups, met, strict=True):
                    pairs = self._possible(group, pairs, known)
                    if pairs:
                        self._verify(group, pairs, h, bounds, starts, offsets, whole, raw, out, at)
            at += len(raw)
        return [best(found, self.sets) if found else [] for found in out]

    def _possible(self, group: Group, pairs: set[tuple[int, int]], known: np.ndarray) -> set[tuple[int, int]]:
        """The pairs whose window has as many places with shingles of templates as a match needs; exact, as all others fail."""
        if not pairs:
            return pairs
        w, k = np.array(sorted(pairs)).T
        places = np.searchsorted(known, w * group.stride + group.width) - np.searchsorted(known, w * group.stride)
        held = places >= self.least[k]
        return set(zip(w[held].tolist(), k[held].tolist(), strict=True))

    def _verify(self, group: Group, pairs: set[tuple[int, int]], h: np.ndarray, bounds: np.ndarray, starts: np.ndarray, offsets: np.ndarray, whole: bytes, raw: list[bytes], out: list[list[dict]], at: int) -> None:
        found: dict[tuple[int, int], list[list]] = {}
        for w, k in sorted(pairs):
            a, b = w * group.stride, min(len(h), w * group.stride + group.width)
            for d in range(int(np.searchsorted(bounds, a, "right")) - 1, len(raw)):
                lo, hi = max(a, int(bounds[d])), min(b, int(bounds[d + 1]) - SHINGLE + 1)
                if bounds[d] >= b:
                    break
                if lo >= hi:
                    continue
                own = h[lo:hi]
                inside = np.isin(own, group.sets[k])
                share = len(np.unique(own[inside])) / len(group.sets[k])
                if share >= CONTAINMENT:
                    hits = np.flatnonzero(inside)
                    found.setdefault((d, k), []).append([lo + int(hits[0]), lo + int(hits[-1]) + SHINGLE, share])
        for (d, k), spans in found.items():
            merged: list[list] = []
            for a, b, share in sorted(spans):
                if merged and a < merged[-1][1]:
                    merged[-1][1], merged[-1][2] = max(merged[-1][1], b), max(merged[-1][2], share)
                else:
                    merged.append([a, b, share])
            for a, b, share in [x for a, b, share in merged for x in copies(h, group.sets[k], a, b, share)]:
                first, last = int(starts[a] - offsets[d]), int(starts[b - 1] - offsets[d])
                end = last
                while end < len(raw[d]) and whole[offsets[d] + end] != 32:
                    end += 1
                chars = lambda n, r=raw[d]: len(r[:n].decode("utf-8", "surrogatepass"))
                out[at + d].append({"license": self.names[k], "template": k, "start": chars(first), "end": chars(end), "containment": share, "held": np.intersect1d(h[a : b - SHINGLE + 1], group.sets[k])})


MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("containment", T.DoubleType())])


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends `matches`: an array of licence, template number, start, end and containment."""
    shared = df.sparkSession.sparkContext.broadcast(Templates(templates))
    return arrow_append(df, T.StructType([T.StructField("matches", T.ArrayType(MATCH))]), lambda c: {"matches": shared.value.scan(c[0].to_pylist())}, [text], keep)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, template, start, end, containment: a row for each match; other documents have none."""
    tune(spark)
    found = scan(load(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.where(F.size("matches") > 0).select("doc_id", F.inline("matches"))
