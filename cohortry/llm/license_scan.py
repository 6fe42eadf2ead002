"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import math
import re
from importlib.resources import files

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import arrow_map, table

WORD = re.compile(r"[^\W_]+")

#: Notices by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
)

#: Short wordings of notices. At most eight words each, so that all their shingles, and with them the version, must be there.
WORDINGS = (
    ("MIT", "under the MIT License", "terms of the MIT License"),
    ("ISC", "under the ISC License", "terms of the ISC License"),
    ("BSD-2-Clause", "under the BSD 2-Clause License", "under the 2-Clause BSD License"),
    ("BSD-3-Clause", "under the BSD 3-Clause License", "under the 3-Clause BSD License"),
    ("Apache-2.0", "Apache License, Version 2.0", "under the Apache License 2.0", "terms of the Apache License 2.0"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v 2.0"),
    ("LGPL-2.1", "Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "Lesser General Public License, version 3"),
    ("AGPL-3.0", "Affero General Public License, version 3"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("CC0-1.0", "under CC0 1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "under CC BY 4.0"),
    ("CC-BY-SA-4.0", "under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "under CC BY-NC 4.0"),
    ("Unlicense", "released into the public domain under the Unlicense", "under the Unlicense license"),
    ("Unlicense", "This is free and unencumbered software released"),
)

#: Titles of the GNU licenses with their versions; wordings and headers follow from them.
GNU = (
    ("GPL", "GNU General Public License", ("1", "2", "3")),
    ("LGPL", "GNU Library General Public License", ("2",)),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
    ("AGPL", "GNU Affero General Public License", ("3",)),
)

#: The header that the GNU licenses ask for.
GNU_HEADER = "This {work} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version"

#: The elements of Creative Commons licenses.
COMMONS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))

#: License texts and opening passages.
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
PASSAGES = (
    ("BSD-2-Clause", _CONDITIONS + _DISCLAIMER),
    ("BSD-3-Clause", _CONDITIONS + _NAMES + _DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
)

#: Whole texts, in the folder licenses.
WHOLE = ("Apache-2.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")

#: Phrases, as words, of which a match of a license's longer templates must hold at least one of each tuple, so that no other version or name passes.
REQUIRED: dict[str, list[tuple[str, ...]]] = {
    "Apache-2.0": [("apache license version 2 0",)],
    "BSD-3-Clause": [("endorse or promote products derived from this software",)],
    "CC0-1.0": [("cc0 1 0 universal",)],
    "EPL-2.0": [("eclipse public license v 2 0", "eclipse public license version 2 0")],
    "ISC": [("this permission notice appear in all copies",)],
    "MPL-1.1": [("mozilla public license version 1 1",)],
    "MPL-2.0": [("mozilla public license version 2 0", "mozilla public license v 2 0")],
}


def _gnu_templates() -> list[tuple[str, str]]:
    """Short wordings and headers of the GNU licenses; fills in what their matches require."""
    out = []
    for family, title, versions in GNU:
        for version in versions:
            name = f"{family}-{version}" + ("" if "." in version else ".0")
            spelled = {version, name.split("-")[1]}
            long = sorted([f"{title}{sep}{v}" for v in spelled for sep in (" version ", " v")] + [f"version {version} of the {title}"])
            short = sorted([f"{family}{sep}{v}" for v in spelled for sep in ("v", " v")] + [f"{family} version {version}"])
            out += [(name, form) for form in long + short]
            out += [(f"{name}-or-later", form + end) for form in long for end in (" or later", " or any later version", " or (at your option) any later version")]
            out += [(f"{name}-or-later", form + " or later") for form in short]
            out += [(f"{name}-or-later", GNU_HEADER.format(work=work, title=title, version=version)) for work in ("program", "library")]
            own = " ".join(WORD.findall(title.lower()))
            number = " ".join(WORD.findall(version))
            REQUIRED[name] = [tuple(f"{own} {v}{number}" for v in ("version ", "v", "v ")) + (f"version {number} of the {own}",)]
            REQUIRED[f"{name}-or-later"] = [(own,), (f"version {number} of the license",), ("any later version",)]
    return out


def _commons_templates() -> list[tuple[str, str]]:
    return [(f"CC-{short}-4.0", form) for short, full in COMMONS for form in (f"CC {short} 4.0", f"Creative Commons {full} 4.0", f"CC {full} 4.0")]


TEMPLATES += tuple((name, wording) for name, *wordings in WORDINGS for wording in wordings)
TEMPLATES += tuple(dict.fromkeys(t for t in [("MIT", "MIT License"), *_gnu_templates(), *_commons_templates(), *PASSAGES] if t not in TEMPLATES))
TEMPLATES += tuple((name, files("cohortry.llm").joinpath("licenses", f"{name}.txt").read_text("utf-8")) for name in WHOLE)

#: Identifiers that name a license of TEMPLATES otherwise; "-only" is cut off, "+" is "-or-later".
IDENTIFIER = re.compile(r"(?<![^\W_])(?i:SPDX-License-Identifier):[ \t]*([^\s*#;,]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[^\s*#;,]+)*)")
KNOWN = {name.lower(): name for name, _ in TEMPLATES}

#: Templates of at most this many words must be there in full.
SHORT = 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class _Hashes(dict):
    """64-bit hashes of words; the most frequent ones are kept."""

    def __missing__(self, word):
        n = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        if len(word) <= 32:
            if len(self) >= 500_000:
                self.clear()
            self[word] = n
        return n


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(width if n > 0 else 0):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def bands_for(similarity: float, miss: float) -> int:
    """One-row bands so that a window of that Jaccard similarity meets its template in one of them but for probability miss."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


class _Class:
    """Templates of one shingle width and about one length: their window grid and their MinHash bands.

    A window is three blocks of shingle places, one block further on each time. Any run of at most 2 * block + 1
    places lies within a window, so every occurrence of a template does.
    """

    def __init__(self, members: list[tuple[int, list[str]]], width: int, least: float, miss: float):
        self.width = width
        self.shingles = {k: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for k, w in members}
        longest = max(len(w) - width + 1 for _, w in members)
        shortest = min(len(s) for s in self.shingles.values())
        self.block = max(1, -(-longest // 2))
        need = max(1, math.ceil(least * shortest - 1e-9))
        self.bands = bands_for(need / (3 * self.block + shortest - need), miss) if need < 3 * self.block + shortest - need else 1
        rng = np.random.default_rng(longest * 16 + width)
        self.a = rng.integers(1, 1 << 63, self.bands, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.bands, np.uint64)
        self.lookup: dict[tuple[int, int], list[int]] = {}
        hashes, keys = _Hashes(), set()
        for k, w in members:
            own = shingle_hashes(np.array([hashes[x] for x in w], np.uint64), width)
            for band in range(self.bands):
                mixed = self._mixed(own, band)
                self.lookup.setdefault((band, int(mixed.min())), []).append(k)
                keys.add(int(own[mixed.argmin()]))
        #: Shingles that are a template's least in some band. Mixing is one to one, so a window without any meets no template.
        self.keys = np.array(sorted(keys), np.uint64)
        self.tops = np.zeros(1 << 16, bool)
        self.tops[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.values = [np.array(sorted(v for b, v in self.lookup if b == band), np.uint64) for band in range(self.bands)]

    def _mixed(self, hashes: np.ndarray, band: int) -> np.ndarray:
        x = hashes * self.a[band] + self.b[band]
        return x ^ (x >> np.uint64(31))

    def candidates(self, shingles: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, window, template) that share a band. shingles: those of all texts; sizes: how many each text has.

        Bands are computed for the windows that hold one of keys; no other window can share one.
        """
        found: set[tuple[int, int, int]] = set()
        near = np.flatnonzero(self.tops[(shingles >> np.uint64(48)).astype(np.int64)])
        near = near[np.isin(shingles[near], self.keys)]
        if not len(near):
            return found
        blocks, ends = -(-sizes // self.block), np.cumsum(sizes)
        begin, first, behind = ends - sizes, np.cumsum(blocks) - blocks, np.cumsum(blocks)
        text = np.searchsorted(ends, near, side="right")
        nth = (near - begin[text]) // self.block
        windows = [(first[text] + h)[(h >= 0) & (h <= np.maximum(blocks[text] - 3, 0))] for h in (nth, nth - 1, nth - 2)]
        windows = np.unique(np.concatenate(windows))
        text = np.searchsorted(behind, windows, side="right")
        last = behind[text] - 1
        used, place = np.unique(np.stack([windows, np.minimum(windows + 1, last), np.minimum(windows + 2, last)]), return_inverse=True)
        place = place.reshape(3, -1)
        owner = np.searchsorted(behind, used, side="right")
        offset = (used - first[owner]) * self.block
        held = np.minimum(self.block, sizes[owner] - offset)
        starts = np.cumsum(held) - held
        held_shingles = shingles[np.arange(held.sum()) + np.repeat(begin[owner] + offset - starts, held)]
        nth = windows - first[text]
        for band in range(self.bands):
            low = np.minimum.reduceat(self._mixed(held_shingles, band), starts)[place].min(axis=0)
            for value in self.values[band]:
                for at in np.flatnonzero(low == value):
                    found.update((int(text[at]), int(nth[at]), k) for k in self.lookup[band, int(value)])
        return found

    def verified(self, words: list[str], window: int, template: int) -> tuple[float, int, int]:
        """Containment of the template's shingles in a window, and the words from its first to its last shingle there."""
        lo = window * self.block
        hi = min(lo + 3 * self.block, len(words) - self.width + 1)
        want, places = self.shingles[template], {}
        for i in range(lo, hi):
            if (s := tuple(words[i : i + self.width])) in want:
                places.setdefault(s, []).append(i)
        if not places:
            return 0.0, lo, lo
        every = [i for x in places.values() for i in x]
        return len(places) / len(want), min(every), max(every) + self.width


def _outermost(matches: list[tuple[str, int, int, float, set[str]]]) -> list[tuple[str, int, int, float]]:
    """Matches without those that lie in a longer one whose template has their license's words in it."""
    kept: list[tuple[str, int, int, float, set[str]]] = []
    for m in sorted(matches, key=lambda m: (m[1] - m[2], -m[3], m[0])):
        if not any(k[1] <= m[1] and m[2] <= k[2] and m[0] in k[4] and m[0] != k[0] for k in kept):
            kept.append(m)
    return [m[:4] for m in kept]


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """(license, first word, word behind the last) of all SPDX identifiers of a text, each of an expression by itself.

    Names are those of TEMPLATES where they have the license, else as written; exceptions behind WITH are left out.
    """
    out = []
    for found in IDENTIFIER.finditer(text):
        first, last = (len(words_of(text[:at])) for at in (found.start(), found.end()))
        for term in re.split(r"\s+(?:AND|OR)\s+", found[1]):
            for written in term.translate({40: 32, 41: 32}).rstrip(". ").split()[:1]:
                name = re.sub(r"\+$", "-or-later", written.lower()).removesuffix("-only")
                out.append((KNOWN.get(name, written), first, last))
    return list(dict.fromkeys(out))


class Scanner:
    def __init__(self, templates, width: int = 5, least: float = 0.8, miss: float = 1e-6):
        self.least, self.names, self.hashes = least, [name for name, _ in templates], _Hashes()
        self.required = [[] if len(words_of(text)) <= SHORT else REQUIRED.get(name, []) for name, text in templates]
        self.needed = [1.0 if len(words_of(text)) <= SHORT else least for _, text in templates]
        #: The words that a template can reach beyond a match: those of the shingles that may be missing.
        self.margins = [int((1 - least) * len(words_of(text))) for _, text in templates]
        groups: dict[tuple[int, int], list] = {}
        for k, (_, text) in enumerate(templates):
            if words := words_of(text):
                own = min(width, len(words))
                groups.setdefault((own, (len(words) - own + 1).bit_length()), []).append((k, words))
        self.classes = [_Class(members, own, least, miss) for (own, _), members in sorted(groups.items())]
        #: What each template's own text matches; it is part of the template and no license of its own there.
        self.mentions: list[set[str]] = [set() for _ in templates]
        self.mentions = [{m[0] for m in found} for found in self.scan([words_of(text) for _, text in templates])]

    def passes(self, words: list[str], k: int, start: int, stop: int, share: float) -> bool:
        """Enough shingles, and with them the words that tell the template's license from others."""
        if share < self.needed[k] or not self.required[k]:
            return share >= self.needed[k]
        held = f" {' '.join(words[max(0, start - self.margins[k]) : stop + self.margins[k]])} "
        return all(any(f" {phrase} " in held for phrase in phrases) for phrases in self.required[k])

    def scan(self, texts: list[list[str]], every_window: bool = False) -> list[list[tuple[str, int, int, float]]]:
        """For each text, given as words: (name, first word, word behind the last, containment). every_window: without bands, for tests."""
        sizes = np.array([len(w) for w in texts], np.int64)
        flat = np.fromiter((h for words in texts for h in map(self.hashes.__getitem__, words)), np.uint64, int(sizes.sum()))
        within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        best: dict[tuple[int, str], list[tuple[int, int, float, set[str]]]] = {}
        for width in sorted({c.width for c in self.classes}):
            own = np.maximum(sizes - width + 1, 0)
            shingles = shingle_hashes(flat, width)
            shingles = shingles[(within < np.repeat(own, sizes))[: len(shingles)]]
            for c in self.classes:
                if c.width != width:
                    continue
                if every_window:
                    places = {(t, w, k) for t, n in enumerate(own) if n for w in range(max(1, -(-int(n) // c.block) - 2)) for k in c.shingles}
                else:
                    places = c.candidates(shingles, own)
                for t, window, k in places:
                    share, start, stop = c.verified(texts[t], window, k)
                    if self.passes(texts[t], k, start, stop, share):
                        best.setdefault((t, self.names[k]), []).append((start, stop, share, self.mentions[k]))
        out: list[list[tuple[str, int, int, float, set[str]]]] = [[] for _ in texts]
        for (t, name), found in best.items():
            merged: list[tuple[int, int, float, set[str]]] = []
            for start, stop, share, mentions in sorted(found, key=lambda m: m[:3]):
                if merged and start < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(stop, merged[-1][1]), max(share, merged[-1][2]), merged[-1][3] | mentions)
                else:
                    merged.append((start, stop, share, mentions))
            out[t] += [(name, *m) for m in merged]
        return [sorted(map(tuple, _outermost(x)), key=lambda m: (m[1], m[2], m[0])) for x in out]


def license_matches(docs: DataFrame, templates=TEMPLATES, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, miss: float = 1e-6, block_words: int = 1 << 18) -> DataFrame:
    """One row per row of docs: key, n_words, matches (license, start, stop in words, containment).

    A match holds `least` of a template's width-word shingles (templates of at most 20 words: all; shorter ones than width:
    one shingle) within one window, and the phrases of REQUIRED, which name license and version. A match that lies in one
    of a longer template whose own text holds it is part of that. SPDX identifiers are read as they are written.
    Bands are as many as leave probability `miss` that a matching window isn't retrieved. Overlapping matches of one
    license are one. templates are a parameter list, broadcast. Null and empty texts have no words and no matches.
    Repeated rows match alike; no rows in, no rows out; other columns are left out. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(templates))

    def make():
        scanner = Scanner(shared.value, width, least, miss)

        def run(batches):
            idents, texts, tagged, held = [], [], {}, 0

            def block():
                scanned = scanner.scan(texts)
                for at, named in tagged.items():
                    apart = [m for m in scanned[at] if not any(a <= m[1] and m[2] <= b for _, a, b in named)]
                    scanned[at] = sorted([*apart, *((*n, 1.0) for n in named)], key=lambda m: (m[1], m[2], m[0]))
                found = [[dict(zip(("license", "start", "stop", "containment"), m, strict=True)) for m in x] for x in scanned]
                return list(idents), [len(w) for w in texts], found

            for batch in batches:
                for ident, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    idents.append(ident)
                    texts.append(words_of(body.as_py()))
                    if "spdx" in texts[-1] and (named := identifiers(body.as_py())):
                        tagged[len(texts) - 1] = named
                    held += len(texts[-1])
                    if held >= block_words:
                        yield block()
                        idents, texts, tagged, held = [], [], {}, 0
            if idents:
                yield block()

        return run

    schema = f"`{key}` long, n_words long, matches array<struct<license:string,start:long,stop:long,containment:double>>"
    return arrow_map(docs.select(F.col(key).cast("long"), F.col(text)), make, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["stop"])), ",").alias("spans"))
