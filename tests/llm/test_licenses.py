"""What the license scan must name and must not name, and containment counted without its code."""

import random
import re

import pytest

from cohortry.llm import license_scan as L

WHOLE = dict(L.TEMPLATES[-len(L.WHOLE) :])
HEADER = "This {w} is free software; you can redistribute it and/or modify it under the terms of the GNU {l}General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."

NAMED = [
    (HEADER.format(w="program", l="", v="1"), ["GPL-1.0-or-later"]),
    (HEADER.format(w="program", l="", v="2"), ["GPL-2.0-or-later"]),
    (HEADER.format(w="program", l="", v="3"), ["GPL-3.0-or-later"]),
    (HEADER.format(w="library", l="Lesser ", v="2.1"), ["LGPL-2.1-or-later"]),
    (HEADER.format(w="library", l="Lesser ", v="3"), ["LGPL-3.0-or-later"]),
    (HEADER.format(w="library", l="Library ", v="2"), ["LGPL-2.0-or-later"]),
    (HEADER.format(w="program", l="Affero ", v="3"), ["AGPL-3.0-or-later"]),
    (HEADER.format(w="program", l="", v="4"), []),
    ("This work is licensed under the GNU General Public License, version 1", ["GPL-1.0"]),
    ("This work is licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3", ["GPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 4", []),
    ("GNU General Public License version 2 or later", ["GPL-2.0-or-later"]),
    ("GNU Affero General Public License v3.0", ["AGPL-3.0"]),
    ("the GPLv2, that is", ["GPL-2.0"]),
    ("Mozilla Public License, v. 2.0", ["MPL-2.0"]),
    ("MIT License", ["MIT"]),
    ("CC BY 4.0", ["CC-BY-4.0"]),
    ("CC BY-NC 4.0", ["CC-BY-NC-4.0"]),
    ("CC Attribution-NonCommercial 4.0 International", ["CC-BY-NC-4.0"]),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", ["CC-BY-NC-SA-4.0"]),
    ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 1.1", []),
    ("the general public license of a driver", []),
    (dict(L.PASSAGES)["BSD-2-Clause"], ["BSD-2-Clause"]),
    (dict(L.PASSAGES)["BSD-3-Clause"], ["BSD-3-Clause"]),
    (dict(L.PASSAGES)["MIT"], ["MIT"]),
    (dict(L.PASSAGES)["ISC"], ["ISC"]),
    (dict(L.PASSAGES)["EPL-2.0"], ["EPL-2.0"]),
    (dict(L.PASSAGES)["AGPL-3.0"], ["AGPL-3.0"]),
    (WHOLE["Apache-2.0"] + " " + dict(L.PASSAGES)["MIT"], ["Apache-2.0", "MIT"]),
    *((text, [name]) for name, text in WHOLE.items()),
]


@pytest.fixture(scope="module")
def scanner():
    return L.Scanner(L.TEMPLATES)


@pytest.mark.parametrize("case", range(len(NAMED)))
def test_names(scanner, case):
    text, names = NAMED[case]
    assert sorted({m[0] for m in scanner.scan([L.words_of("see below, a b c " + text + " and so on to the end")])[0]}) == names


def test_another_name_in_the_title_is_another_license(scanner):
    affero = re.sub(r"(?i)GNU GENERAL", "GNU AFFERO GENERAL", WHOLE["GPL-3.0"])
    assert "GPL-3.0" not in {m[0] for m in scanner.scan([L.words_of(affero)])[0]}


def test_containment_counted_plainly(scanner):
    """Damaged headers: matched when 0.8 of their five-word shingles and the words for name and version are left."""
    rng = random.Random(5)
    name, header = next((n, t) for n, t in L.TEMPLATES if n == "GPL-2.0-or-later" and "redistribute" in t)
    words = re.findall(r"[^\W_]+", header.lower())
    whole = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    seen = set()
    for _ in range(300):
        damaged = [w if rng.random() > 0.03 else "zzz" for w in words]
        left = len(whole & {tuple(damaged[i : i + 5]) for i in range(len(damaged) - 4)}) / len(whole)
        told = all(p in " ".join(damaged) for p in ("gnu general public license", "version 2 of the license", "any later version"))
        got = [m for m in scanner.scan([damaged])[0] if m[0] == name]
        want = left >= 0.8 and told
        assert bool(got) == want, (left, told, damaged)
        seen.add(want)
    assert seen == {True, False}


def test_identifiers(spark):
    texts = ["// SPDX-License-Identifier: MIT\nint x;", "# spdx-license-identifier: (GPL-2.0-only OR Apache-2.0)", "/* SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 */", "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier:", "spdx", None, "", "a SPDX-License-Identifier: LGPL-2.1-or-later and the MIT License"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(m.license, m.start, m.stop) for m in r.matches] for r in L.license_matches(rows).collect()}
    assert got[0] == [("MIT", 0, 4)]
    assert sorted(m[0] for m in got[1]) == ["Apache-2.0", "GPL-2.0"]
    assert [m[0] for m in got[2]] == ["GPL-2.0-or-later"]
    assert [m[0] for m in got[3]] == ["MIT-0"]
    assert got[4] == got[5] == got[6] == got[7] == []
    assert [m[0] for m in got[8]] == ["LGPL-2.1-or-later", "MIT"] and got[8][0][1] == 1


def test_null_and_repeated_ids_and_long_texts(spark):
    rows = spark.createDataFrame([(None, "MIT License"), (1, "MIT License"), (1, "MIT License"), (2, "word " * 300_000 + "MIT License")], "doc_id long, text string")
    got = [(r.doc_id, [m.license for m in r.matches]) for r in L.license_matches(rows).collect()]
    assert sorted(got, key=str) == sorted([(None, ["MIT"]), (1, ["MIT"]), (1, ["MIT"]), (2, ["MIT"])], key=str)
