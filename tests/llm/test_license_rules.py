"""Licence recognition: names, expressions, and both steps against plain searches."""

import random
import re

import pytest

from mendline.llm import license_rules as L
from mendline.llm import registry

KNOWN = L.Recogniser()


def names(text):
    return KNOWN.licenses(KNOWN.read(text)[0])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Foo is licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("The tool and its data are licensed under the MIT License, as is all else.", ["MIT"]),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: BSD-3-Clause AND (LGPL-2.1-only OR MPL-2.0)", ["BSD-3-Clause", "LGPL-2.1-only", "MPL-2.0"]),
        ("SPDX-License-Identifier: gpl-3.0", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
        ("Licensed under the BSD 2-Clause License", ["BSD-2-Clause"]),
        ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
        ("We licensed under no terms at all.", []),
    ],
)
def test_names(text, expected):
    assert names(text) == expected


def test_long_copyright_lines_are_known():
    line = "Copyright (c) 2011-2024 The Example Project, its many contributors, and the other people named in the file AUTHORS beside this one"
    found, unknown = KNOWN.read(f"{line}\nAll rights reserved.")
    assert [n for n, _ in found] == ["copyright", "rights"] and unknown == []


def plain_read(text):
    """Every join of parts against every wording; the longest known one counts."""
    patterns = L._compiled()
    parts, found, unknown, i = [s for _, s in L.sentences(text)], [], [], 0
    while i < len(parts):
        hit = None
        for n in range(1, len(parts) - i + 1):
            joined = " ".join(parts[i : i + n])
            if len(joined) > 2000:
                break
            fits = [k for k, p in patterns if p.fullmatch(joined)]
            if fits and (n == 1 or not L.SENTENCES[fits[0]].endswith(("{x}", "{any}", "{id}"))):
                hit = n, fits[0]
        if hit:
            found.append(hit[1])
            i += hit[0]
            continue
        words, at, inner = parts[i].split(), 0, []
        while at < len(words) and "licen" in parts[i]:
            spans = [(len(L.SENTENCES[k]), z, k) for k, p in patterns if k in L._INSIDE for z in range(at + 1, len(words) + 1) if p.fullmatch(" ".join(words[at:z]))]
            if spans:
                top = max(s[0] for s in spans)
                _, at, name = max(s for s in spans if s[0] == top)
                inner.append(name)
            else:
                at += 1
        found += inner
        if not inner and any(h in parts[i] for h in L.HINTS):
            unknown.append(parts[i])
        i += 1
    return found, unknown


def plain_licenses(ids):
    taken, out = set(), []
    for title, rule in L.RULES:
        for i in range(len(ids)):
            span = set(range(i, i + len(rule)))
            if list(rule) == ids[i : i + len(rule)] and not span & taken:
                taken |= span
                out.append((i, title))
    return [t for _, t in sorted(out, key=lambda x: x[0])]


def filled(wording, r):
    for place, value in (("{v}", "2.0"), ("{vv}", "v2.0"), ("{n}", "3"), ("{x}", "some one"), ("{any}", "2020 some one and others"), ("{id}", "MIT OR ISC"), ("{cc}", "by-sa"), ("{url}", "http://www.apache.org/licenses/LICENSE-2.0")):
        wording = wording.replace(place, value)
    words = wording.split()
    if len(words) > 12 and r.random() < 0.5:
        for _ in range(3):
            words[r.randrange(len(words) - 1)] += "\n# "
    return " ".join(words)


def test_both_steps_against_plain_searches():
    r = random.Random(2)
    wordings = list(L.SENTENCES.values())
    for _ in range(150):
        parts = []
        for _ in range(r.randrange(1, 9)):
            kind = r.random()
            text = filled(r.choice(wordings), r)
            parts.append(text if kind < 0.6 else f"all of it is {text} and more" if kind < 0.75 else "an odd licence" if kind < 0.85 else "plain words")
        text = r.choice([". ", "\n", ";\n"]).join(parts)
        found, unknown = KNOWN.read(text)
        hinted = any(h in text.lower() for h in L.HINTS)  # other texts are not read
        assert ([n for n, _ in found], unknown) == (plain_read(text) if hinted else ([], [])), text
    ids = list(L.SENTENCES)
    for _ in range(400):
        run = [x for _ in range(r.randrange(6)) for x in (r.choice(L.RULES)[1] if r.random() < 0.6 else (r.choice(ids),))]
        titles = plain_licenses(run)
        got = KNOWN.licenses([(n, {"v": "2.0", "n": "3", "cc": "by", "id": "mit"}) for n in run])
        want = [t if t == "CC-other" else "MIT" if t == "{id}" else L.canonical(t.format(v="2.0", n="3", cc="BY")) for t in titles]
        assert got == want


def test_query_on_given_rows(spark):
    at = "/root/testdata/sf0.001"
    text = {x.doc_id: x.text for x in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.QUERIES["op4_license_rules"](spark, at).collect()
    assert len(got) == len(text) and any(x.licenses for x in got)
    for x in got:
        hinted = any(h in (text[x.doc_id] or "").lower() for h in L.HINTS)
        assert (x.sentence_ids, x.unknown) == (plain_read(text[x.doc_id]) if hinted else ([], []))
        assert len(x.licenses) >= len(plain_licenses(x.sentence_ids)) and not any(re.search(r"[{}]", n) for n in x.licenses)
