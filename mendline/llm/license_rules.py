"""Licence recognition by sentences and ordered rules.

A text is cut into sentences; each is normalised (lower case, marks and runs of blanks to one blank, comment marks off) and, if it is a known
licence sentence, becomes its identifier. A known sentence is a pattern with places for versions or names. The sequence of identifiers
is then matched against rules in order: a rule is a sequence of identifiers that must follow one another, and a match uses its sentences
up, so a long notice is never counted again as the short one it contains. Short wordings count inside a longer sentence too. A licence has
one name, that of the SPDX list, whether a notice or an identifier gives it; an expression of identifiers gives each of them. Sentences
that speak of licences and match nothing are reported as unknown. Whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from mendline.llm.common import small_batches, text_and_id

# Wordings of public licence notices, normalised; {v} stands for a version, {vv} for one behind the letter v, {n} for a
# number, {x} for up to twelve words, {any} for any words, {id} for an expression of identifiers, {cc} for the parts of a Creative Commons licence, {url} for the address of the text.
SENTENCES = {
    "spdx": "spdx license identifier {id}",
    "apache-short": "licensed under the apache license version {v}",
    "apache-header-1": "licensed under the apache license version {v} the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at {url}",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-short-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl-short": "this work is licensed under the gnu general public license version {v}",
    "gpl-short-2": "licensed under the gnu general public license version {v}",
    "lgpl-short": "licensed under the gnu lesser general public license version {v}",
    "agpl-short": "licensed under the gnu affero general public license version {v}",
    "mpl-short": "licensed under the mozilla public license version {v}",
    "epl-short": "licensed under the eclipse public license version {v}",
    "bsd-short": "licensed under the bsd {n} clause license",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "gpl-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version {v} as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v {v}",
    "epl-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license {vv} which accompanies this distribution",
    "boost-notice": "distributed under the boost software license version {v}",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "cc-short": "licensed under cc {cc} {v}",
    "cc-short-2": "this work is licensed under a creative commons {x} license",
    "cc-zero": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "copyright": "copyright {any}",
    "rights": "all rights reserved",
}

# Rules in the order in which they are tried; {v}, {cc} and {id} are filled from the first sentence that has them.
RULES = (
    ("Apache-{v}", ("apache-header-1", "apache-use", "apache-copy", "apache-asis", "apache-see")),
    ("GPL-{v}-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-{v}-only", ("gpl-only", "gpl-hope", "gpl-details")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-{v}-or-later", ("gpl-free",)),
    ("GPL-{v}-only", ("gpl-only",)),
    ("LGPL-{v}-or-later", ("lgpl-free",)),
    ("AGPL-{v}-or-later", ("agpl-free",)),
    ("MIT", ("mit-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("EPL-{v}", ("epl-notice",)),
    ("BSL-{v}", ("boost-notice",)),
    ("ISC", ("isc-grant",)),
    ("MPL-{v}", ("mpl-notice",)),
    ("Apache-{v}", ("apache-header-1",)),
    ("Apache-{v}", ("apache-short",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-2",)),
    ("GPL-{v}", ("gpl-short",)),
    ("GPL-{v}", ("gpl-short-2",)),
    ("LGPL-{v}", ("lgpl-short",)),
    ("AGPL-{v}", ("agpl-short",)),
    ("MPL-{v}", ("mpl-short",)),
    ("EPL-{v}", ("epl-short",)),
    ("BSD-{n}-Clause", ("bsd-short",)),
    ("CC-{cc}-{v}", ("cc-short",)),
    ("CC-other", ("cc-short-2",)),
    ("CC0-1.0", ("cc-zero",)),
    ("Unlicense", ("unlicense",)),
    ("{id}", ("spdx",)),
)

#: Names of rules that are no identifiers of the list.
_AS_GIVEN = ("CC-other",)
#: A sentence that holds one of these and is no known one is reported.
HINTS = ("licen", "copyright", "redistribut", "warrant", "permission is", "permission to", "spdx", "rights reserved", "unencumbered")
_END = re.compile(r"(?:[.;!?](?=\s|$)|(?<!dentifier):(?=\s|$)|\n)+")
_MARKS = re.compile(r"[^\w.]+|(?<!\d)\.|\.(?!\d)|_")
_PLACES = {
    "{v}": r"(?P<v>\d+(?:\.\d+)*)",
    "{vv}": r"v ?(?P<v>\d+(?:\.\d+)*)",
    "{n}": r"(?P<n>\d)",
    "{x}": r"\S+(?: \S+){0,11}",
    "{any}": r"\S+(?: \S+)*",
    "{cc}": r"(?P<cc>by(?: (?:nc|nd|sa))*|zero)",
    "{url}": r"https? www apache org licenses(?: license \d+(?:\.\d+)*)?",
    "{id}": r"(?P<id>[\w.]+(?: [\w.]+)*)",
}
#: Wordings that end in one of these end with their line.
_OPEN = ("{x}", "{any}", "{id}")
#: Wordings that count inside a longer sentence, before which no place may be open.
_INSIDE = tuple(n for n, w in SENTENCES.items() if n.endswith(("-short", "-short-2")) or n == "boost-notice")
# How the SPDX list writes the words of its identifiers, and the names that another writing stands for.
_SPELT = {
    "apache": "Apache", "unlicense": "Unlicense", "zlib": "Zlib", "clause": "Clause", "only": "only", "or": "or", "later": "later",
    "python": "Python", "artistic": "Artistic", "ruby": "Ruby", "ncsa": "NCSA", "beerware": "Beerware",
}
_SAME = {"BOOST-1.0": "BSL-1.0", "CC0": "CC0-1.0", "CC-ZERO-1.0": "CC0-1.0", "BSL": "BSL-1.0", "APACHE": "Apache"}
#: Families whose versions have a point.
_POINTED = re.compile(r"(Apache|A?GPL|LGPL|MPL|EPL|BSL|CC0|CC-BY(?:-(?:NC|ND|SA))*)-(\d+)(?![.\d])")
_LONGEST_PATTERN = 2000


def canonical(name: str) -> str:
    """The name of a licence as the SPDX list writes it: ``gpl 3 or later`` and ``GPL-3-or-later`` are ``GPL-3.0-or-later``."""
    parts = [_SPELT.get(p, p.upper()) for p in re.split(r"[ -]+", name.strip().lower()) if p]
    joined = "-".join(parts)
    joined = _POINTED.sub(r"\1-\2.0", joined)
    return _SAME.get(joined, joined)


def expression(identifiers: str) -> list[str]:
    """The licences that an expression of identifiers, normalised, names; exceptions behind ``with`` are left out."""
    found = []
    for part in re.split(r" (?:and|or(?! later\b)) ", f" {identifiers} "):
        name = part.split(" with ")[0].strip()
        if name and canonical(name) not in found:
            found.append(canonical(name))
    return found


def normalise(sentence: str) -> str:
    """Lower case, every run of marks and blanks one blank; a point stays between digits."""
    return _MARKS.sub(" ", sentence.lower()).strip()


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """(start, sentence): parts between line ends or end marks that a blank follows, normalised; empty ones are left out."""
    start = 0
    for m in _END.finditer(text):
        if m.start() > start and (s := normalise(text[start : m.start()])):
            yield start, s
        start = m.end()
    if s := normalise(text[start:]):
        yield start, s


def _compiled() -> list[tuple[str, re.Pattern]]:
    out = []
    for name, wording in SENTENCES.items():
        pattern = re.escape(wording).replace(r"\ ", " ")
        for place, meaning in _PLACES.items():
            pattern = pattern.replace(re.escape(place), meaning)
        out.append((name, re.compile(pattern)))
    return out


class Recogniser:
    """Known sentences by their first two words, and the rules."""

    def __init__(self):
        self.by_start: dict[str, list[tuple[str, re.Pattern]]] = {}
        self.heads: dict[str, list[str]] = {}  # what wordings that may run over line ends begin with, up to their first place
        for name, pattern in _compiled():
            start = SENTENCES[name].split(" ")[0]
            self.by_start.setdefault(start, []).append((name, pattern))
            if not SENTENCES[name].endswith(_OPEN):
                self.heads.setdefault(start, []).append(SENTENCES[name].split("{")[0])

        inside = {n: re.sub(r"\(\?P<\w+>", "(", p.pattern) for n, p in _compiled() if n in _INSIDE}
        # The longer wording first where one begins like another.
        order = sorted(inside, key=lambda n: -len(SENTENCES[n]))
        self.inside = re.compile(r"(?<!\S)(?:" + "|".join(f"(?P<n{_INSIDE.index(n)}>{inside[n]})" for n in order) + r")(?!\S)")

    def within(self, sentence: str) -> list[tuple[str, dict[str, str]]]:
        """The short wordings inside a sentence, in order."""
        if "licen" not in sentence:
            return []
        runs = [m.group() for m in self.inside.finditer(sentence)]
        return [k for k in (self.known(r) for r in runs) if k]

    def known(self, sentence: str) -> tuple[str, dict[str, str]] | None:
        if len(sentence) <= _LONGEST_PATTERN:  # no wording is longer
            for name, pattern in self.by_start.get(sentence.split(" ", 1)[0], ()):
                if m := pattern.fullmatch(sentence):
                    return name, {k: v for k, v in m.groupdict().items() if v}
        return None

    def read(self, text: str) -> tuple[list[tuple[str, dict]], list[str]]:
        """(identifiers of the known sentences in order, unknown sentences about licences). A wording may run over line ends."""
        lowered = text.lower()
        if not any(h in lowered for h in HINTS):
            return [], []
        found: list[tuple[str, dict]] = []
        unknown: list[str] = []
        parts = [s for _, s in sentences(text)]
        i = 0
        while i < len(parts):
            hit = None
            joined = ""
            for n in range(1, len(parts) - i + 1):  # a notice is often broken over lines; the longest join that is known counts
                joined = parts[i] if n == 1 else f"{joined} {parts[i + n - 1]}"
                start = joined.split(" ", 1)[0]
                if start not in self.by_start or len(joined) > _LONGEST_PATTERN:
                    break
                if n > 1 and not any(h.startswith(joined) or joined.startswith(h) for h in self.heads.get(start, ())):
                    break  # no wording goes on like this
                k = self.known(joined)
                if k and (n == 1 or not SENTENCES[k[0]].endswith(_OPEN)):
                    hit = (n, k)
            if hit:
                found.append(hit[1])
                i += hit[0]
            else:
                if inner := self.within(parts[i]):
                    found += inner
                elif any(h in parts[i] for h in HINTS):
                    unknown.append(parts[i])
                i += 1
        return found, unknown

    def licenses(self, found: list[tuple[str, dict]]) -> list[str]:
        """Names of the rules that match, in the order of the text."""
        names, used = [n for n, _ in found], [False] * len(found)
        out: list[tuple[int, str]] = []
        for title, rule in RULES:
            n = len(rule)
            for i in range(len(found) - n + 1):
                if not any(used[i : i + n]) and tuple(names[i : i + n]) == rule:
                    used[i : i + n] = [True] * n
                    values = {k: v for _, d in reversed(found[i : i + n]) for k, v in d.items()}
                    if title == "{id}":
                        out += [(i, name) for name in expression(" ".join(d["id"] for _, d in found[i : i + n]))]
                        continue
                    name = title.format(**{"v": "", "cc": "", "n": "", **values})
                    out.append((i, name if name in _AS_GIVEN else canonical(name)))
        return [name for _, name in sorted(out, key=lambda x: x[0])]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, sentence_ids, unknown), one row per row of ``docs``, all arrays in the order of the text.

    Null and empty texts have three empty arrays; repeated notices are listed each time.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Recogniser()
        words = pa.list_(pa.string())
        for b in batches:
            rows = []
            for t in b.column(1):
                found, unknown = known.read(t.as_py())
                rows.append((known.licenses(found), [n for n, _ in found], unknown))
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, words) for c in columns)], names=["doc_id", "licenses", "sentence_ids", "unknown"]
            )

    return text_and_id(docs).mapInArrow(run, "doc_id long, licenses array<string>, sentence_ids array<string>, unknown array<string>")
