"""License scans: templates with optional and replaceable regions, compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.llm.common import prepare, read_table

#: Phrases that count wherever their words stand together, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The wording of notices and licenses. <<opt>> ... <</opt>> may be missing;
#: <<var N>> stands for up to N words of any kind; the rest must be there, word for word.
_AS_IS = (
    "this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
    "even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution"
)
_UNDER = "<<opt>>released<</opt>> <<opt>>distributed<</opt>> <<opt>>licensed<</opt>> <<opt>>available<</opt>> under <<opt>>the<</opt>> <<opt>>terms of the<</opt>>"
_LINK = "<<opt>>http<</opt>> <<opt>>https<</opt>> <<opt>>www<</opt>>"
TEMPLATES = {
    "mit": (
        "<<opt>>released<</opt>> <<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> mit license",
        "the mit license <<opt>>mit<</opt>> <<opt>>copyright<</opt>>",
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>>the software<</opt>> to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall <<var 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    "bsd-2-clause-text": (f"{_BSD} {_AS_IS}",),
    "bsd-3-clause-text": (
        f"{_BSD} <<opt>>3<</opt>> neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}",
    ),
    "isc-text": (
        "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<var 8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var 8>> be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use "
        "or performance of this software",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0 <<opt>>the license<</opt>>",
        f"apache license version 2 0 january 2004 {_LINK} apache org licenses terms and conditions for use reproduction and distribution",
        f"{_UNDER} apache license 2 0",
    ),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 <<opt>>the license<</opt>> you may not use this <<var 3>> except in compliance with the license you may obtain a copy of the license at "
        f"{_LINK} apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        f"{_UNDER} mozilla public license <<opt>>version<</opt>> <<opt>>v<</opt>> 2 0",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        f"{_UNDER} unlicense",
    ),
    "cc0-1.0": (
        "to the extent possible under law <<var 20>> has waived all copyright and related or neighboring rights to",
        f"{_UNDER} cc0 1 0 <<opt>>universal<</opt>>",
        "cc0 1 0 universal",
    ),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will <<var 8>> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software "
        "for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<opt>>1<</opt>> the origin of this software must not be misrepresented you must not claim "
        "that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<opt>>2<</opt>> altered source versions must be plainly marked "
        "as such and must not be misrepresented as being the original software <<opt>>3<</opt>> this notice may not be removed or altered from any source distribution",
    ),
    "bsl-1.0": (f"{_UNDER} boost software license version 1 0",),
    "bsl-1.0-text": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license <<opt>>the software<</opt>> to use reproduce display distribute "
        "execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software "
        "and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software",
    ),
    "epl-2.0": (f"{_UNDER} eclipse public license <<opt>>version<</opt>> <<opt>>v<</opt>> 2 0", f"{_UNDER} eclipse public license v2 0"),
    "eupl-1.2": (f"{_UNDER} eupl <<opt>>version<</opt>> <<opt>>v<</opt>> 1 2", f"{_UNDER} european union public licence <<opt>>version<</opt>> <<opt>>v<</opt>> 1 2"),
    "copyright-notice": ("copyright <<opt>>c<</opt>> <<var 12>> all rights reserved",),
}
#: The GNU licenses, each by name and version: a notice in short, and the notice of a program.
for _label, _name, _version in (
    ("gpl-2.0", "general public license", "2"), ("gpl-3.0", "general public license", "3"), ("lgpl-2.1", "lesser general public license", "2 1"), ("lgpl-3.0", "lesser general public license", "3"),
    ("agpl-3.0", "affero general public license", "3"),
):
    _short = _label.partition("-")[0]
    TEMPLATES[_label] = (
        f"<<opt>>this <<var 3>> is<</opt>> licensed under the <<opt>>terms of the<</opt>> gnu {_name} <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> version {_version}",
        f"redistribute it and or modify it under the terms of the gnu {_name} as published by the free software foundation <<opt>>either<</opt>> version {_version} of the license",
        f"{_UNDER} <<opt>>gnu<</opt>> {_name} v{_version}",
        *(f"{_UNDER} <<opt>>gnu<</opt>> {_short}{v}{_version}" for v in (" ", " v", " version ", "v")),
        f"gnu {_name} version {_version} <<var 3>> copyright <<opt>>c<</opt>> <<var 3>> free software foundation",
    )
#: The Creative Commons licenses, by their parts and version: in short and in full.
for _label, _parts in (
    ("cc-by", ()), ("cc-by-sa", ("share alike",)), ("cc-by-nc", ("non commercial",)), ("cc-by-nd", ("no derivatives",)),
    ("cc-by-nc-sa", ("non commercial", "share alike")), ("cc-by-nc-nd", ("non commercial", "no derivatives")),
):
    _names = {" ".join(("attribution", *_parts)), " ".join(("attribution", *(p.replace(" ", "") for p in _parts)))}
    for _version in ("2.0", "3.0", "4.0"):
        _number, _start = _version.replace(".", " "), "<<opt>>licensed<</opt>> <<opt>>available<</opt>> under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>terms of the<</opt>>"
        TEMPLATES[f"{_label}-{_version}"] = (
            f"<<opt>>this work is<</opt>> {_start} {_label.replace('-', ' ')} {_number} <<opt>>international<</opt>> <<opt>>license<</opt>>",
            *(f"{_start} creative commons {name} <<opt>>license<</opt>> {_number}" for name in sorted(_names)),
            *(f"{_start} {name} license {_number}" for name in sorted(_names)),
        )
#: Names of licenses that count as a line of their own, as the headings of license files are.
HEADINGS = {
    "mit": ("<<opt>>the<</opt>> mit license <<opt>>mit<</opt>>",), "isc": ("<<opt>>the<</opt>> isc license <<opt>>isc<</opt>>",), "zlib": ("<<opt>>the<</opt>> zlib license",), "unlicense": ("the unlicense",),
    "apache-2.0": ("<<opt>>the<</opt>> apache license <<opt>>version<</opt>> 2 0",), "mpl-2.0": ("mozilla public license <<opt>>version<</opt>> 2 0",), "epl-2.0": ("eclipse public license <<opt>>version<</opt>> <<opt>>v<</opt>> 2 0",),
    "bsd-2-clause": ("<<opt>>the<</opt>> bsd 2 clause <<opt>>simplified<</opt>> license",), "bsd-3-clause": ("<<opt>>the<</opt>> bsd 3 clause <<opt>>new or revised<</opt>> license",), "bsl-1.0": ("boost software license <<opt>>version<</opt>> 1 0",),
    "gpl-2.0": ("gnu general public license <<opt>>version<</opt>> 2", "gnu gpl <<opt>>version<</opt>> 2", "gnu gpl v2"), "gpl-3.0": ("gnu general public license <<opt>>version<</opt>> 3", "gnu gpl <<opt>>version<</opt>> 3", "gnu gpl v3"),
    "lgpl-3.0": ("gnu lesser general public license <<opt>>version<</opt>> 3",), "agpl-3.0": ("gnu affero general public license <<opt>>version<</opt>> 3",),
}
#: The longest line that is looked at as a heading, in bytes.
HEADING_BYTES = 120
#: Words that, up to four words before a clause, refuse the license it names.
REFUSALS = frozenset((b"not", b"never", b"isn", b"aren", b"wasn", b"nor"))
#: Tags that name licenses by an expression of identifiers.
_TAG = re.compile(rb"spdx-license-identifier\s*:[ \t]*([^\r\n]*)")
_TERM = re.compile(rb"\s*([()]|[a-z0-9][a-z0-9.+-]*)")
#: Signs that no license's wording depends on, which texts have beside the ASCII ones: quotes, dashes, bullets, the copyright sign and spaces.
_SIGNS = re.compile("|".join("«»“”„‟‘’‚‛‹›–—−‐‑…•·©®™\u00a0\u2009\u202f").encode())


def tagged(low: bytes) -> set[str]:
    """Identifiers of the expressions that tags in a lower-case text hold: all that AND, OR and WITH join; `+` and -only are spelt out or left out."""
    found = set()
    for expression in _TAG.findall(low):
        at, wanted = 0, True  # an identifier, else a word that joins two
        while (m := _TERM.match(expression, at)) is not None:
            at, term = m.end(), m[1]
            if term in (b"(", b")"):
                continue
            if wanted:
                name = term.decode()
                found.add(name[:-1] + "-or-later" if name[-1] == "+" else name.removesuffix("-only"))
            elif term not in (b"and", b"or", b"with"):
                break
            wanted = not wanted
    return found


_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(/?opt|var \d+)>>")


class TokenAutomaton:
    """Accepts runs of words that a template allows.

    States are places between words; `step[state]` maps a word to the next state, `any_`
    holds the states that pass on any word, and `free` the moves that take no word.
    """

    def __init__(self, template: str):
        self.step: list[dict[bytes, int]] = [{}]
        self.any: list[bool] = [False]
        self.free: list[list[int]] = [[]]
        self.mandatory: list[bytes] = []
        opened: list[int] = []
        at = 0
        for part in re.split(r"(<<[^>]*>>)|\s+", template):
            if not part:
                continue
            if (mark := _MARKUP.fullmatch(part)) is None:
                word = part.encode()
                self.step[at][word] = at = self._state()
                if not opened:
                    self.mandatory.append(word)
            elif mark[1] == "opt":
                opened.append(at)
            elif mark[1] == "/opt":
                self.free[opened.pop()].append(at)
            else:
                ways = [at]
                for _ in range(int(mark[1][4:])):
                    self.any[at] = True
                    at = self._state()
                    ways.append(at)
                for way in ways[:-1]:
                    self.free[way].append(at)
        self.end = at
        self.start = self._closed({0})
        self.firsts = {w for s in self.start for w in self.step[s]}
        self.anchor = max(self.mandatory, key=len)

    def _state(self) -> int:
        self.step.append({})
        self.any.append(False)
        self.free.append([])
        return len(self.step) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def accepts_at(self, words: list[bytes], start: int) -> bool:
        """Whether some run of words from `start` is accepted."""
        states = self.start
        for k in range(start, len(words)):
            w = words[k]
            # A replaceable region's states are numbered in a row: a word passes to the next.
            after = {t for s in states if (t := self.step[s].get(w)) is not None} | {s + 1 for s in states if self.any[s]}
            if not after:
                return False
            states = self._closed(after)
            if self.end in states:
                return True
        return False

    def found_in(self, words: list[bytes]) -> bool:
        """Whether some run is accepted that no word before it refuses."""
        return any(w in self.firsts and self.accepts_at(words, k) and not REFUSALS.intersection(words[max(0, k - 4) : k]) for k, w in enumerate(words))

    def accepts_all(self, words: list[bytes]) -> bool:
        """Whether the words are accepted as a whole."""
        states = self.start
        for w in words:
            states = self._closed({t for s in states if (t := self.step[s].get(w)) is not None} | {s + 1 for s in states if self.any[s]})
        return self.end in states


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str | tuple[str, ...]] = TEMPLATES, headings: dict[str, tuple[str, ...]] = HEADINGS):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.automata, self.headings = self._compiled(templates), self._compiled(headings)

    @staticmethod
    def _compiled(templates: dict[str, str | tuple[str, ...]]) -> dict[bytes, list[tuple[str, TokenAutomaton]]]:
        found: dict[bytes, list[tuple[str, TokenAutomaton]]] = {}
        for label, of in templates.items():
            for template in (of,) if isinstance(of, str) else of:
                automaton = TokenAutomaton(template)
                found.setdefault(automaton.anchor, []).append((label, automaton))
        return found

    def _headed(self, low: bytes) -> set[str]:
        """Labels of the headings among the lines."""
        here = [(anchor, automata) for anchor, automata in self.headings.items() if anchor in low]
        if not here:
            return set()
        lines = [line for line in low.splitlines() if len(line) <= HEADING_BYTES]
        return {label for anchor, automata in here for line in lines if anchor in line for label, a in automata if a.accepts_all(_WORDS.findall(line))}

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        low = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
        words = _WORDS.findall(low)
        starts, base = [], set()
        for phrase, label in self.phrases:
            if all(w in low for w in phrase):
                n = len(phrase)
                at = [k for k, w in enumerate(words) if w == phrase[0] and words[k : k + n] == phrase]
                starts += at
                base |= {label} if at else set()
        exact = tagged(low) if b"spdx-license-identifier" in low else set()
        if not low.isascii() and (plain := _SIGNS.sub(b" ", low)) != low:  # for the templates only
            low, told = plain, _WORDS.findall(plain)
        else:
            told = words
        for anchor, automata in self.automata.items():
            if anchor in low:
                exact |= {label for label, a in automata if label not in exact and a.found_in(told)}
        exact |= self._headed(low)
        score = 1.0 if exact else 0.5 if base else 0.0
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | exact)), score


_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str | tuple[str, ...]] | None = None, headings: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Words, base phrases and accepted templates of every row of docs, over whole texts.

    score: 1 if a template's mandatory wording is matched exactly, 0.5 if only base
    phrases are found, else 0. templates: by label one template or several, of which one
    is enough; labels that end in -text or -notice stand for the whole wording, the others
    for a clause that names the license, unless a word like `not` stands before it.
    headings: names that count as a whole line. Tags of identifiers are read as expressions,
    and give the identifiers. Typographic signs don't hinder templates; base columns are theirs.

    Defined results: a null text is an empty one (no words, no labels, null places);
    repeated rows are each scanned; a null id is carried; extra columns are ignored; an
    empty table gives no rows.
    """
    prepare(docs.sparkSession)
    phrases, templates, headings = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, HEADINGS if headings is None else headings
    made: list[Scanner] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Scanner(phrases, templates, headings))
        for batch in batches:
            got = zip(*(made[0].scan(t) for t in batch.column(1).to_pylist())) if batch.num_rows else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(got, _TYPES.values()))], names=[id_col, *_TYPES])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = narrow.select(id_col).schema
    for name, kind in _TYPES.items():
        schema = schema.add(name, {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}[kind])
    return narrow.mapInArrow(run, schema)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))
