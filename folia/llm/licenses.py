"""License scans by template-markup matching.

A template is license wording with markup: ``<<beginOptional>>`` to
``<<endOptional>>`` may be absent (and may be nested), and
``<<var;name=...;original=...;match=...>>`` stands for replaceable words;
``match`` is ``.{a,b}``, any a to b words, or alternatives of words parted by
``|``. A template compiles to an automaton over words: a chain of states with
arcs for words, arcs for any word, and empty arcs around optional parts. A text
is accepted where the automaton finishes, so all mandatory wording must stand
there exactly, word for word, whatever the case, the punctuation and the line
breaks. A template is tried only on texts with all the words that every
acceptance needs, and the search starts only where one of the words that may
come first stands.

Words are runs of letters and digits (any character outside ASCII counts as a
letter), with ``A-Z`` in lower case.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folia.llm.common import with_kernel

#: Base phrases and their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Wording that several templates share (fixed values).
_HOLDERS = """<<var;name="holders";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,10}">>"""
_GPL = """is free software; you can redistribute it and or modify
        it under the terms of the GNU General Public License as published by the Free Software Foundation
        <<beginOptional>>either<<endOptional>> version {v} <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>"""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY <<var;name="holders";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".{1,12}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        <<var;name="liable";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".{1,12}">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>><<var;name="b1";original="1";match="1|a">><<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>><<var;name="b2";original="2";match="2|b">><<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution."""

#: Templates of the method: label and markup (fixed values; the wording is the licenses' own). Labels in ``-text`` are
#: whole licenses, in ``-opening`` how their texts begin, in ``-header`` and ``-notice`` what files and readers are told.
TEMPLATES = (
    (
        "mit-text",
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;name="what";original="this software and associated documentation files (the "Software")";match=".{{1,12}}">>,
        to deal in the <<var;name="noun";original="Software";match="software|materials|work">> without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        <<var;name="noun2";original="Software";match="software|materials|work">>, and to permit persons to whom the <<var;name="noun3";original="Software";match="software|materials|work">> is
        <<beginOptional>>furnished<<endOptional>> <<beginOptional>>provided<<endOptional>> to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
        <<var;name="noun4";original="Software";match="software|materials|work">>.
        THE <<var;name="noun5";original="SOFTWARE";match="software|materials|work">> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {_HOLDERS} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE <<var;name="noun6";original="SOFTWARE";match="software|materials|work">> OR THE USE OR OTHER DEALINGS IN THE
        <<var;name="noun7";original="SOFTWARE";match="software|materials|work">>""",
    ),
    (
        "mit-opening",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;name="what";original="this software and associated documentation files (the "Software")";match=".{1,12}">>,
        to deal in the <<var;name="noun";original="Software";match="software|materials|work">> without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies""",
    ),
    (
        "mit-notice",
        """<<beginOptional>><<var;name="thing";original="This";match="this|the">> <<var;name="noun";original="software";match="software|work|code|project|library|file">>
        <<beginOptional>>is<<endOptional>><<endOptional>>
        <<var;name="verb";original="Released";match="released|licensed|distributed|available|published">> under the <<beginOptional>>terms of the<<endOptional>> MIT License""",
    ),
    (
        "isc-text",
        f"""Permission to use, copy, modify, <<var;name="and";original="and/or";match="and or|and">> distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";original="THE AUTHOR";match=".{{1,8}}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {_HOLDERS} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    ),
    (
        "apache-2-header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
        <<var;name="noun";original="file";match="file|software|work|project">> except in compliance with the License.
        <<beginOptional>>You may obtain a copy of the License at <<beginOptional>>http://www.apache.org/licenses/LICENSE-2.0<<endOptional>>
        <<beginOptional>>https://www.apache.org/licenses/LICENSE-2.0<<endOptional>><<endOptional>>
        <<beginOptional>>Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.<<endOptional>>""",
    ),
    (
        "apache-2-notice",
        """<<var;name="verb";original="Licensed";match="released|licensed|distributed|available|published">> under the
        <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>Version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>""",
    ),
    ("gpl-2-header", _GPL.replace("{v}", "2")),
    ("gpl-3-header", _GPL.replace("{v}", "3")),
    (
        "gpl-3-notice",
        """<<var;name="verb";original="licensed";match="released|licensed|distributed|available|published">> under the <<beginOptional>>terms of the<<endOptional>>
        GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3""",
    ),
    ("bsd-2-text", f"{_BSD_CONDITIONS} {_BSD_WARRANTY}"),
    (
        "bsd-3-text",
        f"""{_BSD_CONDITIONS} <<beginOptional>><<var;name="b3";original="3";match="3|c">><<endOptional>> Neither the name of <<var;name="owner";original="the copyright holder";match=".{{1,10}}">>
        nor the names of <<beginOptional>>its<<endOptional>> <<beginOptional>>other<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. {_BSD_WARRANTY}""",
    ),
    (
        "bsd-opening",
        """Redistribution and use in source and binary forms, with or without modification, are permitted
        <<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the following conditions are met""",
    ),
    *[
        (
            label,
            f"""<<beginOptional>>or modify it<<endOptional>> under the terms of <<beginOptional>>version {v} of<<endOptional>> the
            GNU {which} General Public License <<var;name="order";original="version {v}";match="version {v}|v{v}">> <<beginOptional>>only<<endOptional>> <<beginOptional>>as<<endOptional>> published by the Free Software Foundation""",
        )
        for label, which, v in (("gpl-2-header", "", "2"), ("gpl-3-header", "", "3"), ("lgpl-2.1-header", "Lesser", "2.1"), ("agpl-3-header", "Affero", "3"))
    ],
    ("lgpl-2.1-header", _GPL.replace("{v}", "2.1").replace("General", """<<var;name="which";original="Lesser";match="lesser|library">> General""")),
    ("lgpl-3-header", _GPL.replace("{v}", "3").replace("General", "Lesser General")),
    ("agpl-3-header", _GPL.replace("{v}", "3").replace("General", "Affero General")),
    (
        "mpl-2-header",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<beginOptional>>If a copy of the MPL was not distributed with this file, You can obtain one at
        <<var;name="scheme";original="https";match="http|https">>://mozilla.org/MPL/2.0/<<endOptional>>""",
    ),
    *[
        (label, f"""<<var;name="verb";original="licensed";match="released|licensed|distributed|available|published">> under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
        <<beginOptional>>terms of the<<endOptional>> <<var;name="long";original="CC";match="cc|creative commons">> <<var;name="terms";original="{terms.split("|")[0]}";match="{terms}">>""")
        for label, terms in (
            ("cc-by-notice", "by|attribution"),
            ("cc-by-sa-notice", "by sa|attribution sharealike|attribution share alike"),
            ("cc-by-nd-notice", "by nd|attribution noderivatives|attribution noderivs|attribution no derivatives"),
            ("cc-by-nc-notice", "by nc|attribution noncommercial|attribution non commercial"),
            ("cc-by-nc-sa-notice", "by nc sa|attribution noncommercial sharealike|attribution non commercial sharealike|attribution non commercial share alike"),
            ("cc-by-nc-nd-notice", "by nc nd|attribution noncommercial noderivatives|attribution noncommercial noderivs|attribution non commercial noderivatives|attribution non commercial no derivatives"),
        )
    ],
    *[
        (f"{name}-spdx", f"SPDX-License-Identifier: {identifier}")
        for name, identifier in (
            ("mit", "MIT"), ("isc", "ISC"), ("apache-2", "Apache-2.0"), ("bsd-2", "BSD-2-Clause"), ("bsd-3", "BSD-3-Clause"), ("gpl-2", "GPL-2.0"), ("gpl-3", "GPL-3.0"), ("lgpl-2.1", "LGPL-2.1"),
            ("lgpl-3", "LGPL-3.0"), ("agpl-3", "AGPL-3.0"), ("mpl-2", "MPL-2.0"), ("cc0-1", "CC0-1.0"), ("cc-by-4", "CC-BY-4.0"), ("cc-by-sa-4", "CC-BY-SA-4.0"), ("cc-by-nc-4", "CC-BY-NC-4.0"), ("cc-by-nc-sa-4", "CC-BY-NC-SA-4.0"),
        )
    ],
)

#: Labels of terms of which one may be the beginning of another.
_TERMS = re.compile("cc-.*-notice")

#: Everything that parts words becomes a space, capitals become small; other bytes stay.
_TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
_MARK = re.compile(r"<<(beginOptional|endOptional|var;.*?\">>)(?:>>)?", re.S)


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Automaton:
    """A compiled template. ``arcs[s]``: (word or None for any word, next state); ``free[s]``: states reached without a word."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.arcs: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.final = self._compile(markup)
        self.closed = [self._closure({s}) for s in range(len(self.arcs))]
        self.first = {w for s in self.closed[0] for w, _ in self.arcs[s]}
        #: With a space around each, the words without which nothing is accepted.
        self.needed = [b" " + w + b" " for w in sorted({w for arcs in self.arcs for w, _ in arcs if w is not None}, key=lambda w: (-len(w), w)) if not self._reaches_end_without(w)]
        if None in self.first or self.final in self.closed[0]:
            raise ValueError(f"template {label}: it must begin with words of its own")

    def _state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _chain(self, at: int, found: list[bytes | None], end: int | None = None) -> int:
        for i, w in enumerate(found):
            nxt = end if end is not None and i == len(found) - 1 else self._state()
            self.arcs[at].append((w, nxt))
            at = nxt
        return at

    def _compile(self, markup: str) -> int:
        at, place, opened = 0, 0, []
        for m in _MARK.finditer(markup):
            at = self._chain(at, words(markup[place : m.start()]))
            place = m.end()
            if m[1] == "beginOptional":
                inner = self._state()
                self.free[at].append(inner)
                opened.append(at)
                at = inner
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError(f"template {self.label}: an optional part ends that didn't begin")
                after = self._state()
                self.free[at].append(after)
                self.free[opened.pop()].append(after)
                at = after
            else:
                rule = re.search(r'match="(.*?)">>$', m[0], re.S)[1]
                after = self._state()
                if counted := re.fullmatch(r"\.\{(\d+),(\d+)\}", rule):
                    least, most = map(int, counted.groups())
                    for i in range(most):
                        if i >= least:
                            self.free[at].append(after)
                        at = self._chain(at, [None])
                    self.free[at].append(after)
                else:
                    for choice in rule.split("|"):
                        self._chain(at, words(choice), after)
                at = after
        if opened:
            raise ValueError(f"template {self.label}: an optional part doesn't end")
        return self._chain(at, words(markup[place:]))

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def _reaches_end_without(self, word: bytes) -> bool:
        seen, todo = set(self.closed[0]), list(self.closed[0])
        while todo:
            new = {n for w, s in self.arcs[todo.pop()] if w != word for n in self.closed[s]} - seen
            seen |= new
            todo.extend(new)
        return self.final in seen

    def match(self, found: list[bytes], at: int) -> int | None:
        """Where the longest acceptance that begins at word ``at`` ends, or None."""
        now, end = self.closed[0], None
        while True:
            if self.final in now:
                end = at
            if at >= len(found):
                return end
            step = {n for s in now for w, n in self.arcs[s] if w is None or w == found[at]}
            if not step:
                return end
            now = frozenset().union(*(self.closed[s] for s in step))
            at += 1


def phrase_places(found: list[bytes], line: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which a phrase begins, overlaps included; ``line``: the words with a space around each."""
    out, at = [], line.find(b" " + phrase + b" ")
    seen, before = 0, 0
    while at >= 0:
        seen += line.count(b" ", before, at)
        before = at
        out.append(seen)
        at = line.find(b" " + phrase + b" ", at + 1)
    return out


def starts(automata: list[Automaton]) -> dict[bytes, list[Automaton]]:
    """The automata by the words that they may begin with."""
    spots: dict[bytes, list[Automaton]] = {}
    for a in automata:
        for w in a.first:
            spots.setdefault(w, []).append(a)
    return spots


def scan(text: str | None, automata: list[Automaton], spots: dict[bytes, list[Automaton]] | None = None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int]]]:
    """(number of words, base places (label, word), accepted templates (label, first word, end))."""
    found = words(text)
    line = b" " + b" ".join(found) + b" "
    base = [(label, at) for phrase, label in PHRASES for at in phrase_places(found, line, phrase.encode())]
    accepted = []
    tried = {id(a) for a in automata if all(w in line for w in a.needed)}
    if tried:
        spots = starts(automata) if spots is None else spots
        for at, w in enumerate(found):
            for a in spots.get(w, ()):
                end = a.match(found, at) if id(a) in tried else None
                if end is not None:
                    accepted.append((a.label, at, end))
    # of terms that begin alike, the longest are meant: "by nc" is not what "by nc sa" says
    longest: dict[int, int] = {}
    for label, at, end in accepted:
        if _TERMS.fullmatch(label):
            longest[at] = max(end, longest.get(at, 0))
    return len(found), base, [x for x in accepted if not _TERMS.fullmatch(x[0]) or x[2] == longest[x[1]]]


_OUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def license_scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Adds what license wording each text holds.

    ``n_words``; ``n_base``, the places of base phrases, with the smallest and
    largest in ``first_word`` and ``last_word`` (null without one);
    ``base_labels`` and ``labels`` (base and accepted templates), distinct,
    sorted and comma-joined, empty without one; ``score``: 1 if a template
    accepts, 0.8 if only base phrases stand there, 0 else. Null counts as empty.
    Repeated rows get equal results; kept columns with the names of new ones
    give way; no rows give no rows.
    """

    def make():
        automata = [Automaton(label, markup) for label, markup in templates]
        spots = starts(automata)

        def kernel(texts):
            rows = []
            for text in texts:
                n, base, accepted = scan(text, automata, spots)
                places = [at for _, at in base]
                own = {label for label, _ in base}
                labels = own | {label for label, _, _ in accepted}
                rows.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), 1.0 if accepted else 0.8 if base else 0.0))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in _OUT]

        return kernel

    return with_kernel(docs, make, [text_col], _OUT, keep)
