"""License scans: phrases, and templates whose mandatory wording must match exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import map_batches

#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Scores: a whole wording stands in the text; a short notice that names a license (in whatever sense: a notice is a few words);
#: a phrase alone.  Labels of notices end so.
WHOLE, SHORT, PHRASE, NOTICE = 1.0, 0.75, 0.5, "-notice"
#: License wordings (fixed values): short notices, and whole texts.  [[...]] is optional (and may hold further
#: optional regions); {n} is replaceable and stands for up to n words of any kind.  All else is mandatory.
TEMPLATES = {
    "mit-notice": "[[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license",
    "apache-2.0-notice": "licensed under the apache license version 2.0 [[(the license)]]",
    "gpl-3.0-notice": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3",
    "gpl-2.0-notice": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2",
    "cc-by-nc-4.0-notice": "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4.0 [[license]]",
    "cc-by-4.0-notice": "licensed under [[a]] [[the]] [[creative commons]] cc by 4.0 [[license]]",
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files (the software) to deal in the software without restriction including without limitation the rights to
        use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        [[(including the next paragraph)]] shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {8} be liable for any
        claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection
        with the software or the use or other dealings in the software""",
    "isc": """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and {8} disclaims all warranties with regard to this software including all implied warranties
        of merchantability and fitness in no event shall {8} be liable for any special direct indirect or consequential damages or any
        damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
        action arising out of or in connection with the use or performance of this software""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will {8} be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely subject to the following restrictions
        [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software
        if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        [[3]] this notice may not be removed or altered from any source distribution""",
    "apache-2.0": """licensed under the apache license version 2.0 (the license) you may not use this file except in compliance with
        the license you may obtain a copy of the license at [[http]] [[https]] [[www]] apache org licenses license 2.0 [[txt]]
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license""",
    **{name: f"""this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation [[either]] version {version} of the license {later}
        this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details"""
       for name, version, later in ((f"gpl-{v}.0-{kind}", v, more) for v in (2, 3) for kind, more in (("only", ""), ("or-later", "or [[(at your option)]] any later version")))},
    **{name: f"""redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions
        and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of
        conditions and the following disclaimer in the documentation and or other materials provided with the distribution {third}
        this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct
        indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
        services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
        strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
        the possibility of such damage"""
       for name, third in (("bsd-2-clause", ""), ("bsd-3-clause", "[[3]] neither the name of {12} may be used to endorse or promote products derived from this software without specific prior written permission"))},
}

_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MARK = re.compile(r"\[\[|\]\]|\{\d+\}|[^\[\]{}]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


class Automaton:
    """The words of a template as states: each state knows the words that lead on and where to, and the states
    that it may skip to (past an optional region, or past words of any kind)."""

    def __init__(self, template: str):
        self.step: list[bytes | None] = []  # the word (None: any) that leads from a state to the next
        self.skip: dict[int, set[int]] = {}
        self._lay(iter(_MARK.findall(template)))
        self.end = len(self.step)
        self.first = {w for s in self._closed({0}) if s < self.end and (w := self.step[s]) is not None}
        need = [w for s, w in enumerate(self.step) if w and not any(a <= s < b for a, to in self.skip.items() for b in to)]
        self.rare = max(need, key=lambda w: (len(w), w), default=b"")

    def _lay(self, marks: Iterator[str]) -> None:
        """States for the marks up to the end of the region."""
        for mark in marks:
            start = len(self.step)
            if mark == "]]":
                return
            if mark == "[[":
                self._lay(marks)
                self.skip.setdefault(start, set()).add(len(self.step))
            elif mark[0] == "{":
                self.step += [None] * int(mark[1:-1])
                for s in range(start, len(self.step)):
                    self.skip.setdefault(s, set()).add(len(self.step))
            else:
                self.step += words_of(mark)

    def _closed(self, states: set[int]) -> set[int]:
        out, new = set(states), list(states)
        while new:
            for t in self.skip.get(new.pop(), ()):
                if t not in out:
                    out.add(t)
                    new.append(t)
        return out

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Do the words from start on hold the whole mandatory wording?"""
        states = self._closed({0})
        for i in range(start, len(words)):
            if self.end in states:
                return True
            states = self._closed({s + 1 for s in states if s < self.end and self.step[s] in (None, words[i])})
            if not states:
                return False
        return self.end in states


def _scan(at: int, phrases: Mapping[str, str], templates: Mapping[str, str]):
    ends: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in phrases.items():
        ends.setdefault(words_of(phrase)[-1], []).append((words_of(phrase), label))
    automata = {label: Automaton(t) for label, t in templates.items()}

    def one(text: str | None) -> tuple:
        flat = (text or "").encode().translate(_WORD)
        words = flat.split()
        starts, base, more = [], set(), set()
        for last in ends:
            if last in flat:
                for i, w in enumerate(words):
                    if w == last:
                        for phrase, label in ends[last]:
                            if i + 1 >= len(phrase) and words[i + 1 - len(phrase) : i + 1] == phrase:
                                starts.append(i + 1 - len(phrase))
                                base.add(label)
        for label, a in automata.items():
            if a.rare in flat and a.rare in words and any(a.accepts(words, i) for i, w in enumerate(words) if w in a.first):
                more.add(label)
        score = max([WHOLE * any(not m.endswith(NOTICE) for m in more), SHORT * bool(more), PHRASE * bool(base)])
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        for batch in batches:
            found = [one(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *NEW])

    return go


NEW = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan_licenses(docs: DataFrame, text: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Adds to every row, from its whole text (null: empty): ``n_words``; ``n_base``, ``first_word`` and
    ``last_word`` (places of all base phrases, words counted from 0; null if none); ``base_labels``; ``labels``
    (base labels and names of templates whose automaton accepts some place of the text); ``score``
    (1: a license's whole mandatory wording, 0.75: a short notice, 0.5: phrases alone, 0: none).  Every row is scanned for
    itself, also repeated ones; no rows: no rows.  Columns of these names are replaced.  One pass, nothing is
    shuffled."""
    rest = docs.drop(*NEW)
    return map_batches(rest, _scan(rest.columns.index(text), phrases, templates), "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
