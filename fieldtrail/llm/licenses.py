"""Licence scan by a generalised suffix automaton of licence tokens.

The automaton accepts every run of words of every template. Files stream through it: the matching
statistics (length of the longest template run that ends at a word) give the maximal matches; matches
that follow each other in one template, with small gaps, chain into a covered span of that template.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Well-known notices, as words, then bodies of common licences. Label, then text.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software "
        "must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
        "copyright interest in the software to the public domain.",
    ),
]
#: Label and phrase of the base labels.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


@dataclass
class _State:
    length: int
    link: int = -1
    to: dict[int, int] = field(default_factory=dict)
    #: template -> end positions of all occurrences there
    ends: dict[int, list[int]] = field(default_factory=dict)


@dataclass
class _Chain:
    """Matches in a row: first and last word, end in the template, words covered, whether a longer chain goes on from it."""

    first: int
    last: int
    end: int
    covered: int
    goes_on: bool = False


class LicenseScanner:
    """``min_match``: words of a match that counts; ``max_gap``: words that may differ between chained matches;
    ``min_coverage``: share of a template's words that a chain must cover for its label."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, min_match: int = 3, max_gap: int = 4, min_coverage: float = 0.8):
        self.labels = [label for label, _ in templates]
        self.min_match, self.max_gap, self.min_coverage = min_match, max_gap, min_coverage
        self.vocabulary: dict[bytes, int] = {}
        self.texts = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)] for _, text in templates]
        self.phrases = [(label, words(text)) for label, text in phrases]
        self.heads: dict[bytes, list[tuple[str, list[bytes]]]] = {}
        for label, phrase in self.phrases:
            self.heads.setdefault(phrase[0], []).append((label, phrase))
        self.states = [_State(0)]
        for k, text in enumerate(self.texts):
            last = 0
            for end, word in enumerate(text):
                last = self._add(last, word, k, end)

    def _add(self, last: int, word: int, template: int, end: int) -> int:
        """Add a word after ``last``; then note the end at the state and its suffixes."""
        s = self.states
        if word in s[last].to:
            q = s[last].to[word]
            new = q if s[q].length == s[last].length + 1 else self._split(last, word, q)
        else:
            new = len(s)
            s.append(_State(s[last].length + 1))
            p = last
            while p >= 0 and word not in s[p].to:
                s[p].to[word] = new
                p = s[p].link
            if p < 0:
                s[new].link = 0
            else:
                q = s[p].to[word]
                s[new].link = q if s[q].length == s[p].length + 1 else self._split(p, word, q)
        p = new
        while p > 0:
            s[p].ends.setdefault(template, []).append(end)
            p = s[p].link
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        s = self.states
        copy = len(s)
        s.append(_State(s[p].length + 1, s[q].link, dict(s[q].to), {k: list(v) for k, v in s[q].ends.items()}))
        s[q].link = copy
        while p >= 0 and s[p].to.get(word) == q:
            s[p].to[word] = copy
            p = s[p].link
        return copy

    def matches(self, text: list[bytes]) -> list[tuple[int, int, int]]:
        """Maximal matches (last word's place, length, state) of at least ``min_match`` words."""
        out, state, length, before = [], 0, 0, -2
        s, vocabulary = self.states, self.vocabulary
        for i, w in [(i, w) for i, w in enumerate(text) if w in vocabulary]:
            word = vocabulary[w]
            if i != before + 1:
                if length >= self.min_match:
                    out.append((before, length, state))
                state = length = 0
            elif word not in s[state].to and length >= self.min_match:
                out.append((before, length, state))
            while state and word not in s[state].to:
                state = s[state].link
                length = s[state].length
            if word in s[state].to:
                state, length = s[state].to[word], length + 1
            before = i
        if length >= self.min_match:
            out.append((before, length, state))
        return out

    def spans(self, text: list[bytes]) -> list[tuple[str, int, int, float]]:
        """Chains: label, first and last word, share of the template's words that the chain covers.

        A match stands at each of its places in a template, and goes on there from the chain with which it covers most. Of chains of one
        template that overlap in the text, the one that covers most stays, of equal ones the first.
        """
        live: dict[int, list[_Chain]] = {}
        done: dict[int, list[_Chain]] = {}
        for last, length, state in self.matches(text):
            first = last - length + 1
            for k, ends in self.states[state].ends.items():
                # matches come by their first words, so what lies too far back stays there
                before = [c for c in live.get(k, ()) if first - c.last - 1 <= self.max_gap]
                done.setdefault(k, []).extend(c for c in live.get(k, ()) if first - c.last - 1 > self.max_gap)
                live[k] = before + [self._chain(before, first, last, end) for end in ends]
        out = []
        for k, rest in live.items():
            taken: list[tuple[int, int]] = []
            for c in sorted((c for c in done[k] + rest if not c.goes_on), key=lambda c: (-c.covered, c.first, c.last)):
                at = bisect_right(taken, (c.last, len(text)))
                if not at or taken[at - 1][1] < c.first:
                    insort(taken, (c.first, c.last))
                    out.append((self.labels[k], c.first, c.last, c.covered / len(self.texts[k])))
        return sorted(out)

    def _chain(self, before: list[_Chain], first: int, last: int, end: int) -> _Chain:
        """The match of words ``first`` to ``last`` that ends at ``end`` in the template, after the best of the chains ``before``."""
        length, best, covered = last - first + 1, None, last - first + 1
        for c in before:
            if c.last < last and c.end < end and end - length - c.end <= self.max_gap:
                n = c.covered + min(length, end - c.end, last - c.last)
                if n > covered or (n == covered and best is None):
                    best, covered = c, n
        if best is None:
            return _Chain(first, last, end, length)
        best.goes_on = True
        return _Chain(best.first, last, end, covered)

    def scan(self, text: str | None) -> dict:
        """Base phrases and chains of one text; see :func:`scan` for the fields."""
        ws = words(text)
        places, base = [], set()
        for head, phrases in self.heads.items():
            at = -1
            for _ in range(ws.count(head)):
                at = ws.index(head, at + 1)
                for label, phrase in phrases:
                    if ws[at : at + len(phrase)] == phrase:
                        places.append(at)
                        base.add(label)
        spans = self.spans(ws)
        found = [s for s in spans if s[3] >= self.min_coverage]
        return {
            "n_words": len(ws), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[0] for s in found})), "score": min(1.0, max([1.0 if base else 0.0, *(s[3] for s in spans)])),
            "spans": [{"label": a, "first": b, "last": c, "coverage": d} for a, b, c, d in found],
        }


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPANS}
SCAN_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,coverage:double>>"


def scan(docs: DataFrame, scanner: LicenseScanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, the base phrases' count, first and last places and labels, all labels, the best
    coverage as score, and the covered spans. A null or empty text has no words and no labels; repeated rows stay; an empty table gives no row; texts are read whole."""
    scanner = scanner or LicenseScanner()
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.scan(x) for x in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array([g[k] for g in got], kind) for k, kind in _FIELDS.items())], [id_col, *_FIELDS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCAN_DDL}")
