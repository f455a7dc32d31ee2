"""License texts and notices, by templates with optional and replaceable regions.

A template is text with <<opt>>...<<end>> around what may be missing and <<var N>> for up to N words of any kind. It is
compiled to an automaton over words: a state before each word, free moves around optional regions, and N states that read
anything for a replaceable one. A text is accepted where its mandatory wording stands exactly. Sets of states are made
deterministic as texts need them and kept by the worker.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.llm.common import annotate, words

#: The base phrases and their labels (fixed values).
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Templates of widespread license texts, whole, and of notices that stand for one (fixed wording), and their labels.
TEMPLATES = [
    ("mit", """<<opt>>the mit license<<end>> <<opt>>mit<<end>> <<opt>>copyright <<var 12>><<end>> Permission is hereby granted, free of charge, to any person
     obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without
     limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
     Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next
     paragraph)<<end>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
     EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
     THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
     OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """<<opt>>isc license<<end>> <<opt>>copyright <<var 12>><<end>> Permission to use, copy, modify, and<<opt>>/or<<end>> distribute this software for any
     purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
     PROVIDED "AS IS" AND <<var 4>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
     EVENT SHALL <<var 4>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
     PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
     SOFTWARE."""),
    ("0bsd", """Permission to use, copy, modify, and<<opt>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS
     PROVIDED "AS IS" AND <<var 4>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
     EVENT SHALL <<var 4>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
     PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
     SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
     met: <<opt>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
     <<opt>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
     documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<var 8>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
     INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 8>> BE
     LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
     SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
     TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
     met: <<opt>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
     <<opt>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
     documentation and/or other materials provided with the distribution. <<opt>>3.<<end>> Neither the name of <<var 12>> nor the names of its contributors may be
     used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<var 8>> "AS IS" AND
     ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
     DISCLAIMED. IN NO EVENT SHALL <<var 8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
     LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
     LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
     ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the author<<opt>>s<<end>> be held liable for any damages
     arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
     it and redistribute it freely, subject to the following restrictions: <<opt>>1.<<end>> The origin of this software must not be misrepresented; you must not
     claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
     not required. <<opt>>2.<<end>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
     <<opt>>3.<<end>> This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
     distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In
     jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
     domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
     overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
     WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
     NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
     ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 <<opt>>(the "License")<<end>>; you may not use this file except in compliance with the License. You
     may obtain a copy of the License at <<opt>>http<<end>> <<opt>>https<<end>> www.apache.org/licenses/LICENSE-2.0 <<opt>>html<<end>> <<opt>>txt<<end>> Unless
     required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
     OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 <<opt>>(the "License")<<end>>"""),
    ("apache-2", """Apache License Version 2.0<<opt>>, January 2004<<end>>"""),
    ("mit", """<<opt>>released licensed distributed available<<end>> under the <<opt>>terms of the<<end>> MIT License"""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
     Software Foundation, either version 3 of the License, or <<opt>>(at your option)<<end>> any later version. This program is distributed in the hope that it
     will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
     License for more details."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
     Software Foundation; either version 2 of the License, or <<opt>>(at your option)<<end>> any later version. This program is distributed in the hope that it
     will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
     License for more details."""),
    ("gpl-3", """This <<var 3>> is licensed under the <<opt>>terms of the<<end>> GNU General Public License<<opt>>, <<end>> version 3"""),
    ("gpl-2", """This <<var 3>> is licensed under the <<opt>>terms of the<<end>> GNU General Public License<<opt>>, <<end>> version 2"""),
    ("cc-by-nc", """licensed under <<opt>>a Creative Commons<<end>> <<opt>>CC BY-NC<<end>> <<opt>>Attribution-NonCommercial<<end>> 4.0 <<opt>>International<<end>>"""),
    ("cc-by-sa", """licensed under CC BY-SA <<opt>>4.0<<end>>"""),
    ("cc-by", """licensed under CC BY 4.0"""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
     obtain one at <<opt>>http<<end>> <<opt>>https<<end>> mozilla.org/MPL/2.0/."""),
]
#: A word that no template has, and what reads any word.
OTHER, ANY = 0, -1
MARKUP = re.compile(r"<<(opt|end|var (\d+))>>")


class Templates:
    def __init__(self, templates: list[tuple[str, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.on: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []
        self.final: dict[int, int] = {}
        starts = []
        for k, (_, text) in enumerate(templates):
            start = self.state()
            starts.append(start)
            self.final[self.build(text, start)] = k
        #: Words of each template that must stand.
        self.mandatory = [len(words(MARKUP.sub(" ", re.sub(r"<<opt>>.*?<<end>>", " ", t, flags=re.S)))) for _, t in templates]
        self.start = self.closed(starts)
        self.steps: dict[frozenset, dict[int, frozenset]] = {}
        self.accepted: dict[frozenset, list[int]] = {}
        if self.start & self.final.keys():
            raise ValueError("a template accepts nothing at all")
        self.first = {w for s in self.start for w, _ in self.on[s]}
        if ANY in self.first:
            raise ValueError("a template begins with a replaceable region")

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def build(self, text: str, at: int) -> int:
        opened, last = [], 0
        for mark in [*MARKUP.finditer(text), None]:
            for word in words(text[last : mark.start() if mark else len(text)]):
                after = self.state()
                self.on[at].append((self.vocabulary.setdefault(word, len(self.vocabulary) + 1), after))
                at = after
            if mark is None:
                return at
            last = mark.end()
            if mark[1] == "opt":
                opened.append(at)
            elif mark[1] == "end":
                after = self.state()
                self.free[at].append(after)
                self.free[opened.pop()].append(after)
                at = after
            else:
                end = self.state()
                for _ in range(int(mark[2])):
                    self.free[at].append(end)
                    after = self.state()
                    self.on[at].append((ANY, after))
                    at = after
                self.free[at].append(end)
                at = end

    def closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def step(self, states: frozenset, word: int) -> frozenset:
        row = self.steps.setdefault(states, {})
        if word not in row:
            after = self.closed({t for s in states for on, t in self.on[s] if on == word or on == ANY})
            row[word] = after
            self.accepted[after] = sorted(self.final[s] for s in after if s in self.final)
        return row[word]

    def find(self, text: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, end) of each template at each word where it is accepted, at its longest there."""
        get, found = self.vocabulary.get, []
        numbers = [get(w, OTHER) for w in text]
        first = self.first
        for i in [i for i, w in enumerate(numbers) if w in first]:
            states, ends = self.start, {}
            for j in range(i, len(numbers)):
                states = self.step(states, numbers[j])
                if not states:
                    break
                for k in self.accepted[states]:
                    ends[k] = j + 1
            found += [(k, i, end) for k, end in sorted(ends.items())]
        return found


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("licenses", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("score", T.DoubleType()),
])
_compiled: dict[tuple, Templates] = {}


def find_licenses(df: DataFrame, phrases: list = PHRASES, templates: list = TEMPLATES, text_col: str = "text") -> DataFrame:
    """df with n_words, licenses (label, whether of a base phrase, first word and end) by start, and score.

    score is m / (m + 4), where m is the number of mandatory words of the longest template found; 0 if there is none. A
    null text is empty, a very long one is read whole. Rows are kept one for one; columns of df with these names, in whatever
    case, are replaced. One map, no shuffle.
    """
    both = [*phrases, *templates]

    def make():
        key = tuple(map(tuple, both))
        found = _compiled.get(key) or _compiled.setdefault(key, Templates(both))

        def one(text: str | None) -> tuple:
            all_words = words(text)
            places = sorted(found.find(all_words), key=lambda p: (p[1], p[0]))
            most = max((found.mandatory[k] for k, _, _ in places), default=0)
            rows = [{"label": both[k][0], "base": k < len(phrases), "start": s, "end": e} for k, s, e in places]
            return len(all_words), rows, most / (most + 4) if most else 0.0

        return lambda texts: list(map(one, texts))

    return annotate(df, text_col, make, FIELDS)


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("licenses", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    labels = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("licenses")).alias("labels"), "score")
