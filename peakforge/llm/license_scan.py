"""Licence scan: a positional index of licence words, looked up by each file's rarest ones.

A text becomes its word sequence (A-Z lower-cased, words of digits, a-z and non-ASCII characters). Document
frequencies of all template words are counted over the whole corpus. The index posts every word to its positions in the
templates. A file is looked up by the licence words that it has, highest IDF first: for each template of which it has
enough words, the ``ANCHORS`` rarest of them tell starts (position in the file less position in the template), and
where enough of them agree, give or take a few words, the place is verified: the template's words must stand there for the
most part, and its mandatory key phrases too. So no single word must have stayed unchanged, apart from the key phrases.
All work is row-local DataFrame functions: no shuffle, but for the corpus count, which leaves one row per template word.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

#: Base phrases of the op4 contract.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # mandatory phrases, as words joined by one space

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(NON_WORD, self.text.lower()) if w]


#: The whole texts of short public licences, the standard notices of long ones, and usual one-line mentions;
#: with each the phrases without which it is not that licence.
TEMPLATES = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("hereby granted free of charge",)),
    Template("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", ("source and binary forms",)),
    Template("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", ("source and binary forms", "endorse or promote products")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ("with or without fee",)),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""", ("redistribute it freely",)),
    Template("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""", ("person or organization obtaining",)),
    Template("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.""", ("unencumbered software",)),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache license version 2",)),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", ("gnu general public license",)),
    Template("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""", ("gnu lesser general public license",)),
    Template("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""", ("gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public license",)),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse public license",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("commons attribution sharealike",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("bsd-3-clause", "Licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
    Template("spdx", "SPDX-License-Identifier", ("spdx license identifier",)),
)

#: Share of a template's different words that a file, and the place of a match, must have; words that are looked up by
#: position, and the share of them that must agree on a start.
LEAST, ANCHORS, AGREE = 0.7, 8, 0.6


def normalised(text: Column) -> Column:
    """``^ w0 w1 ... wn `` : a sentinel and the words, each between single spaces; null counts as empty."""
    body = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NON_WORD, " ")
    return F.concat(F.lit("^ "), F.trim(body), F.lit(" "))


def spaces(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))


def has_phrase(norm: Column, phrase: str) -> Column:
    return F.contains(norm, F.lit(f" {phrase} "))


def idf_table(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[str, int]:
    """Number of documents of the whole corpus that have each template word; words that none has are not in it."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = F.split(normalised(F.col(f"`{text}`")), " ")
    found = docs.select(F.explode(F.array_intersect(_words(vocabulary), words)).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per template word


def _words(words) -> Column:
    """A literal array of words, which hold no space."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def by_rarity(counts: dict[str, int]) -> list[str]:
    """Template words of the corpus, highest IDF first; ties by word."""
    return sorted(counts, key=lambda w: (counts[w], w))


def least_words(t: Template) -> int:
    """How many of its different words must be there."""
    return math.ceil(round(LEAST * len(set(t.words)), 9))


def telling_words(templates, counts: dict[str, int]) -> list[str]:
    """A file without any of these words has too few words of every template: of each template the rarest ones, one more
    than may be absent."""
    out: set[str] = set()
    for t in templates:
        kinds = sorted(set(t.words), key=lambda w: (counts.get(w, 0), w))
        out |= {w for w in kinds[: len(kinds) - least_words(t) + 1] if w in counts}
    return sorted(out)


def tolerance(t: Template) -> int:
    """By how many words the starts that a template's anchors tell may differ."""
    return 2 + len(t.words) // 10


def _index(templates) -> Column:
    """The templates as a literal array of structs; a word's postings are its places in ``words``."""
    return F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"), _words(t.words).alias("words"), _words(sorted(set(t.words))).alias("kinds"), F.split(F.lit("|".join(t.keys)), "[|]").alias("keys"),
                F.lit(least_words(t)).alias("least"), F.lit(tolerance(t)).alias("wide"),
            )
            for t in templates
        ]
    )


def _match(words: Column, own: Column, t: Column) -> Column:
    """The first place at which the template stands, as struct(label, start, share), else null.

    ``words``: the file's, a sentinel first; ``own``: the template's words that the file has, highest IDF first; ``t``: the
    template's entry in the index.
    """

    def starts(anchors: Column) -> Column:
        """Starts on which enough anchors agree: their postings' relative positions, sorted, a run of them close together."""
        places = lambda a: F.filter(F.transform(words, lambda w, i: F.when(w == a, i - 1)), lambda i: i.isNotNull())
        posted = lambda a: F.filter(F.transform(t["words"], lambda w, i: F.when(w == a, i)), lambda i: i.isNotNull())
        told = lambda a: let(posted(a), lambda ps: F.flatten(F.transform(places(a), lambda f: F.transform(ps, lambda p: F.struct((f - p).alias("d"), a.alias("w"))))))
        need = F.greatest(F.least(F.lit(2), F.size(anchors)), F.ceil(F.size(anchors) * F.lit(AGREE))).cast("int")
        votes = F.array_sort(F.array_distinct(F.flatten(F.transform(anchors, told))))

        def runs(x: Column) -> Column:  # struct(v: votes, need)
            close = F.transform(x["v"], lambda v, i: F.when(F.get(x["v"], i + x["need"] - 1)["d"] - v["d"] <= t["wide"], v["d"]))
            return F.array_distinct(F.filter(close, lambda d: d.isNotNull()))

        return let(F.struct(votes.alias("v"), need.alias("need")), runs)

    def verified(d: Column) -> Column:
        first = F.greatest(d - t["wide"], F.lit(0))

        def at(window: Column) -> Column:
            run = F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" "))

            def judge(there: Column) -> Column:
                keys = F.forall(t["keys"], lambda k: F.contains(run, F.concat(F.lit(" "), k, F.lit(" "))))
                found = F.struct(t["label"].alias("label"), F.greatest(d, F.lit(0)).cast("long").alias("start"), (there / F.size(t["kinds"])).alias("share"))
                return F.when((there >= t["least"]) & keys, found)

            return let(F.size(F.array_intersect(t["kinds"], window)), judge)

        return let(F.slice(words, first + 2, d + F.size(t["words"]) + t["wide"] - first), at)

    found = let(F.slice(own, 1, ANCHORS), lambda anchors: F.filter(F.transform(starts(anchors), verified), lambda m: m.isNotNull()))
    return F.get(found, F.lit(0))


def scan_licences(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and matches; such columns are replaced.

    ``matches``: array of struct(label, start, share), one for each template that stands in the text: the first place at
    which it does, and the share of its different words that stand there. ``score`` is the largest share (1 for a base
    phrase, 0 without any label). Null and empty texts have no words, no labels and null first_word and last_word. Rows
    are judged one by one, so repeated rows get equal results, and an empty table gives an empty result. Columns of
    other names stay, whatever they are.
    """
    counts_of = idf_table(docs, text, templates)
    rare, telling = _words(by_rarity(counts_of)), _words(telling_words(templates, counts_of))
    index, none = _index(templates), F.array().cast("array<struct<label:string,start:bigint,share:double>>")
    mine = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    rest = [c for c in docs.columns if c.lower() not in mine or c == text]
    pattern = "(?= (?:" + "|".join(BASE_PHRASES) + ") )"

    def base(norm: Column) -> Column:
        def of(pieces: Column) -> Column:
            total = F.when(norm == "^  ", F.lit(0)).otherwise(spaces(norm) - 1)
            places = F.size(pieces) - 1
            tail = spaces(F.element_at(pieces, -1))
            return F.struct(
                total.cast("long").alias("n_words"),
                places.cast("long").alias("n_base"),
                F.when(places > 0, spaces(F.element_at(pieces, 1))).cast("long").alias("first_word"),
                F.when(places > 0, total + 1 - tail).cast("long").alias("last_word"),
            )

        return let(F.split(norm, pattern), of)

    def lookup(words: Column) -> Column:
        def of(own: Column) -> Column:
            def place(t: Column) -> Column:
                return let(F.array_intersect(own, t["kinds"]), lambda o: F.when(F.size(o) >= t["least"], _match(words, o, t)))

            return F.when(F.arrays_overlap(own, telling), F.filter(F.transform(index, place), lambda m: m.isNotNull())).otherwise(none)

        return let(F.array_intersect(rare, words), of)

    norm, counts, by_phrase = (fresh(docs, x) for x in ("norm", "counts", "phrases"))
    fewest = min((least_words(t) for t in templates), default=0)
    out = docs.select(*[F.col(f"`{c}`") for c in rest], normalised(F.col(f"`{text}`")).alias(norm))
    n = F.col(norm)
    labels = F.filter(F.array(*[F.when(has_phrase(n, p), F.lit(label)) for p, label in BASE_PHRASES.items()]), lambda x: x.isNotNull())
    out = out.withColumns({counts: base(n), "matches": F.when(spaces(n) >= fewest, let(F.split(n, " "), lookup)).otherwise(none) if templates else none})
    out = out.withColumn(by_phrase, F.when(F.col(counts)["n_base"] > 0, labels).otherwise(F.array().cast("array<string>")))
    label_set = F.array_sort(F.array_distinct(F.concat(F.col(by_phrase), F.transform("matches", lambda m: m["label"]))))
    share = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return out.select(
        *[F.col(f"`{c}`") for c in rest],
        *[F.col(counts)[c].alias(c) for c in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join(F.array_sort(F.array_distinct(by_phrase)), ",").alias("base_labels"),
        F.array_join(label_set, ",").alias("labels"),
        F.when(F.col(counts)["n_base"] > 0, F.lit(1.0)).otherwise(share).alias("score"),
        "matches",
    )
