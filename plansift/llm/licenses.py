"""License scan with a positional rare-token index.

Every template (a licence's whole text or notice, a sentence of it, or a short phrase) lists its words by position. How rare a licence
word is comes from the corpus: one pass counts, over all documents, how many hold each word of the
templates' vocabulary. For a file, the words it holds of each template, the highest in IDF first and so many a template (so that one
licence takes nothing from another), are looked up in the templates' postings; each hit votes for the place where the template would begin (position in the file less
position in the template). Votes within a window of places, which is as wide as a sixth of the template, count together, so that inserted or lost words don't split a licence; each of its positions counts once. A window
whose votes weigh enough is verified: the template's mandatory
key phrases must stand where its hits have them, give or take the window.
Phrases of one kind, the base ones, are found at every place: their rarest word is looked up wherever
it stands, and the other words must stand at the same relative positions.

Nulls count as empty texts; without words all counts are 0, the places null, the labels '' and the
score 0. Repeated rows give repeated rows; an empty table gives no rows. A text is held whole in its task; the work on it is linear in its words, but for sorting the hits of a template.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import map_rows, text_or_empty

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licences, whole texts and notices after the short ones; the parts between * are their mandatory key phrases.
TEMPLATES = (
    ("agpl", "*gnu affero general public license*"),
    ("apache-2.0", "licensed under the *apache license* version 2 0"),
    ("artistic-2.0", "*the artistic license* 2 0"),
    ("bsd", "*redistribution and use in source and binary forms* with or without modification *are permitted* provided that the following conditions are met"),
    ("bsl-1.0", "*boost software license* version 1 0"),
    ("cc-by-nc", "licensed under *cc by nc* 4 0"),
    ("cc-by-nc-sa", "licensed under *cc by nc sa* 4 0"),
    ("cc-by-nd", "licensed under *cc by nd* 4 0"),
    ("cc-by-sa", "licensed under *cc by sa* 4 0"),
    ("cc0", "*cc0 1 0 universal* public domain dedication"),
    ("creative-commons", "licensed under a *creative commons attribution* international license"),
    ("epl-2.0", "*eclipse public license* v 2 0"),
    ("gpl-2.0", "this work is licensed under the *gnu general public license version 2*"),
    ("gpl-3.0", "this work is licensed under the *gnu general public license version 3*"),
    ("isc", "*permission to use copy modify and or distribute this software* for any purpose *with or without fee* is hereby granted"),
    ("lgpl", "*gnu lesser general public license*"),
    ("mit", "*permission is hereby granted free of charge* to any person obtaining *a copy of this software* and associated documentation files"),
    ("mit-name", "released under the *mit license*"),
    ("mpl-2.0", "this source code form is subject to the terms of the *mozilla public license* v 2 0"),
    ("ofl-1.1", "licensed under the *sil open font license* version 1 1"),
    ("unlicense", "this is *free and unencumbered software released into the public domain*"),
    ("warranty-disclaimer", "the software is provided *as is without warranty of any kind* express or implied"),
    ("mit", "*permission is hereby granted free of charge* to any person obtaining *a copy of this software* and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose *with or without fee is hereby granted* provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", "*redistribution and use in source and binary forms* with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 *redistributions in binary form must reproduce* the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3-clause", "*redistribution and use in source and binary forms* with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 *neither the name of* the copyright holder nor the names of its contributors may be used to *endorse or promote products derived from this software* without specific prior written permission"),
    ("zlib", "this software is *provided as is without any express or implied warranty* in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 *the origin of this software must not be misrepresented* you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is *free and unencumbered software released into the public domain* anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted *the software is provided as is and the author disclaims all warranties* with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("bsl-1.0", "*boost software license* version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("apache-2.0", "licensed under the *apache license version 2 0* the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing *software distributed under the license is distributed on an as is basis* without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-2.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the *gnu general public license* as published by the free software foundation *either version 2 of the license or* at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc"),
    ("gpl-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the *gnu general public license* as published by the free software foundation *either version 3 of the license or* at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("lgpl-2.1-or-later", "this library is free software you can redistribute it and or modify it under the terms of the *gnu lesser general public license* as published by the free software foundation *either version 2 1 of the license or* at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("mpl-2.0", "this source code form is subject to the terms of the *mozilla public license* v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
)

#: ASCII other than digits and letters separates words; A-Z become a-z.
_WORDS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Index:
    """Templates with their postings; idf: word -> inverse document frequency in the corpus."""

    def __init__(self, idf: dict[bytes, float], rare: int = 16, accept: float = 0.5, drift: int = 6):
        self.idf, self.rare, self.accept = idf, rare, accept
        self.base = []
        for phrase, label in BASE.items():
            w = words(phrase)
            anchor = max(range(len(w)), key=lambda k: (idf[w[k]], -k))
            self.base.append((w, anchor, label))
        self.labels, self.key, self.window, self.weight = [], [], [], []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (label, text) in enumerate(TEMPLATES):
            listed, key = [], []
            for k, part in enumerate(text.split("*")):
                w = words(part)
                if k % 2:
                    key.append((len(listed), w))
                listed += w
            for p, w in enumerate(listed):
                self.postings[w].append((t, p))
            self.labels.append(label)
            self.key.append(key)
            #: How far apart the places that a template's hits vote for may be.
            self.window.append(max(3, len(listed) // drift))
            self.weight.append(sum(sorted((idf[w] for w in listed), reverse=True)[:rare]) or 1.0)
        self.vocabulary = set(self.postings) | {w for b in self.base for w in b[0]}

    def scan(self, text: str):
        """(n_words, n_base, first, last, base labels, all labels, score)."""
        ws = words(text)
        where: dict[bytes, list[int]] = {}
        for w in self.vocabulary.intersection(ws):
            where[w] = []
        if where:
            for i, w in enumerate(ws):
                if w in where:
                    where[w].append(i)
        starts, base = [], set()
        for w, anchor, label in self.base:
            for i in where.get(w[anchor], ()):
                if i >= anchor and ws[i - anchor : i - anchor + len(w)] == w:
                    starts.append((i - anchor, len(w)))
                    base.add(label)
        found, score = set(base), float(bool(base))
        if where:
            label, weight = self._templates(ws, where)
            found |= label
            score = max(score, weight)
        return (len(ws), len(starts), min(s for s, _ in starts) if starts else None, max(s for s, _ in starts) if starts else None, ",".join(sorted(base)), ",".join(sorted(found)), score)

    def _templates(self, ws: list[bytes], where: dict[bytes, list[int]]) -> tuple[set[str], float]:
        # each template's rarest words that the file holds, as (word, position)
        chosen: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        for w in sorted(where, key=lambda w: (-self.idf[w], w)):
            for t, p in self.postings.get(w, ()):
                if len(chosen[t]) < self.rare:
                    chosen[t].append((w, p))
        found, best = set(), 0.0
        for t, listed in chosen.items():
            reach = min(1.0, sum(self.idf[w] for w, _ in listed) / self.weight[t])
            if reach < self.accept:  # not even all of them together would do
                best = max(best, reach / 2)
                continue
            hits = sorted((i - p, p, self.idf[w]) for w, p in listed for i in where[w])
            most, good = self._verified(ws, t, hits)
            best = max(best, most if good else min(most, 0.99) / 2)
            if good:
                found.add(self.labels[t])
        return found, best

    def _verified(self, ws: list[bytes], t: int, hits: list[tuple[int, int, float]]) -> tuple[float, bool]:
        """The part of the template's weight in the best window of places that votes fall into, and whether it, or any other that weighs enough, has the key phrases; the best is of those that have, if there are."""
        held: Counter = Counter()
        total, low = 0.0, 0
        most = good = 0.0
        for high, (d, p, x) in enumerate(hits):
            if not held[p]:
                total += x
            held[p] += 1
            while d - hits[low][0] > self.window[t]:
                _, q, y = hits[low]
                held[q] -= 1
                if not held[q]:
                    total -= y
                low += 1
            weight = min(1.0, total / self.weight[t])
            most = max(most, weight)
            if weight >= self.accept and weight > good and all(self._stands(ws, hits[low][0] + at, d + at, key) for at, key in self.key[t]):
                good = weight
        return (good, True) if good else (most, False)

    def _stands(self, ws: list[bytes], low: int, high: int, key: list[bytes]) -> bool:
        """Whether a phrase begins between two places, give or take three words."""
        return any(ws[i] == key[0] and ws[i : i + len(key)] == key for i in range(max(0, low - 3), min(len(ws) - len(key), high + 3) + 1))


def _vocabulary() -> set[bytes]:
    return {w for text in [*BASE, *(t for _, t in TEMPLATES)] for w in words(text)}


def word_idf(df: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """IDF of each licence word over all documents; one entry a vocabulary word, so of fixed size."""
    vocabulary = _vocabulary()

    def run(batches):
        n, held = 0, Counter()
        for rows in batches:
            for (text,) in rows:
                n += 1
                held.update(vocabulary.intersection(words(text)))
        yield [("", n), *((w.decode(), c) for w, c in held.items())]

    counted = map_rows(df.select(text_or_empty(text_col).alias("text")), run, "word string, n long")
    df_of = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = df_of.get("", 0)
    return {w: math.log((total + 1) / (df_of.get(w.decode(), 0) + 1)) + 0.01 for w in vocabulary}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every text."""
    idf = word_idf(df, text_col)

    def run(batches):
        index = Index(idf)
        for rows in batches:
            yield [(k, *index.scan(text)) for k, text in rows]

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(rows, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
