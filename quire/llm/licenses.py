"""License scans by a positional rare-token index.

Every licence phrase and notice is a template: a word sequence with mandatory
key phrases.  The index maps each licence word to its postings (template,
position).  A corpus pass counts, over all documents, how many hold each
licence word; that gives the words' IDF.  Of the licence words that a file
holds, those of the highest IDF among a template's mandatory ones name the
templates to look at.  Where a key phrase stands, the template's voters - its
words of the highest IDF - propose starts by their relative positions; starts
that two voters agree on are verified against all mandatory key phrases and
the share of the template's words that stand at their places, up to DRIFT
words off.

A template has so many voters that two of them stand at their places in every
notice that keeps a LEAST_COVERAGE of its words; so a notice is found whichever
other words are changed.

Words are maximal runs of bytes other than ASCII non-alphanumerics, after A-Z
are lower-cased.  Base phrases verify on all their words standing
consecutively, so every place is found.  Notices verify as said, and give
labels and a coverage score.

Cases: a null or empty text has no words, no labels, score 0.  Repeated rows
and ties need no rule: results depend on one row's text and on document
frequencies, which count every row.  An empty corpus gives an empty result.
Other columns are ignored.  Texts are read whole.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import _arrow_schema, frugal, map_rows, small_batches

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Whole notices from the public texts of the licences: label, text, mandatory key phrases.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2.0", ("apache license", "version 2 0")),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("except in compliance with the license",),
    ),
    ("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    ("gpl-2.0", "gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "gnu general public license version 3", ("gnu general public license", "version 3")),
    (
        "gpl",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("free software", "gnu general public license"),
    ),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software", "gnu general public license")),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("permission is hereby granted", "free of charge"),
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistribution and use", "source and binary forms"),
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("copy modify and or distribute", "with or without fee")),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license",),
    ),
    ("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license", "version 2 0")),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("permission is granted to anyone to use this software", "redistribute it freely"),
    ),
    (
        "bsl-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software",
        ("boost software license",),
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("unencumbered software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
)

#: The share of a notice's words that must stand at their places, and how many words off a place may be.
LEAST_COVERAGE = 0.6
DRIFT = 4

_KEEP = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
FOLD = bytes(b if b >= 0x80 or b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def templates() -> list[tuple[str, tuple[bytes, ...], tuple[tuple[bytes, ...], ...], bool]]:
    """(label, words, key phrases, is base)"""
    cut = lambda s: tuple(words_of(s))
    return [(label, cut(p), (cut(p),), True) for p, label in BASE.items()] + [(label, cut(w), tuple(map(cut, keys)), False) for label, w, keys in NOTICES]


def vocabulary() -> frozenset[bytes]:
    return frozenset(w for _, words, _, _ in templates() for w in words)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> dict[bytes, int]:
    """Over all documents, how many hold each licence word; '' counts the documents.  Its size is that of the fixed vocabulary."""
    schema = "word binary, n long"
    types = _arrow_schema(docs.sparkSession, schema)

    def run(batches):
        known, counts = vocabulary(), {b"": 0}
        for batch in small_batches(batches, text_col):
            for text in batch.column(0).to_pylist():
                counts[b""] += 1
                for w in known.intersection(words_of(text)):
                    counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=types[0].type), pa.array(list(counts.values()), type=types[1].type)], schema=types)

    rows = docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(frugal(run), schema).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


class Index:
    """Postings of licence words; for each template its mandatory words and its voters, by document frequency."""

    def __init__(self, frequencies: dict[bytes, int]):
        total = max(1, frequencies.get(b"", 0))
        self.templates = templates()
        self.vocabulary = vocabulary()
        self.idf = {w: math.log((1 + total) / (1 + frequencies.get(w, 0))) + 1 for w in self.vocabulary}
        self.needed, self.voters, self.phrase = [], [], []
        #: Only templates of whose mandatory words a file holds the rarest are looked at.
        self.by_rarest: dict[bytes, list[int]] = {}
        for i, (_, words, keys, _) in enumerate(self.templates):
            rank = lambda k: (-self.idf[words[k]], k)  # noqa: B023, E731
            self.needed.append(frozenset(w for key in keys for w in key))
            # All but these many words may be changed, and one of the voters besides.
            self.voters.append(sorted(range(len(words)), key=rank)[: int(len(words) * (1 - LEAST_COVERAGE)) + 2])
            key = max(keys, key=lambda key: max(self.idf[w] for w in key))
            self.phrase.append((key, next(k for k in range(len(words)) if words[k : k + len(key)] == key)))
            self.by_rarest.setdefault(max(self.needed[-1], key=lambda w: (self.idf[w], w)), []).append(i)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Base places (start, label), and the method's labels with their scores."""
        held = self.vocabulary.intersection(words)
        looked = [k for w in held & self.by_rarest.keys() for k in self.by_rarest[w] if self.needed[k] <= held]
        if not looked:
            return [], {}
        places: dict[bytes, list[int]] = {w: [] for w in held}
        for i, w in enumerate(words):
            if w in held:
                places[w].append(i)
        base, scores = [], {}
        for k in looked:
            label, sequence, _, is_base = self.templates[k]
            key, at = self.phrase[k]
            rarest = max(range(len(key)), key=lambda j: self.idf[key[j]])
            for p in places[key[rarest]]:
                if p < rarest or tuple(words[p - rarest : p - rarest + len(key)]) != key:
                    continue
                start = p - rarest
                if is_base:
                    base.append((start, label))
                elif (coverage := self._coverage(k, words, places, start - at)) >= LEAST_COVERAGE:
                    scores[label] = max(scores.get(label, 0.0), coverage)
        return sorted(set(base)), scores

    def _coverage(self, k: int, words: list[bytes], places: dict[bytes, list[int]], about: int) -> float:
        """The best coverage of a notice at starts near `about` that two voters agree on and whose key phrases stand."""
        _, sequence, keys, _ = self.templates[k]
        votes = Counter(p - j for j in self.voters[k] for p in _between(places.get(sequence[j], ()), about + j - DRIFT, about + j + DRIFT))
        best = 0.0
        for start in sorted(s for s, n in votes.items() if n > 1):
            around = words[max(0, start - DRIFT) : max(0, start + len(sequence) + DRIFT)]
            if all(_within(key, around) for key in keys):
                there = sum(bool(_between(places.get(w, ()), start + j - DRIFT, start + j + DRIFT)) for j, w in enumerate(sequence))
                best = max(best, there / len(sequence))
        return best


def _between(places, low: int, high: int):
    return places[bisect_left(places, low) : bisect_left(places, high + 1)]


def _within(key: tuple[bytes, ...], words: list[bytes]) -> bool:
    n = len(key)
    return any(tuple(words[i : i + n]) == key for i in range(len(words) - n + 1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: n_words, places array<struct<start, label>> of base phrases, labels map<label, score> of the method's."""
    frequencies = document_frequencies(docs, text_col)

    def make():
        index = Index(frequencies)

        def handle(ids, texts):
            n, places, labels = [], [], []
            for text in texts:
                words = words_of(text)
                base, scores = index.scan(words)
                n.append(len(words))
                places.append([{"start": s, "label": x} for s, x in base])
                labels.append(list(scores.items()))
            return ids, n, places, labels

        return handle

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return map_rows(rows, f"{id_col} long, n_words long, places array<struct<start:long,label:string>>, labels map<string,double>", make, text_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    some = F.size("places") > 0
    starts = F.col("places.start")
    joined = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.map_keys("labels"))))
    best = F.array_max(F.concat(F.map_values("labels"), F.array(F.lit(0.0))))
    return found.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(joined, ",").alias("labels"),
        F.when(some, F.lit(1.0)).otherwise(best).alias("score"),
    )
