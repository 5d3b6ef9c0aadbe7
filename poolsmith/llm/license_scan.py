"""Licence scan by a positional index of rare words.

The index holds, for each word of the licence templates, its postings (template, position). How rare the
words are is counted over all documents first. Then each template whose mandatory words a document has is
looked up by its own rarest words around its first mandatory phrase, the postings are intersected by relative
position (a template is where several words agree on its beginning, give or take DRIFT words), and the
template's mandatory phrases are verified in that place. A place is scored by its own words, so that nothing
else in the text bears on it. Base phrases are found besides, wherever their words stand consecutively.

Defined results: a null text has no words; a null id stays null; repeated rows are scanned each; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsmith.llm.common import table, text_or_empty

# The phrases of the base labels, and licence notices as they are published.
BASE = {"mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, text, mandatory phrases). Paragraphs of licences, notices that files begin with, titles and short references; signs between words don't count.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ["permission is hereby granted", "without restriction"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ["permission is hereby granted", "without restriction"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ["above copyright notice and this permission notice shall be included"]),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", ["the software is provided as is without warranty", "noninfringement"]),
    ("mit", "released under the MIT license", ["mit license"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache license"]),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ["without warranties or conditions of any kind"]),
    ("apache-2", "licensed under the Apache License, Version 2.0", ["apache license version 2"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "version 3"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ["gnu general public license version 3"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "version 2"]),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ["gnu general public license version 2"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ["gnu lesser general public license"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ["gnu lesser general public license version 3"]),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu affero general public license", "version 3"]),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms", "with or without modification"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["this list of conditions and the following disclaimer"]),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ["this software is provided by", "any express or implied warranties"]),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify", "this permission notice appear in all copies"]),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ["disclaims all warranties with regard to this software"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ["mozilla public license v 2"]),
    ("mpl-2", "subject to the terms of the Mozilla Public License, version 2.0", ["mozilla public license version 2"]),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0", ["boost software license version 1"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["will the authors be held liable for any damages arising from the use of this software"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc0", "Creative Commons CC0 1.0 Universal", ["cc0 1 0 universal"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by", "licensed under the Creative Commons Attribution license", ["creative commons attribution license"]),
    ("cc-by", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-nc", "licensed under the Creative Commons Attribution NonCommercial license", ["creative commons attribution noncommercial"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["creative commons attribution noderivatives"]),
]
#: Labels and what stands behind SPDX-License-Identifier for them.
IDENTIFIERS = [("mit", "MIT"), ("apache-2", "Apache-2.0"), ("gpl-2", "GPL-2.0"), ("gpl-3", "GPL-3.0"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3.0"), ("agpl-3", "AGPL-3.0"), ("bsd", "BSD-2-Clause"), ("bsd-3", "BSD-3-Clause"), ("isc", "ISC"), ("mpl-2", "MPL-2.0"), ("epl-2", "EPL-2.0"), ("boost-1", "BSL-1.0"), ("zlib", "Zlib"), ("unlicense", "Unlicense"), ("cc0", "CC0-1.0")]
#: A template's words that are looked up: so many of the rarest.
RAREST, DRIFT, ENOUGH = 12, 2, 0.6

_TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z (after lowering A-Z) and signs beyond ASCII; UTF-8's bytes of the latter are all above it."""
    return text.lower().translate(_TO_WORDS).split()


def places(words: list[bytes], phrase: list[bytes], low: int = 0, high: int | None = None) -> list[int]:
    """Where the phrase stands in words[low:high]."""
    out, high = [], len(words) if high is None else min(high, len(words))
    at = low
    while True:
        try:
            at = words.index(phrase[0], at, high)
        except ValueError:
            return out
        if at + len(phrase) <= high and words[at : at + len(phrase)] == phrase:
            out.append(at)
        at += 1


def _templates() -> list[tuple[str, list[bytes], list[list[bytes]]]]:
    tags = [f"SPDX-License-Identifier: {name}" for _, name in IDENTIFIERS]
    named = [*NOTICES, *((label, tag, [tag]) for (label, _), tag in zip(IDENTIFIERS, tags, strict=True))]
    return [(label, words_of(text.encode()), [words_of(p.encode()) for p in phrases]) for label, text, phrases in named]


#: (label, words, mandatory phrases)
TEMPLATES = _templates()


class Index:
    """Postings of the templates' words, with the words' rarity over the corpus."""

    def __init__(self, documents: int, frequency: dict[str, int]):
        self.idf = {w: math.log((documents + 1) / (frequency.get(w.decode(), 0) + 0.5)) for w in vocabulary()}
        #: Of each template: places of its rare words.
        self.postings: list[dict[bytes, list[int]]] = []
        self.templates, self.weights = [], []
        for label, words, phrases in TEMPLATES:
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))[:RAREST]
            self.postings.append({w: [at for at, x in enumerate(words) if x == w] for w in rare})
            self.templates.append((label, words, phrases))
            self.weights.append(sum(self.weight(w) for w in words if w in rare))
        self.needed = [frozenset(w for p in phrases for w in p) for _, _, phrases in self.templates]
        self.base = [(p.encode().split(), label) for p, label in BASE.items()]

    def weight(self, word: bytes) -> float:
        return max(0.0, self.idf[word]) + 0.1

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], dict[str, float]]:
        """(words, base places, base labels, the method's labels with scores)."""
        words = words_of(text)
        present = vocabulary().intersection(words)
        at, labels, scores = [], set(), {}
        for phrase, label in self.base:
            if present.issuperset(phrase) and (found := places(words, phrase)):
                at += found
                labels.add(label)
        for t in (t for t, need in enumerate(self.needed) if need <= present):
            label, template, phrases = self.templates[t]
            votes: dict[int, dict[int, float]] = defaultdict(dict)
            voted = 0
            for anchor in places(words, phrases[0]):  # what may vote for a beginning whose place holds the phrase
                low, high = anchor + len(phrases[0]) - len(template) - 2 * DRIFT, min(len(words), anchor + len(template) + 2 * DRIFT + 1)
                for i in range(max(0, low, voted), high):
                    for place in self.postings[t].get(words[i], ()):
                        votes[i - place][place] = self.weight(words[i])
                voted = max(voted, high)
            for begin in votes:
                agreed: dict[int, float] = {}
                for d in range(-DRIFT, DRIFT + 1):
                    agreed |= votes.get(begin + d, {})
                low, high = max(0, begin - DRIFT), max(0, begin + len(template) + DRIFT)
                here = set(words[low:high])
                # only words in this place could vote
                most = sum(self.weight(w) for w in template if w in self.postings[t] and w in here)
                score = min(1.0, sum(agreed.values()) / max(most, 1e-9)) * min(1.0, 0.5 + most / self.weights[t])
                if score >= ENOUGH and score > scores.get(label, 0.0) and all(places(words, p, low, high) for p in phrases):
                    scores[label] = score
        return len(words), sorted(at), labels, scores


_vocabulary = frozenset(w for _, words, phrases in TEMPLATES for x in [words, *phrases] for w in x) | {w for p in BASE for w in p.encode().split()}


def vocabulary() -> frozenset[bytes]:
    return _vocabulary


def rarity(docs: DataFrame, text_col: str = "text") -> Index:
    """The index, with document frequencies over all documents; as many rows as there are licence words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                n.update(vocabulary().intersection(words_of(t)))
                n[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {r["word"]: r["n"] for r in counted.collect()}
    return Index(frequency.pop("", 0), frequency)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row."""
    index = rarity(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                n, at, base, scores = index.scan(t)
                rows.append((n, len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(base | set(scores))), 1.0 if base else max(scores.values(), default=0.0)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
