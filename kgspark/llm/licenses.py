"""Licence scan with a positional index of rare licence words.

Words are weighted by inverse document frequency over the corpus.  The index posts, for each template, its rarest words
with their positions: as many as hold more than the weight that a match may lack, so that no match goes without one of
them.  A file's licence words are looked up rarest first; each posting votes for the place where its template would
begin, and the places voted for are the only candidates.  A candidate is accepted if the template's mandatory phrases
stand there and enough of its weight is found in order.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_alnum_words, over_batches, text_bytes


@dataclass(frozen=True)
class Template:
    """A licence's label, a text that tells of it and phrases that must stand in it."""

    label: str
    text: str
    mandatory: tuple[str, ...]


#: Least share of a template's weight that must be found, and how many places off its own a word may stand.
LEAST, SLACK = 0.7, 4

# Base phrases and their labels (fixed values): found wherever the words stand consecutively.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Texts of whole licences and notices (fixed values, from the public licence texts).
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    + _WARRANTY
    + " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_2 = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_3 = _BSD_2 + " 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
    "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
    "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
)
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_GRANT, _FORMS = "permission is hereby granted free of charge", "redistribution and use in source and binary forms"

TEMPLATES = (
    Template("mit", _MIT, (_GRANT, "this permission notice shall be included")),
    Template("bsd", _BSD_2, (_FORMS, "redistributions in binary form must reproduce")),
    Template("bsd", _BSD_3, (_FORMS, "endorse or promote products derived from this software")),
    Template("isc", _ISC, ("for any purpose with or without fee",)),
    Template("zlib", _ZLIB, ("the origin of this software must not be misrepresented",)),
    Template("unlicense", _UNLICENSE, ("free and unencumbered software",)),
    Template("apache", _APACHE, ("you may not use this file except in compliance",)),
    Template("gpl", _GPL.format("", "2"), ("gnu general public license as published by the free software foundation",)),
    Template("gpl", _GPL.format("", "3"), ("gnu general public license as published by the free software foundation",)),
    Template("lgpl", _GPL.format("lesser ", "3"), ("gnu lesser general public license as published by the free software foundation",)),
    Template("agpl", _GPL.format("affero ", "3"), ("gnu affero general public license as published by the free software foundation",)),
    # opening clauses and notices of one line
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("you may not use this file except in compliance",)),
    Template("apache", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("terms and conditions for use reproduction and distribution",)),
    Template("apache", "licensed under apache 2 0", ("licensed under apache",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Template("gpl", "licensed under gpl", ("licensed under gpl",)),
    Template("gpl", "licensed under the gpl", ("licensed under the gpl",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "released under the bsd license", ("bsd license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("proprietary", "all rights reserved", ("all rights reserved",)),
)


@dataclass
class Index:
    """Words of each template, weights of all words, and postings of each template's rare words: word -> (template, position)."""

    words: list[list[bytes]]
    mandatory: list[list[list[bytes]]]
    labels: list[str]
    postings: dict[bytes, list[tuple[int, int]]]
    weights: dict[bytes, float]
    base: list[tuple[list[bytes], str]]
    vocabulary: frozenset[bytes]

    def total(self, t: int) -> float:
        return sum(self.weights[w] for w in self.words[t])


def build(n_docs: int, doc_freq: dict[bytes, int], templates=TEMPLATES, base=BASE) -> Index:
    words = [lower_alnum_words(t.text.encode()) for t in templates]
    weights = {w: math.log((n_docs + 1) / (doc_freq.get(w, 0) + 1)) + 0.01 for ws in words for w in ws}
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for t, ws in enumerate(words):
        spare, at = (1 - LEAST) * sum(weights[w] for w in ws) + 1e-9, Counter(ws)
        for w in sorted(at, key=lambda w: (-weights[w], w)):
            postings[w] += [(t, i) for i, x in enumerate(ws) if x == w]
            spare -= weights[w] * at[w]
            if spare < 0:
                break
    phrases = [(lower_alnum_words(p.encode()), label) for p, label in base]
    mandatory = [[lower_alnum_words(p.encode()) for p in t.mandatory] for t in templates]
    vocabulary = frozenset(weights) | {w for ws, _ in phrases for w in ws} | {w for ps in mandatory for p in ps for w in p}
    return Index(words, mandatory, [t.label for t in templates], dict(postings), weights, phrases, vocabulary)


def _starts(phrase: list[bytes], places: dict[bytes, list[int]]) -> list[int]:
    """Where the phrase's words stand consecutively, from their position lists, the rarest first."""
    if any(w not in places for w in phrase):
        return []
    order = sorted(range(len(phrase)), key=lambda i: len(places[phrase[i]]))
    found = {p - order[0] for p in places[phrase[order[0]]]}
    for i in order[1:]:
        found &= {p - i for p in places[phrase[i]]}
    return sorted(found)


def found_weight(template: list[bytes], start: int, sets: dict[bytes, set[int]], weights: dict[bytes, float]) -> float:
    """Weight of the template's words that stand where they would if it began at ``start``, SLACK places off at most."""
    return sum(weights[w] for i, w in enumerate(template) if w in sets and any(start + i + k in sets[w] for k in range(-SLACK, SLACK + 1)))


def match(words: list[bytes], index: Index) -> tuple[list[int], set[str], set[str], float]:
    """Base places, base labels, all labels and the best score of one file's words.

    A word may stand SLACK places off its own for words put in or left out; LEAST of the template's weight must be found.
    A base phrase scores 1.
    """
    vocabulary = index.vocabulary
    places: dict[bytes, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if w in vocabulary:
            places[w].append(i)
    at: list[int] = []
    base_labels: set[str] = set()
    for phrase, label in index.base:
        if got := _starts(phrase, places):
            at += got
            base_labels.add(label)
    labels, score = set(base_labels), 1.0 if base_labels else 0.0
    votes: dict[int, Counter[int]] = defaultdict(Counter)
    for w in sorted(index.postings.keys() & places.keys(), key=lambda w: (-index.weights[w], w)):
        for t, i in index.postings[w]:
            for p in places[w]:
                votes[t][p - i] += index.weights[w]
    for t in sorted(votes):
        phrase_starts = [_starts(p, places) for p in index.mandatory[t]]
        if not all(phrase_starts):
            continue
        template = index.words[t]
        total, sets, best = index.total(t), {w: set(places[w]) for w in template if w in places}, 0.0
        for start, _ in sorted(votes[t].items(), key=lambda x: (-x[1], x[0])):
            if not all(any(start - SLACK <= p <= start + len(template) + SLACK for p in ps) for ps in phrase_starts):
                continue
            best = max(best, found_weight(template, start, sets, index.weights))
            if best >= total:
                break
        if best >= LEAST * total:
            labels.add(index.labels[t])
            score = max(score, min(1.0, best / total))
    return at, base_labels, labels, score


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many each licence word stands; the table is as long as the vocabulary."""

    def rows_of(batch):
        counts: Counter[bytes] = Counter()
        n = 0
        for data in batch.column("__bytes").to_pylist():
            counts.update(vocabulary.intersection(lower_alnum_words(data)))
            n += 1
        return {"word": [None, *(w.decode() for w in counts)], "n": [n, *counts.values()]}

    parts = over_batches(docs.select(text_bytes().alias("__bytes")), rows_of, "word string, n bigint")
    got = {r["word"]: r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(None, 0), {w.encode(): n for w, n in got.items()}


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    Null or empty texts have no words, no labels (empty strings) and score 0.  Other columns are ignored; repeated
    rows are treated alike, and each counts in the frequencies.
    """
    n, frequencies = document_frequencies(docs, build(0, {}, templates, base).vocabulary)
    index = build(n, frequencies, templates, base)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"

    def rows_of(batch):
        out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for data in batch.column("__bytes").to_pylist():
            words = lower_alnum_words(data)
            at, base_labels, labels, score = match(words, index)
            row = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)
            for column, x in zip(out.values(), row, strict=True):
                column.append(x)
        return {"doc_id": batch.column("doc_id")} | out

    return over_batches(docs.select("doc_id", text_bytes().alias("__bytes")), rows_of, schema)
