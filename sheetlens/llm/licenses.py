"""License scans over a positional rare-token index.

The index holds, for every word of the license templates, its postings (template, position)
and its inverse document frequency over the whole corpus. Of each template whose key-phrase
words a file holds, the words of highest idf are looked up in it, whatever other templates
the file may hold; postings are intersected by relative position (place in the file
less place in the template), so that words which stand in a template's order gather at one
offset; the best-covered offset of each template is verified by its mandatory key phrases,
which must stand there word by word. Beside it, fixed base phrases are found wherever their
words are consecutive.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import words_of

# Phrases that label a file wherever their words stand consecutively.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, template text, mandatory key phrases. Public license notices.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache license", "in compliance with the license")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "free software foundation")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
)


@dataclass
class RareTokenIndex:
    """Postings of the template words, their idf, and each template's phrases; bounded by the templates.

    ``top`` is the number of words looked up per template, ``coverage`` the least share of
    their idf that must stand in place; words the file lacks count in it too.
    """

    labels: list[str]
    lengths: list[int]
    phrases: list[list[list[bytes]]]
    postings: dict[bytes, list[tuple[int, int]]]
    idf: dict[bytes, float] = field(default_factory=dict)
    top: int = 32
    slack: int = 3
    coverage: float = 0.6

    @classmethod
    def of(cls, templates: Sequence[tuple[str, str, tuple[str, ...]]], **options) -> RareTokenIndex:
        postings = defaultdict(list)
        for t, (_, text, _) in enumerate(templates):
            for p, w in enumerate(words_of(text)):
                postings[w].append((t, p))
        return cls([t[0] for t in templates], [len(words_of(t[1])) for t in templates],
                   [[words_of(p) for p in t[2]] for t in templates], dict(postings), **options)

    def rarest(self, t: int) -> dict[bytes, list[int]]:
        """The words of template ``t`` of highest idf, with their positions."""
        own: dict[bytes, list[int]] = {}
        for w, at in self.postings.items():
            if here := [q for s, q in at if s == t]:
                own[w] = here
        return {w: own[w] for w in sorted(own, key=lambda w: (-self.idf.get(w, 0.0), w))[: self.top]}

    def find(self, words: list[bytes], present: set[bytes]) -> list[tuple[str, float, int]]:
        """(label, share of the template's idf that stands in place, first word) of each template found."""
        shared = self.postings.keys() & present
        candidates = {t for t, phrases in enumerate(self.phrases) if all(w in shared for p in phrases for w in p)}
        if not candidates:
            return []
        rarest = {t: self.rarest(t) for t in sorted(candidates)}
        places = places_of(words, {w for chosen in rarest.values() for w in chosen} & present)
        found = []
        for t, chosen in rarest.items():
            votes: dict[int, set[int]] = defaultdict(set)
            own = {q: self.idf.get(w, 0.0) + 1e-9 for w, at in chosen.items() for q in at}
            for w, at in chosen.items():
                for q in at:
                    for p in places.get(w, ()):
                        votes[p - q].add(q)
            best = (0.0, 0)
            total = sum(own.values())
            for offset in sorted(votes):
                seen = set().union(*(votes.get(o, ()) for o in range(offset - self.slack, offset + self.slack + 1)))
                share = sum(own[q] for q in seen) / total
                if share >= self.coverage and share > best[0]:
                    window = words[max(0, offset - self.slack) : offset + self.lengths[t] + 2 * self.slack]
                    if all(starts(window, phrase) for phrase in self.phrases[t]):
                        best = (share, max(0, offset))
            if best[0]:
                found.append((self.labels[t], min(1.0, best[0]), best[1]))
        return found


def places_of(words: list[bytes], wanted: set[bytes]) -> dict[bytes, list[int]]:
    places = {w: [] for w in wanted}
    for i, w in enumerate(words):
        if w in wanted:
            places[w].append(i)
    return places


def starts(words: list[bytes], phrase: list[bytes], places: Sequence[int] | None = None) -> list[int]:
    """Where the phrase's words stand consecutively; ``places`` are those of its first word, if known."""
    at = [i for i, w in enumerate(words) if w == phrase[0]] if places is None else places
    return [i for i in at if words[i : i + len(phrase)] == phrase]


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those that hold each vocabulary word, over all rows.

    Each task counts its rows; what reaches the driver is bounded by the vocabulary.
    """

    def count(batches):
        seen, n = defaultdict(int), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for w in vocabulary.intersection(words_of(text)):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    got = docs.select(F.col(text).cast("string")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = {bytes(r.word) if r.word is not None else None: r.n for r in got}
    return out.pop(None, 0), out


def build_index(docs: DataFrame, templates=TEMPLATES, text: str = "text", **options) -> RareTokenIndex:
    index = RareTokenIndex.of(templates, **options)
    n, df = document_frequencies(docs, set(index.postings), text)
    index.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in index.postings}
    return index


SCAN_FIELDS = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
               ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()))


def scan(docs: DataFrame, index: RareTokenIndex, base: dict[str, str] = BASE_PHRASES, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``SCAN_FIELDS``.

    Null and empty texts have no words, empty label strings, null places and score 0.
    ``score`` is 1 where a base phrase stands, else the best template's coverage. Columns of
    the same names are replaced; repeated rows give repeated results.
    """
    base_docs = docs.drop(*(n for n, _ in SCAN_FIELDS))
    place = base_docs.columns.index(text)
    phrases = [(words_of(p), label) for p, label in base.items()]
    anchors = {p[0] for p, _ in phrases}
    kinds = {"int64": "bigint", "string": "string", "double": "double"}
    schema = base_docs.select("*", *(F.lit(None).cast(kinds[str(t)]).alias(n) for n, t in SCAN_FIELDS)).schema

    def one(text):
        words = words_of(text)
        present = set(words)
        at: list[int] = []
        labels = set()
        near = [x for x in phrases if present.issuperset(x[0])]
        if near:
            places = places_of(words, anchors & present)
            for phrase, label in near:
                if got := starts(words, phrase, places[phrase[0]]):
                    at += got
                    labels.add(label)
        found = index.find(words, present)
        every = labels | {f[0] for f in found}
        score = 1.0 if labels else max((f[1] for f in found), default=0.0)
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score

    def run(batches):
        for batch in batches:
            rows = list(map(one, batch.column(place).to_pylist()))
            cols = zip(*rows, strict=True) if rows else [[] for _ in SCAN_FIELDS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), t) for c, (_, t) in zip(cols, SCAN_FIELDS, strict=True))], names=schema.names)

    return base_docs.mapInArrow(run, schema)
