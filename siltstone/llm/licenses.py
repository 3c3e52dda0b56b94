"""License scans with a positional index of rare words.

Document frequencies of the templates' words are counted over all documents. Each template posts its places with the words of highest IDF,
so many that no match of ``MATCH`` or more can miss all of them. All posted words of a document are looked up; every hit names a (template,
start) by its relative position, and a start is accepted where the template's words match there well enough and its mandatory key phrases
stand at or near their places. So which labels are found does not depend on the IDF, which only keeps the number of starts low. The posting
lists and the word table are bounded by the templates, which are parameters, not by the data.

Base phrases are found exactly beside it and their labels always stay.

Defined cases: a null or empty text has no words, no labels and score 0; very long texts are read whole; repeated rows repeat in the result; labels are
sets, so ties between places do not matter; an empty table gives no rows; a kept column with the name of one of the operator's own gives way to it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import documents, unused

#: The base phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short public licence notices (label, notice, key phrases that must be there).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ["apache license", "version 2 0"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2", ["general public license", "version 2"]),
    ("gpl-3.0", "You should have received a copy of the GNU General Public License along with this program, version 3", ["general public license", "version 3"]),
    ("lgpl-2.1", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1", ["lesser general public license"]),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ["affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["permission to use", "with or without fee"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", ["cc by nc nd 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal", ["cc0 1 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: Share of a template's words that must stand at their places.
MATCH = 0.8
#: Words that a key phrase may be off its place.
SLACK = 2

#: Bytes to lower-case letters, digits and bytes over 0x7F; all others to a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of a phrase in a list of words."""
    n, out, i = len(phrase), [], -1
    try:
        while True:
            i = words.index(phrase[0], i + 1)
            if words[i : i + n] == phrase:
                out.append(i)
    except ValueError:
        return out


class Index:
    """Postings of the templates' words; ``frequency`` holds the number of documents with each of these words."""

    def __init__(self, templates, phrases, frequency: dict[bytes, int], n_docs: int):
        self.templates = [(label, words_of(text), [words_of(k) for k in keys]) for label, text, keys in templates]
        self.key_at = [[places(words, k)[0] if places(words, k) else None for k in keys] for _, words, keys in self.templates]
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for _, words, _ in self.templates for w in words}
        self.postings = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            may_differ = max(d for d in range(len(words)) if len(words) - d >= MATCH * len(words)) if words else -1
            for i in sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], i))[: may_differ + 1]:
                self.postings[words[i]].append((t, i))
        self.weight = [sum(self.idf[w] for w in words) for _, words, _ in self.templates]

    def keys_hold(self, words: list[bytes], t: int, start: int) -> bool:
        _, _, keys = self.templates[t]
        for key, at in zip(keys, self.key_at[t]):
            lo = max(0, start + (at or 0) - SLACK)
            hi = start + (at or 0) + SLACK + len(key)
            if at is None:
                lo, hi = 0, len(words)
            if not places(words[lo:hi], key):
                return False
        return True

    def scan(self, words: list[bytes]):
        """(number of base places, first, last, base labels, all labels, score)"""
        base, labels = [], set()
        for phrase, label in self.phrases:
            if found := places(words, phrase):
                base += found
                labels.add(label)
        all_labels, score = set(labels), 1.0 if labels else 0.0
        if not self.postings.keys().isdisjoint(words):
            starts = {(t, i - p) for i, w in enumerate(words) if w in self.postings for t, p in self.postings[w]}
            for t, start in starts:
                label, template, _ = self.templates[t]
                at = words[start : start + len(template)] if start >= 0 else [b""] * -start + words[: start + len(template)]
                same = [w for w, x in zip(template, at) if w == x]
                if len(same) >= MATCH * len(template) and self.keys_hold(words, t, start):
                    all_labels.add(label)
                    score = max(score, sum(self.idf[w] for w in same) / self.weight[t] if self.weight[t] else len(same) / len(template))
        return len(base), min(base, default=None), max(base, default=None), labels, all_labels, min(1.0, score)


def frequencies(docs: DataFrame, text: str, templates) -> tuple[dict[bytes, int], int]:
    """Number of documents with each word of the templates, and of all documents. The result is bounded by the templates."""
    vocabulary = frozenset(w for _, t, _ in templates for w in words_of(t))

    def run(batches):
        found, rows = Counter(), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(vocabulary.intersection(words_of(t)))
            rows += batch.num_rows
        names = [b"", *found]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([rows, *(found[w] for w in names[1:])], pa.int64())], names=["word", "n"])

    got = {bytes(r.word): r.n for r in docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop(b"", 0)


def scan_licenses(docs: DataFrame, *keep: str, text: str = "text", templates=tuple(TEMPLATES), phrases=None) -> DataFrame:
    """Rows (keep, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    frequency, n_docs = frequencies(docs, text, templates)
    phrases = dict(PHRASES if phrases is None else phrases)
    own = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [x.split()[0] for x in own.split(", ")]
    rows = docs.select(*(c for c in keep if c not in names), F.col(text).alias(unused(keep, "_text")))
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:-1]), own])

    def run(batches):
        index = Index(templates, phrases, frequency, n_docs)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                words = words_of(t)
                n, first, last, base, labels, score = index.scan(words)
                out.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, types))], names=[*batch.schema.names[:-1], *(x.split()[0] for x in own.split(", "))])

    return rows.mapInArrow(run, schema)


def op4_license_scan(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir), "doc_id")


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
