"""License scans with a positional rare-token index (operator 10).

The index holds the words of license templates with their positions. A word's IDF is
taken from the scanned texts themselves: one pass counts in how many documents each
template word stands. Of every template the ``rare`` words of highest IDF are posted.
In a text, every place of a posted word votes for (template, start = place - position
in the template); places whose posted words agree on a start are candidates, and a
candidate counts if enough of the template's words stand at their relative positions
and its mandatory key phrase stands inside.

The base phrases are one-window templates all of whose words are mandatory, so the
same lookup finds each of their places exactly.

Nulls and empty texts have no words: zero counts, null places, empty labels, score 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import plain_words

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, template (opening words of public license notices), mandatory key phrase.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files", "permission is hereby granted"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license", "in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license",
     "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     "and or distribute this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "unencumbered software"),
)


@dataclass
class Index:
    postings: dict[bytes, list[tuple[int, int]]]  # rare word -> (template, position in it)
    templates: list[tuple[str, list[bytes], list[bytes], bool]]  # label, words, key phrase, is a base phrase
    weights: dict[bytes, float]
    posted: list[int] = field(default_factory=list)  # posted words of each template


def _templates(phrases, templates):
    base = [(label, p.encode().split(), p.encode().split(), True) for p, label in phrases.items()]
    return base + [(label, t.encode().split(), k.encode().split(), False) for label, t, k in templates]


def build_index(document_counts: dict[bytes, int], n_docs: int, rare: int = 3, phrases=None, templates=None) -> Index:
    """Post the ``rare`` words of highest IDF of each template."""
    known = _templates(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    idf = {w: math.log((n_docs + 1) / (document_counts.get(w, 0) + 1)) + 1e-3 for _, ws, _, _ in known for w in ws}
    postings: dict[bytes, list[tuple[int, int]]] = {}
    posted = []
    for t, (_, words, _, base) in enumerate(known):
        chosen = sorted(set(words), key=lambda w: (-idf[w], w))[:1 if base else rare]
        posted.append(sum(w in chosen for w in words))
        for position, word in enumerate(words):
            if word in chosen:
                postings.setdefault(word, []).append((t, position))
    return Index(postings, known, idf, posted)


def contains(words: list[bytes], phrase: list[bytes], start: int, end: int) -> bool:
    """Does ``phrase`` stand in ``words[start:end]``?"""
    m = len(phrase)
    return any(words[i:i + m] == phrase for i in range(max(start, 0), min(end, len(words)) - m + 1))


def scan(words: list[bytes], index: Index, least: float = 0.6):
    """Base places (rising starts and labels) and template matches {label: share of IDF weight matched}."""
    if index.postings.keys().isdisjoint(words):
        return [], {}
    votes: dict[tuple[int, int], int] = {}
    find = index.postings.get
    for place, word in enumerate(words):
        for t, position in find(word, ()):
            votes[t, place - position] = votes.get((t, place - position), 0) + 1
    places, labels = [], {}
    for (t, start), n in votes.items():
        label, template, key, base = index.templates[t]
        if base:
            if n == index.posted[t] and start >= 0 and words[start:start + len(template)] == template:
                places.append((start, label))
                labels[label] = 1.0
            continue
        if 2 * n < index.posted[t] or labels.get(label, 0.0) >= 1.0:
            continue
        weight = sum(index.weights[w] for i, w in enumerate(template)
                     if 0 <= start + i < len(words) and words[start + i] == w)
        share = weight / sum(index.weights[w] for w in template)
        if share >= least and contains(words, key, start, start + len(template)):
            labels[label] = max(labels.get(label, 0.0), share)
    return sorted(places), labels


def document_counts(docs: DataFrame, text_col: str = "text", templates=None, phrases=None) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word stands; as many rows as there are template words."""
    vocabulary = {w for _, ws, _, _ in _templates(PHRASES if phrases is None else phrases,
                                                  TEMPLATES if templates is None else templates) for w in ws}

    def counted(batches):
        total: dict[bytes, int] = {}
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                for word in vocabulary.intersection(plain_words(text)):
                    total[word] = total.get(word, 0) + 1
        yield pa.RecordBatch.from_pandas(pd.DataFrame({
            "word": [w.decode() for w in total] + [""], "n": [*total.values(), n]}), preserve_index=False)

    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    found = {r["word"].encode(): r["n"] for r in rows}
    n_docs = found.pop(b"", 0)
    return found, n_docs


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 3, least: float = 0.6,
           phrases=None, templates=None) -> DataFrame:
    """One row per document: word and place counts, labels found, and the best match's score."""
    kind = docs.schema[id_col].dataType.simpleString()
    index = build_index(*document_counts(docs, text_col, templates, phrases), rare, phrases, templates)

    def found(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = plain_words(text)
                places, labels = scan(words, index, least)
                rows.append((len(words), len(places), places[0][0] if places else None,
                             places[-1][0] if places else None, ",".join(sorted({x for _, x in places})),
                             ",".join(sorted(labels)), min(1.0, max(labels.values(), default=0.0))))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(found, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
                                  "base_labels string, labels string, score double")
