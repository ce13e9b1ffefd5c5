"""Licence notices by a positional index of their rarest words.

Templates are short notices. Over all documents it is counted how many hold
each template word; a template is indexed by the positions of its rarest words.
A document looks up all indexed words it holds; each occurrence and each posting
give the place where the template would begin, and places named by several rare
words are aligned. A template counts if at such a place its
mandatory phrases stand where they belong. The alignment's share of matching
words, weighted by IDF, is the score.

Beside that, every place of the base phrases is reported.

Defined results: a null or empty text has no words, no labels and score 0; equal
rows get equal results; null ids are kept; an empty table gives no rows (and
equal weights to all words); further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import words as w
from tapeloom.llm.base import chunks, query, table, texts, utf8

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Template(NamedTuple):
    """A notice, and phrases of it that must stand at their places."""

    label: str
    text: str
    mandatory: tuple[str, ...]


TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the license "
             "you may obtain a copy of the license at http www apache org licenses license 2 0",
             ("in compliance with the license", "apache org licenses license 2 0")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
             "and associated documentation files the software to deal in the software without restriction",
             ("permission is hereby granted", "to deal in the software without restriction")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             ("gnu general public license", "version 3")),
    Template("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license "
             "as published by the free software foundation either version 2 of the license",
             ("gnu general public license", "free software foundation", "version 2")),
    Template("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license "
             "as published by the free software foundation either version 3 of the license",
             ("gnu general public license", "free software foundation", "version 3")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc0-1.0", "licensed under cc0 1 0 universal", ("cc0 1 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license", "v 2 0")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
             "is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software", "public domain")),
)
#: Rare words a template is indexed by.
INDEXED = 4
#: An alignment needs so many of the template's indexed words (all, if it has fewer).
VOTES = 2


class Index(NamedTuple):
    """Templates as hash sequences and the postings of their rare words."""

    sequences: list[np.ndarray]
    weights: list[np.ndarray]
    #: per template, positions that mandatory phrases cover, in runs
    mandatory: list[np.ndarray]
    labels: list[str]
    votes: np.ndarray
    #: sorted hashes of the indexed words, and their postings
    words: np.ndarray
    first: np.ndarray
    post_template: np.ndarray
    post_place: np.ndarray
    phrases: list[tuple[np.ndarray, str]]


def hashed(text: str) -> np.ndarray:
    return np.array([w.hash_text(x) for x in text.split()], np.uint64)


def vocabulary(templates: tuple[Template, ...]) -> dict[int, str]:
    return {w.hash_text(x): x for t in templates for x in t.text.split()}


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, and where each text's words begin."""
    data, offsets = utf8(column)
    lower = w.LOWER[data]
    found = w.find_words(lower, offsets, w.ALNUM)
    return w.hash_words(lower, found), found.first


def document_counts(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[dict[int, int], int]:
    """Documents that hold each template word, and documents in all.

    Every task sends one count per template word, whatever its input.
    """
    known = np.array(sorted(vocabulary(templates)), np.uint64)

    def count(batches: Iterator[pa.RecordBatch]):
        held, rows = np.zeros(len(known), np.int64), 0
        for batch in chunks(batches):
            hashes, first = word_hashes(batch.column("text"))
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes)
            owner = np.searchsorted(first, hit, side="right") - 1
            pairs = np.unique(owner * len(known) + at[hit])
            held += np.bincount(pairs % len(known), minlength=len(known))
            rows += batch.num_rows
        yield pa.record_batch({
            "word": pa.array([*range(len(known)), -1], pa.int64()), "n": pa.array([*held, rows], pa.int64())})

    totals = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"]: r["n"] for r in totals.collect()}
    return {int(h): got.get(i, 0) for i, h in enumerate(known)}, got.get(-1, 0)


def build_index(templates: tuple[Template, ...], held: dict[int, int], rows: int) -> Index:
    idf = {h: math.log((rows + 1) / (n + 1)) + 1 for h, n in held.items()}
    sequences = [hashed(t.text) for t in templates]
    weights = [np.array([idf[int(h)] for h in s]) for s in sequences]
    mandatory, votes, postings = [], [], []
    for k, (t, sequence) in enumerate(zip(templates, sequences)):
        need = []
        for phrase in t.mandatory:
            p = hashed(phrase)
            start = next(i for i in range(len(sequence)) if np.array_equal(sequence[i:i + len(p)], p))
            need.extend(range(start, start + len(p)))
        mandatory.append(np.array(need))
        rare = sorted({int(h) for h in sequence}, key=lambda h: (-idf[h], h))[:INDEXED]
        votes.append(min(VOTES, len(rare)))
        postings += [(h, k, i) for i, h in enumerate(map(int, sequence)) if h in rare]
    postings.sort()
    keys = np.array([p[0] for p in postings], np.uint64)
    words, first = np.unique(keys, return_index=True)
    return Index(
        sequences, weights, mandatory, [t.label for t in templates], np.array(votes), words,
        np.append(first, len(keys)), np.array([p[1] for p in postings]), np.array([p[2] for p in postings]),
        [(hashed(p), label) for p, label in BASE.items()])


def alignments(text: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """``(template, place)`` pairs that enough rare words of the text agree on."""
    at = np.minimum(np.searchsorted(index.words, text), len(index.words) - 1)
    hit = np.flatnonzero(index.words[at] == text)
    if not len(hit):
        return []
    which = at[hit]
    size = index.first[which + 1] - index.first[which]
    post = np.repeat(index.first[which] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    template = index.post_template[post]
    place = np.repeat(hit, size) - index.post_place[post]
    pairs, n = np.unique(np.stack([template, place]), axis=1, return_counts=True)
    return [(int(t), int(p)) for t, p in pairs[:, n >= index.votes[pairs[0]]].T]


def method_labels(text: np.ndarray, index: Index) -> tuple[set[str], float]:
    """Labels of the verified alignments and the best score."""
    labels, best = set(), 0.0
    for k, place in alignments(text, index):
        sequence = index.sequences[k]
        there = np.zeros(len(sequence), bool)
        # a notice may begin before the text does, or end behind it
        low, high = max(0, place), min(len(text), place + len(sequence))
        there[low - place:high - place] = text[low:high] == sequence[low - place:high - place]
        if there[index.mandatory[k]].all():
            labels.add(index.labels[k])
            best = max(best, float(index.weights[k][there].sum() / index.weights[k].sum()))
    return labels, min(best, 1.0)


def base_places(text: np.ndarray, index: Index) -> dict[str, np.ndarray]:
    """Starts of every base phrase, by label."""
    out = {}
    for phrase, label in index.phrases:
        starts = np.flatnonzero(text == phrase[0])
        for k in range(1, len(phrase)):
            starts = starts[starts + k < len(text)]
            starts = starts[text[starts + k] == phrase[k]]
        if len(starts):
            out[label] = starts
    return out


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document with the columns of :data:`RESULT`."""
    docs = texts(docs, id_col, text_col)
    index = build_index(templates, *document_counts(docs, templates))
    telling = np.unique(np.concatenate([index.words, *[p[0][:1] for p in index.phrases]]))

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in chunks(batches):
            hashes, first = word_hashes(batch.column("text"))
            at = np.minimum(np.searchsorted(telling, hashes), len(telling) - 1)
            hits = np.flatnonzero(telling[at] == hashes)
            owners = set((np.searchsorted(first, hits, side="right") - 1).tolist())
            rows = []
            for d in range(batch.num_rows):
                n = int(first[d + 1] - first[d])
                if d not in owners:
                    rows.append((n, 0, None, None, "", "", 0.0))
                    continue
                text = hashes[first[d]:first[d + 1]]
                base = base_places(text, index)
                found, score = method_labels(text, index)
                places = np.concatenate([*base.values(), np.empty(0, np.int64)])
                rows.append((
                    n, len(places), int(places.min()) if len(places) else None,
                    int(places.max()) if len(places) else None, ",".join(sorted(base)),
                    ",".join(sorted(found | set(base))), max(score, 0.5 if base else 0.0)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(RESULT)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=RESULT)

    return docs.mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")


@query("op8_licence_scan")
def op8(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"))
