"""Licence scan by a positional index of rare words.

Templates are short licence notices, each with mandatory key phrases. The words of all templates are counted
over all documents first. Of each key phrase the word with the highest inverse document frequency is its
anchor; an index lists the anchors' places (template, offset). A file's anchor words are looked up, each hit
fixes where the template would begin, and the other template words have to stand at the same relative
places: their share, weighted by inverse document frequency, is the coverage. A template counts if its
coverage is at least ``MIN_COVERAGE`` and every key phrase stands word by word within ``SLACK`` words of the
aligned place.

Base labels come from four phrases, wherever their words stand consecutively. Both passes read whole texts;
nothing but the word counts of the template vocabulary (a fixed, small list) is gathered.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows each get their row;
several equal notices count each place; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, prepare
from tidemark.llm.textvec import ALNUM, LOWER, blocks, phrase_hashes

# The phrases and labels of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices in words, and the phrases each of them must hold.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     ("gnu general public license", "version 3 of the license")),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3.0", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("mit-notice", "released under the mit license", ("under the mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge", "associated documentation files")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify and or distribute",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc0-1.0", "released under cc0 1 0 universal", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
]

MIN_COVERAGE = 0.6
SLACK = 4
OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, evidence string"


def vocabulary(templates) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and how many hold each word; partial counts by batch, summed by Spark."""
    known = np.concatenate([phrase_hashes(w) for w in words])
    order = np.argsort(known)
    ranked = known[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, np.zeros(len(ranked), np.int64)
        for batch in batches:
            total += batch.num_rows
            for block in blocks(batch.column(0)):
                w = block.words(ALNUM, LOWER[block.data])
                h = w.hashes()
                at = np.searchsorted(ranked, h)
                at[at == len(ranked)] = 0
                hit = np.flatnonzero(ranked[at] == h)
                pairs = np.unique(w.doc[hit] * len(ranked) + at[hit])
                sums += np.bincount(pairs % len(ranked), minlength=len(ranked))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *order.tolist()], pa.int32()), pa.array([total, *sums.tolist()], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(lean(count), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: r["n"] for r in rows}
    return got.get(-1, 0), {w: got.get(k, 0) for k, w in enumerate(words)}


class RareIndex:
    """Anchors of the templates' key phrases and where they stand."""

    def __init__(self, templates, idf: dict[str, float]):
        self.names = [t[0] for t in templates]
        self.words = [phrase_hashes(t[1]) for t in templates]
        self.weights = [np.array([idf[w] for w in t[1].split()]) for t in templates]
        self.keys = [[phrase_hashes(k) for k in t[2]] for t in templates]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (_, text, keys) in enumerate(templates):
            words = text.split()
            for anchor in {max(k.split(), key=lambda w: (idf[w], w)) for k in keys}:
                for q, w in enumerate(words):
                    if w == anchor:
                        self.postings.setdefault(int(phrase_hashes(w)[0]), []).append((t, q))
        self.anchors = np.array(sorted(self.postings), np.uint64)

    def match(self, h: np.ndarray, places: np.ndarray) -> dict[str, float]:
        """Labels and best coverage of one text with word hashes h and anchors at places."""
        found: dict[str, float] = {}
        for t, start in dict.fromkeys((t, int(p) - q) for p in places for t, q in self.postings[int(h[p])]):
            want, weights = self.words[t], self.weights[t]
            lo, hi = max(0, start), min(len(h), start + len(want))
            cover = float(weights[lo - start : hi - start][h[lo:hi] == want[lo - start : hi - start]].sum() / weights.sum())
            if cover >= MIN_COVERAGE and all(len(places_of(h[max(0, start - SLACK) : start + len(want) + SLACK], k)) for k in self.keys[t]):
                found[self.names[t]] = max(cover, found.get(self.names[t], 0.0))
        return found


def places_of(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of phrase stand consecutively in h."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    return at


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, word and base phrase counts, labels, score, and evidence (label:coverage) of every document."""
    prepare(docs.sparkSession)
    words = vocabulary(templates)
    n, df = document_frequencies(docs, words)
    index = RareIndex(templates, {w: math.log((1 + n) / (1 + df[w])) + 1 for w in words})
    phrases = [(phrase_hashes(p), p.encode().split(), label) for p, label in base.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield scan_block(batch.column(0).slice(block.first, block.n), block, index, phrases)

    return docs.select("doc_id", "text").mapInArrow(lean(run), OUT)


def scan_block(ids: pa.Array, block, index: RareIndex, phrases) -> pa.RecordBatch:
    data = LOWER[block.data]
    w = block.words(ALNUM, data)
    h, doc = w.hashes(), w.doc
    n_base = np.zeros(block.n, np.int64)
    first, last = np.full(block.n, np.iinfo(np.int64).max), np.full(block.n, -1)
    labels: dict[int, set[str]] = {}
    for hashes, plain, label in phrases:
        at = places_of(h, hashes)
        at = at[doc[at] == doc[at + len(hashes) - 1]] if len(at) else at
        at = np.array([p for p in at if [data[w.start[p + k] : w.end[p + k]].tobytes() for k in range(len(plain))] == plain], np.int64)
        own, place = doc[at], at - w.first[doc[at]]
        np.add.at(n_base, own, 1)
        np.minimum.at(first, own, place)
        np.maximum.at(last, own, place)
        for d in np.unique(own):
            labels.setdefault(int(d), set()).add(label)
    found: dict[int, dict[str, float]] = {}
    anchors = np.flatnonzero(np.isin(h, index.anchors))
    for d in np.unique(doc[anchors]):
        lo, hi = w.first[d], w.first[d + 1]
        got = index.match(h[lo:hi], anchors[(anchors >= lo) & (anchors < hi)] - lo)
        if got:
            found[int(d)] = got
    empty = n_base == 0
    base_text = [",".join(sorted(labels.get(d, ()))) for d in range(block.n)]
    all_text = [",".join(sorted(labels.get(d, set()) | found.get(d, {}).keys())) for d in range(block.n)]
    score = [max([0.5 * (not empty[d]), *found.get(d, {}).values()]) for d in range(block.n)]
    evidence = [",".join(f"{k}:{v:.3f}" for k, v in sorted(found.get(d, {}).items())) for d in range(block.n)]
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array(w.count, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64(), mask=empty), pa.array(last, pa.int64(), mask=empty),
         pa.array(base_text, pa.string()), pa.array(all_text, pa.string()), pa.array([min(1.0, float(x)) for x in score], pa.float64()), pa.array(evidence, pa.string())],
        ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "evidence"],
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("evidence")
