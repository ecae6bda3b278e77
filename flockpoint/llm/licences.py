"""Licence scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a line, or lines without a blank one between them where a notice is wrapped over them. Its features are the word 1- to 3-grams that occur in any licence template, so a
paragraph that shares none costs nothing beyond hashing its words, plus the share of its n-grams that
do. A softmax over the licence families and ``unknown`` is trained on altered templates and on paragraphs of
the corpus; its temperature is fitted on held-out ones, so that the class shares are calibrated. A predicted family
counts only if the words of one of its templates are there in order, which the template comparison confirms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import sample_by_label
from .textbytes import Texts, blocks, mix, span_hashes, sums_by

UNKNOWN = "unknown"

#: Usual notices of public licences, by SPDX name.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU GPL v2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD-3-Clause": [
        "Released under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "All-Rights-Reserved": [
        "All rights reserved.",
        "No part of this publication may be reproduced without written permission of the publisher.",
    ],
}

_WORD = np.zeros(256, bool)
_WORD[48:58] = True
_WORD[97:123] = True
_WORD[128:] = True


def _paragraphs(texts: Texts):
    """Hashes of lower-case alphanumeric words, and the words' bounds of every line with the line's text."""
    data = texts.lowered()
    step = np.diff(_WORD[data].view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    stops = np.flatnonzero(data == 10)
    first = np.concatenate([[0], np.searchsorted(start, stops)])
    owner = np.searchsorted(texts.starts, stops, "right") - 1
    return span_hashes(data, start, end), first, owner


def _grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside lines and the line of each."""
    line = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(line[: len(h) - n + 1] == line[n - 1 :])
    odd = [np.uint64((0x8EBC6AF09C88C6E3 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF) for i in range(n)]
    return mix(sum((h[inside + i] * odd[i] for i in range(n)), np.uint64(n))), line[inside]


def _lines(texts: list[str]):
    column = Texts(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()))
    h, first, _ = _paragraphs(column)
    return h, first


@dataclass
class Scanner:
    """``vocabulary``: sorted n-gram hashes of the templates; ``weights`` a row for each, one for their share, and a bias."""

    families: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    temperature: float
    templates: dict[str, list[np.ndarray]]
    least: float

    def __post_init__(self):
        each = [(f, t) for f, ts in self.templates.items() for t in ts]
        self.of = np.array([self.families.index(f) for f, _ in each])
        self.pairs = np.unique(np.concatenate([t for _, t in each]))
        self.table = np.stack([np.bincount(np.searchsorted(self.pairs, t), minlength=len(self.pairs)) / len(t) for _, t in each], 1)

    def features(self, h: np.ndarray, first: np.ndarray):
        """Lines with a known n-gram: their (line, column) pairs and the share of known n-grams of each line."""
        lines, columns = [], []
        total = np.zeros(len(first) - 1)
        for n in (1, 2, 3):
            g, line = _grams(h, first, n)
            total += np.bincount(line, minlength=len(total))
            at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == g
            lines.append(line[known])
            columns.append(at[known])
        line, column = np.concatenate(lines), np.concatenate(columns)
        share = np.bincount(line, minlength=len(total)) / np.maximum(total, 1)
        pair = np.unique(line * len(self.vocabulary) + column)
        return pair // len(self.vocabulary), pair % len(self.vocabulary), share

    def shares(self, line, column, share, lines) -> np.ndarray:
        """Calibrated class shares of the given lines (sorted)."""
        k = len(self.vocabulary)
        z = sums_by(self.weights[column], np.searchsorted(line, np.append(lines, np.iinfo(np.int64).max)))
        z += share[lines][:, None] * self.weights[k] + self.weights[k + 1]
        z = z / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def confirmed(self, words: np.ndarray, family: str) -> float:
        """Largest share, over the family's templates, of a template's word pairs that the paragraph has."""
        have = _pairs(words)
        return max(np.isin(t, have).mean() for t in self.templates[family])

    def scan(self, texts: Texts):
        """``(text number, line number in the text, family, share, likeness)`` of every confirmed paragraph."""
        h, first, owner = _paragraphs(texts)
        line, column, share = self.features(h, first)
        lines = np.unique(line)
        if not len(lines):
            return []
        p = self.shares(line, column, share, lines)
        best = p.argmax(axis=1)
        out = []
        for i in np.flatnonzero(best != self.families.index(UNKNOWN)):
            family, at = self.families[best[i]], lines[i]
            like = self.confirmed(h[first[at] : first[at + 1]], family)
            if like >= self.least:
                out.append((int(at), family, float(p[i, best[i]]), float(like)))
        out += self.wrapped(h, first, owner, out)
        return [(int(owner[at]), int(at - np.searchsorted(owner, owner[at])), *hit) for at, *hit in sorted(out)]

    def wrapped(self, h: np.ndarray, first: np.ndarray, owner: np.ndarray, single: list) -> list:
        """``(first line, family, share, likeness)`` of notices over several lines, without those that stand on one line.

        A window of lines is as long as the longest template needs. A block none of whose templates is there as a
        whole has no window either, so few windows are looked at.
        """
        if len(h) < 2:
            return []
        pair = _pairs(h)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        where = np.flatnonzero(self.pairs[at] == pair)
        kind = at[where]
        longest = max(len(t) for ts in self.templates.values() for t in ts) + 1
        filled = np.diff(first) > 0
        joined = filled[1:] & filled[:-1] & (owner[1:] == owner[:-1])
        edge = np.diff(joined.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        hits = {}
        for line, family, *_ in single:
            hits.setdefault(line, set()).add(self.families.index(family))

        def found(lo: int, hi: int) -> np.ndarray:
            """Likeness of every template to the lines from ``lo`` to ``hi``."""
            a, b = np.searchsorted(where, [first[lo], first[hi + 1] - 1])
            return self.table[np.unique(kind[a:b])].sum(axis=0)

        out = []
        for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if not (found(lo, hi) >= self.least).any():
                continue
            seen = []
            for i in range(lo, hi):
                for j in range(i + 1, hi + 1):
                    if first[j] - first[i + 1] > longest:
                        break
                    like = found(i, j)
                    alone = set().union(*(hits.get(k, ()) for k in range(i, j + 1)))
                    if not set(self.of[like >= self.least]) - alone:
                        continue
                    words = h[first[i] : first[j + 1]]
                    line, column, share = self.features(words, np.array([0, len(words)]))
                    p = self.shares(line, column, share, np.array([0]))[0]
                    best = int(p.argmax())
                    mine = like[self.of == best].max(initial=0.0)
                    if self.families[best] != UNKNOWN and best not in alone and mine >= self.least:
                        seen.append((-mine, j - i, -p[best], i, best))
            used = set()
            for less, more, share, i, best in sorted(seen):
                lines = set(range(i, i + more + 1))
                if not lines & used:
                    used |= lines
                    out.append((int(i), self.families[best], float(-share), float(-less)))
        return out


def _pairs(words: np.ndarray) -> np.ndarray:
    """Ordered word pairs, with the two ends marked by nothing."""
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words


def _altered(rng, words: list[str], filler: list[str]) -> str:
    """A template as found in the wild: other case, dropped words, words around it."""
    kept = [w for w in words if rng.random() > 0.05] or words
    text = " ".join([*rng.choice(filler, rng.integers(0, 6)), *kept, *rng.choice(filler, rng.integers(0, 6))])
    return text.upper() if rng.random() < 0.1 else text.lower() if rng.random() < 0.2 else text


def fit(negatives: list[str], copies: int = 40, least: float = 0.75, rounds: int = 300, seed: int = 11) -> Scanner:
    """Train on altered templates and on corpus paragraphs; those that contain a template teach nothing."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    vocabulary = [_grams(*_lines(ts), n)[0] for ts in TEMPLATES.values() for n in (1, 2, 3)]
    templates = {f: [_pairs(_lines([t])[0]) for t in ts] for f, ts in TEMPLATES.items()}
    scan = Scanner(families, np.unique(np.concatenate(vocabulary)), np.zeros((0, 0)), 1.0, templates, least)
    negatives = [t for t in negatives if max(scan.confirmed(_lines([t])[0], f) for f in TEMPLATES) < least]
    filler = sorted({w for t in negatives for w in t.split()})[:5000] or ["and", "the", "of", "this", "with"]
    # near misses: template words in random order belong to no licence
    bag = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()})
    near = [" ".join(rng.choice(bag, rng.integers(3, 12))) for _ in range(400)]
    rows = [(_altered(rng, t.split(), filler), i) for i, f in enumerate(families[:-1]) for t in TEMPLATES[f] for _ in range(copies)]
    rows += [(t, len(families) - 1) for t in [*negatives, *near, ""]]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    y = np.array([r[1] for r in rows])
    h, first = _lines([r[0] for r in rows])
    line, column, share = scan.features(h, first)
    held = np.arange(len(rows)) % 4 == 0
    k, c = len(scan.vocabulary), len(families)
    weights, seen = np.zeros((k + 2, c)), np.zeros((k + 2, c))
    target = np.eye(c)[y]
    line_bounds = np.searchsorted(line, np.arange(len(rows) + 1))
    by_column = np.argsort(column, kind="stable")
    column_bounds = np.searchsorted(column[by_column], np.arange(k + 1))
    for _ in range(rounds):  # AdaGrad on the whole sample
        z = sums_by(weights[column], line_bounds)
        z += share[:, None] * weights[k] + weights[k + 1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - target) * ~held[:, None] / np.count_nonzero(~held)
        grad = 1e-4 * weights
        grad[:k] += sums_by(g[line[by_column]], column_bounds)
        grad[k] += share @ g
        grad[k + 1] += g.sum(axis=0)
        seen += grad**2
        weights -= 0.3 * grad / (np.sqrt(seen) + 1e-8)
    scan.weights = weights
    losses = []
    for t in np.geomspace(0.25, 4, 17):
        scan.temperature = t
        p = scan.shares(line, column, share, np.arange(len(rows)))
        losses.append((-np.log(p[held, y[held]] + 1e-12).mean(), t))
    scan.temperature = min(losses)[1]
    return scan


def sample_paragraphs(docs: DataFrame, text_col: str = "text", documents: int = 500) -> list[str]:
    """Paragraphs of about ``documents`` distinct whole texts at most, chosen by hash: the unknown class."""
    rows = docs.select(F.lit("any").alias("label"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    few = sample_by_label(rows, "label", documents, "text").select("text").collect()
    return sorted(line for r in few for line in r["text"].split("\n") if line.strip())


def _scan(shared, keep):
    def run(batches):
        scanner: Scanner = shared.value
        for batch in blocks(batches, "text"):
            found = [[] for _ in range(batch.num_rows)]
            for i, *hit in scanner.scan(Texts(batch.column("text"))):
                found[i].append(dict(zip(("paragraph", "family", "score", "likeness"), hit, strict=True)))
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("score", pa.float64()), ("likeness", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, kind)], [*keep, "hits"])

    return run


def licence_hits(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, hits)``, one row per row of ``docs``; ``hits`` lists ``paragraph`` (its first line, from 0), ``family``,
    ``score`` (calibrated share) and ``likeness`` (share of the template found).

    Null and empty texts have no hits. Ids may be null or repeat; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    schema = f"__id {rows.schema['__id'].dataType.simpleString()}, hits array<struct<paragraph:int,family:string,score:double,likeness:double>>"
    return rows.mapInArrow(_scan(shared, ["__id"]), schema).withColumnRenamed("__id", id_col)
