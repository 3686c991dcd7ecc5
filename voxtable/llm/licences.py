"""Licence scans by a trained paragraph classifier.

1. Lines, and paragraphs of several lines (parted by blank lines), are cut into pieces of PIECE_WORDS words where they are
   longer, with an overlap of half a piece. Pieces are described by hashed words and word pairs. So a notice is seen
   both as a line among others and wrapped over lines. It counts once: a paragraph's piece adds to what its lines tell
   where it names a family that they do not, and then replaces their "unknown".
2. A multinomial logistic regression over sparse features tells licence families, a class "unknown" for other licence
   wording and a class "none" for ordinary text. It is trained here, on variants of the templates below, on unnamed
   licence wording, and on SAMPLE_TEXTS different texts of the corpus, drawn by hash, for "none".
   Ordinary text being by far the most, "none" starts with log odds of ORDINARY: words never seen make no notice.
3. A piece is a notice if "none" has less than 1 - SURE. A temperature fitted on variants held out from training makes its probabilities honest. A family of less than SURE is
   "unknown".
4. A predicted family stands if the piece, with half a piece of its line or paragraph on either side, also has at least CONFIRM of the word pairs of one of the family's templates;
   else the notice is "unknown", which needs half of the word pairs of any licence wording.

Null or empty text: no notice. Repeated rows give a row each; null ids are kept. Other columns are not read. An empty table
gives no rows. With no text for "none" the templates alone are learned from."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table
from .tokens import Words, grams, words

PIECE_WORDS, BINS, SAMPLE_TEXTS, SURE, CONFIRM, ORDINARY = 24, 1 << 15, 400, 0.6, 0.6, 4.0

#: Short wording by which the families are usually named.
TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": ("licensed under the GNU Lesser General Public License, version 2.1.", "modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only"),
    "agpl": ("licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "reserved": ("All rights reserved.", "Copyright 2020. All rights reserved."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 into the public domain."),
}
#: Licence wording that names no family.
UNNAMED = (
    "Copyright {y} {n}.", "Licensed under the {n} License, Version {v}.", "Released under the {n} License.", "This work is licensed under the {n} terms.",
    "Use of this material is governed by the {n} licence agreement.", "Licensed under {n} {v}.", "You may not copy or distribute this work without permission of {n}.", "Redistribution of this document is prohibited.",
)
#: Words are runs of letters (bytes beyond ASCII count as letters): numbers and marks do not tell families apart.
_GAPS = np.array([not (chr(b).isalpha() or b > 127) for b in range(256)])


def features(h: np.ndarray) -> np.ndarray:
    """Bins of the words and word pairs of one piece."""
    return np.concatenate([h, grams(h, 2)]).astype(np.uint64) % np.uint64(BINS)


def _hashes(text: str) -> np.ndarray:
    return next(words(pa.array([text], pa.large_string()), gaps=_GAPS)).hash


def variants(r: np.random.RandomState, text: str, n: int, names: list[str]) -> list[str]:
    """Wordings as they are met: other numbers and names, words left out, words around."""
    out = []
    for _ in range(n):
        t = text.format(y=1990 + r.randint(40), n=names[r.randint(len(names))].title(), v=f"{r.randint(1, 6)}.{r.randint(3)}")
        w = [x for x in t.split() if r.rand() > 0.06] or [t]
        if r.rand() < 0.5:
            more = [names[r.randint(len(names))] for _ in range(r.randint(PIECE_WORDS))]
            k = r.randint(len(more) + 1)
            w = more[:k] + w + more[k:]
        out.append(" ".join(w))
    return out


class Classifier:
    """classes, weights (a row per bin), bias and temperature, from texts that hold no licence."""

    def __init__(self, ordinary: list[str], seed: int = 10):
        r = np.random.RandomState(seed)
        names = [w for t in ordinary for w in t.split()[:40] if w.isalpha()][:4000] or ["work", "text", "here"]
        self.classes = [*TEMPLATES, "unknown", "none"]
        sets: list[tuple[str, int]] = []
        for i, c in enumerate(self.classes[:-2]):
            for t in TEMPLATES[c]:
                sets += [(x, i) for x in [t] * 3 + variants(r, t, 40, names)]
        for t in UNNAMED:
            sets += [(x, len(TEMPLATES)) for x in variants(r, t, 40, names)]
        for t in ordinary:
            lines = [x for x in t.split("\n") if x.strip()]
            w = t.split() or [""]
            short = [w[k:k + r.randint(1, 14)] for k in r.randint(len(w), size=12)]
            sets += [(" ".join(x), len(TEMPLATES) + 1) for x in short + [x.split()[:PIECE_WORDS] for x in lines[:8]]]
        r.shuffle(sets)
        x = [features(_hashes(t)) for t, _ in sets]
        y = np.array([k for _, k in sets])
        held = np.arange(len(sets)) % 5 == 0
        self.weights, self.bias = np.zeros((BINS, len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        self.bias[-1] = ORDINARY
        self._train([x[i] for i in np.flatnonzero(~held)], y[~held])
        scores = np.array([self.scores(v) for i, v in enumerate(x) if held[i]]) if held.any() else np.zeros((0, len(self.classes)))
        losses = {t: -np.log(np.maximum(_softmax(scores / t)[np.arange(len(scores)), y[held]], 1e-12)).mean() for t in (0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0)} if len(scores) else {1.0: 0}
        self.temperature = min(losses, key=losses.get)

    def _train(self, x: list[np.ndarray], y: np.ndarray, rounds: int = 60, rate: float = 1.0, decay: float = 1e-4) -> None:
        """Full-batch gradient steps with a rate of each weight's own."""
        x = [v if len(v) else np.zeros(1, np.uint64) for v in x]
        size = np.array([len(v) for v in x])
        bins, row = np.concatenate(x).astype(np.int64), np.repeat(np.arange(len(x)), size)
        scale = 1 / np.sqrt(np.maximum(size, 1))
        balance = 1 / np.bincount(y, minlength=len(self.classes))[y]
        seen, at = np.unique(bins, return_inverse=True)
        w, g2 = np.zeros((len(seen), len(self.classes))), np.full((len(seen), len(self.classes)), 1e-8)
        first = np.cumsum(size) - size
        for _ in range(rounds):
            p = _softmax(np.add.reduceat(w[at], first, axis=0) * scale[:, None] + self.bias)
            p[np.arange(len(y)), y] -= 1
            p *= balance[:, None]
            g = np.zeros_like(w)
            np.add.at(g, at, (p * scale[:, None])[row])
            g += decay * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
        self.weights[seen] = w

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins.astype(np.int64)].sum(axis=0) / np.sqrt(max(len(bins), 1)) + self.bias


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_LETTERS = re.compile(r"[^\W\d_]+")


def _pairs(text: str) -> set[tuple[str, str]]:
    w = _LETTERS.findall(text.lower())
    return set(zip(w, w[1:]))


def confirmed(family: str, text: str) -> float:
    """The largest share of a template's word pairs that a text has."""
    have = _pairs(text)
    return max(len(p & have) / len(p) for p in map(_pairs, TEMPLATES[family]))


_WORDING = [p for p in map(_pairs, [re.sub(r"\{\w\}", "0", t) for t in UNNAMED] + [t for ts in TEMPLATES.values() for t in ts]) if p]


def worded(text: str) -> bool:
    """Whether a text has half of the word pairs of some licence wording."""
    have = _pairs(text)
    return any(2 * len(p & have) >= len(p) for p in _WORDING)


def _breaks(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words at which lines begin, and at which paragraphs do; the number of words is the last of both."""
    at = np.flatnonzero(w.data == 10)
    solid = np.concatenate([[0], np.cumsum(~np.isin(w.data, (9, 10, 11, 12, 13, 32)))])
    blank = at[1:][solid[at[1:]] == solid[at[:-1]]]
    return tuple(np.union1d(np.searchsorted(w.start, x), w.first) for x in (at, blank))


def _cut(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of every piece of the stretches between breaks, and first and end word of its stretch."""
    a, b = breaks[:-1], breaks[1:]
    step = PIECE_WORDS // 2
    n = np.where(b - a > PIECE_WORDS, -(-(b - a - PIECE_WORDS) // step) + 1, 1)
    low, high = np.repeat(a, n), np.repeat(b, n)
    start = low + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return start, np.minimum(start + PIECE_WORDS, high), low, high


def _pieces(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, both of its stretch, whether over lines) of the pieces of lines, then of paragraphs."""
    lines, paragraphs = _breaks(w)
    one, many = _cut(lines), _cut(paragraphs)
    # Pieces within one line are there already.
    wide = np.searchsorted(lines, many[0], side="right") < np.searchsorted(lines, many[1], side="left")
    both = [np.concatenate([x, y[wide]]) for x, y in zip(one, many)]
    return *both, np.arange(len(both[0])) >= len(one[0])


def _scanner(model: Classifier):
    none = model.classes.index("none")

    def notices(w: Words) -> Iterator[tuple[int, str, float]]:
        """(row, family or "unknown", probability) of every piece that the classifier takes for a notice."""
        start, end, low, high, wide = _pieces(w)
        keep = end > start
        start, end, low, high, wide = start[keep], end[keep], low[keep], high[keep], wide[keep]
        if not len(start):
            return
        # Sums of the weights of words and pairs over a piece, from running sums.
        h = w.hash % np.uint64(BINS)
        pair = grams(w.hash, 2) % np.uint64(BINS)
        total = np.zeros((2, len(h) + 1, len(model.classes)), np.float64)
        np.cumsum(model.weights[h.astype(np.int64)], axis=0, out=total[0, 1:])
        np.cumsum(model.weights[pair.astype(np.int64)], axis=0, out=total[1, 1:len(pair) + 1])
        total[1, len(pair) + 1:] = total[1, len(pair)]
        size = np.maximum(2 * (end - start) - 1, 1)
        score = (total[0, end] - total[0, start] + total[1, end - 1] - total[1, start]) / np.sqrt(size)[:, None] + model.bias
        p = _softmax(score / model.temperature)
        best = p.argmax(axis=1)
        row = np.searchsorted(w.first, start, side="right") - 1
        half = PIECE_WORDS // 2
        found: dict[int, list[tuple[int, int, str, float]]] = {}

        def text(a: int, b: int) -> str:
            return w.data[w.start[a]:w.end[b - 1]].tobytes().decode("utf-8", "replace")

        for i in np.flatnonzero((best != none) & (p[:, none] < 1 - SURE)):
            name, sure = model.classes[best[i]], float(p[i, best[i]])
            a, b = int(start[i]), int(end[i])
            if name != "unknown" and (sure < SURE or confirmed(name, text(max(a - half, low[i]), min(b + half, high[i]))) < CONFIRM):
                name = "unknown"
            if name == "unknown" and not worded(text(a, b)):
                continue
            own = found.setdefault(int(row[i]), [])
            if wide[i]:
                beside = [x for x in own if x[0] < b and a < x[1]]
                if any(name in ("unknown", x[2]) for x in beside):
                    continue
                own[:] = [x for x in own if x not in beside or x[2] != "unknown"]
            own.append((a, b, name, sure))
        for r, own in found.items():
            for _, _, name, sure in own:
                yield r, name, sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), 1 << 20, _GAPS):
                n = w.rows.stop - w.rows.start
                found: list[dict[str, float]] = [{} for _ in range(n)]
                count = np.zeros(n, np.int64)
                for row, name, sure in notices(w):
                    count[row] += 1
                    found[row][name] = max(found[row].get(name, 0.0), sure)
                best = [max((x for x in f if x != "unknown"), key=lambda x, f=f: (f[x], x), default="unknown" if f else "none") for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.rows.start, n), pa.array(best, pa.string()), pa.array([",".join(sorted(f)) for f in found], pa.string()), pa.array(count), pa.array([f.get(b, 0.0) for f, b in zip(found, best)])],
                                                 ["doc_id", "licence", "families", "notices", "probability"])
    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licence, families, notices, probability) of every row: the likeliest family ("unknown", "none"), all that
    were found, the number of pieces with a notice."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    usual = plain.where("text is not null and not lower(text) rlike 'licen[cs]|copyright|all rights|permission'").select("text", F.xxhash64("text").alias("key"))
    keys = [r[0] for r in usual.select("key").distinct().orderBy("key").limit(SAMPLE_TEXTS).collect()]
    ordinary = sorted((r[0], r[1]) for r in usual.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("text")).collect())
    return plain.mapInArrow(_scanner(Classifier([t for _, t in ordinary])), "doc_id bigint, licence string, families string, notices bigint, probability double")


def op10_licences(spark, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
