"""Licence notices by a trained paragraph classifier, confirmed against templates.

Each line is scanned as a paragraph. Lines without a blank one between them are also joined: where the joined words hold a template that is
wrapped over several lines, those words are scanned as one (rows of its unconfirmed lines of that family give way), and so are all joined
lines, whose row is given if no other of them has its family. A row carries the number of its first line. The words are lower-cased runs of letters and digits, numbers replaced by one sign. A multinomial logistic
regression over sparse word 1- to 3-grams tells the licence families and *unknown* apart. It is trained on the driver from the templates
below, varied by rule, against ``SAMPLE`` paragraphs of the corpus at most (a documented bound; those of the documents whose ids have the
least hashes) that share no five words with a template. Its temperature is fitted on a third of the material that was held out, so the
probabilities, that of unknown too, are calibrated. A family that has ``THRESHOLD`` or more is *confirmed* if ``SIMILAR`` of the
five-word shingles of one of the family's templates are in the paragraph (templates of fewer words are one shingle).

Only n-grams of templates have weights, and a paragraph with none of their words has the same scores as an empty one, so it is passed over.

Defined cases: null and empty texts have no paragraphs with words and so no rows; rows that repeat an id are scanned each; an empty table
gives an empty result, and a model trained without corpus paragraphs; paragraphs of any length are whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.shared import least_hashed, read

SAMPLE, THRESHOLD, SHINGLE, SIMILAR, UNKNOWN = 4000, 0.5, 5, 0.8, "unknown"
WORDS = re.compile(r"[^\W_]+")
#: Short public notices of each family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License version 3 or later."],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Released under the Apache License, Version 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.", "Released under the BSD License.",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License version 2.", "Released under the GNU GPL v3.",
    ],
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
}
FAMILIES = [*TEMPLATES, UNKNOWN]


def words(paragraph: str) -> list[str]:
    return ["#" if w.isdecimal() else w for w in WORDS.findall(paragraph.lower())]


def grams(ws: list[str]) -> list[str]:
    return [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)), *(f"{a} {b} {c}" for a, b, c in zip(ws, ws[1:], ws[2:], strict=False))]


def shingles(ws: list[str]) -> set[str]:
    return {" ".join(ws[k : k + SHINGLE]) for k in range(max(1, len(ws) - SHINGLE + 1))} if ws else set()


SHINGLES = {f: [(shingles(words(t)), min(SHINGLE, len(words(t)))) for t in ts] for f, ts in TEMPLATES.items()}
ALL_SHINGLES = [x for own in SHINGLES.values() for x in own]
SIZES = sorted({n for _, n in ALL_SHINGLES})
#: The templates that hold a shingle, and the words that shingles begin with.
HOLDERS = {g: [t for t, (of, _) in enumerate(ALL_SHINGLES) if g in of] for of, _ in ALL_SHINGLES for g in of}
FIRST = frozenset(g.split(" ")[0] for g in HOLDERS)


def similarity(ws: list[str], family: str) -> float:
    """The greatest share of a template's shingles that the paragraph has."""
    best, own = 0.0, {n: {" ".join(ws[k : k + n]) for k in range(len(ws) - n + 1)} for n in {n for _, n in SHINGLES[family]}}
    for of, n in SHINGLES[family]:
        best = max(best, len(of & own[n]) / len(of))
    return best


class Model:
    """Sparse weights: rows of ``weight`` are n-grams, columns families."""

    def __init__(self, vocabulary: dict[str, int], weight: np.ndarray, bias: np.ndarray, temperature: float):
        self.vocabulary, self.weight, self.bias, self.temperature = vocabulary, weight, bias, temperature
        self.single = frozenset(w for w in vocabulary if " " not in w)

    def logits(self, ws: list[str]) -> np.ndarray:
        every = grams(ws)
        found = {self.vocabulary[g] for g in every if g in self.vocabulary}
        return self.bias + (self.weight[sorted(found)].sum(axis=0) / np.sqrt(len(every)) if found else 0)

    def probabilities(self, ws: list[str]) -> np.ndarray:
        z = self.logits(ws) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _varied(rng: np.random.Generator, ws: list[str], filler: list[str]) -> list[str]:
    """A word or two lost, changed or added around it."""
    out = [w for w in ws if rng.random() > 0.04]
    around = [str(rng.choice(filler)) for _ in range(int(rng.integers(0, 4)))] if filler and rng.random() < 0.4 else []
    return out + around if rng.random() < 0.5 else around + out


def train(paragraphs: list[str], copies: int = 30, seed: int = 11, steps: int = 300) -> Model:
    rng = np.random.default_rng(seed)
    known = set().union(*(s for ts in SHINGLES.values() for s, n in ts if n == SHINGLE))
    other = [ws for p in paragraphs if (ws := words(p)) and not shingles(ws) & known]
    filler = [w for ws in other[:200] for w in ws[:5]]
    own = [(f, v) for f, ts in TEMPLATES.items() for t in ts for v in [words(t)] + [_varied(rng, words(t), filler) for _ in range(copies)]]
    templated = sorted({w for f, ts in TEMPLATES.items() for t in ts for w in words(t)})
    other += [[str(w) for w in rng.choice(templated, int(rng.integers(1, 9)))] for _ in range(600)]  # the words without the sense
    vocabulary = {g: k for k, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(words(t))}))}
    data = own + [(UNKNOWN, ws) for ws in other]
    y = np.array([FAMILIES.index(f) for f, _ in data])
    rows, columns, values = [], [], []
    for k, (_, ws) in enumerate(data):
        every = grams(ws)
        found = {vocabulary[g] for g in every if g in vocabulary}
        rows += [k] * len(found)
        columns += found
        values += [1 / np.sqrt(max(1, len(every)))] * len(found)
    held = rng.random(len(data)) < 1 / 3
    x = np.zeros((len(data), len(vocabulary)), np.float32)
    x[rows, columns] = values
    weight, bias = np.zeros((len(vocabulary), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    fit, one = x[~held], np.eye(len(FAMILIES), dtype=np.float32)[y[~held]]
    share = 1 / np.maximum(1, one.sum(axis=0))
    per = (one @ share)[:, None] / len(FAMILIES)  # families weigh alike
    for _ in range(steps):
        z = fit @ weight + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - one) * per
        weight -= 20 * (fit.T @ d + 2e-4 * weight)
        bias -= 20 * d.sum(axis=0)
    weight[np.abs(weight) < 1e-3] = 0
    z, own_y = x[held] @ weight + bias, y[held]

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(s)), own_y]).mean())

    return Model(vocabulary, weight.astype(float), bias.astype(float), min((2.0**k for k in np.arange(-4, 3.01, 0.25)), key=loss))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The negatives: at most ``sample`` lines and paragraphs, whole and from anywhere in at most ``sample`` / 4 documents, those with the least hashes."""
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("order")).where("text is not null")
    # Different texts, whatever their ids: copies count once.
    some = least_hashed(texts, F.col("order"), sample // 4).groupBy("order").agg(F.first("text").alias("text")).orderBy("order").limit(sample // 4)
    parts = some.select("order", F.explode(F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n\s*\n")))).alias("part")).where("part rlike '\\\\S'")
    few = parts.orderBy(F.xxhash64("order", "part"), "order", "part").limit(sample).collect()
    return train([r["part"] for r in few])


def _row(model: Model, k: int, ws: list[str]) -> list[tuple[int, str, float, float, bool]]:
    if model.single.isdisjoint(ws):
        return []
    prob = model.probabilities(ws)
    best = int(prob.argmax())
    if FAMILIES[best] == UNKNOWN or prob[best] < THRESHOLD:
        return []
    like = similarity(ws, FAMILIES[best])
    return [(k, FAMILIES[best], float(prob[best]), like, like >= SIMILAR)]


def notices(ws: list[str]) -> list[list[tuple[int, int]]]:
    """Where the words hold ``SIMILAR`` of a template: spans to try for each place, the longest first, then the tightest."""
    hits: dict[int, list[tuple[int, str]]] = {}
    for k, w in enumerate(ws):
        if w in FIRST:
            for n in SIZES:
                g = " ".join(ws[k : k + n])
                for t in HOLDERS.get(g, ()):
                    hits.setdefault(t, []).append((k, g))
    out = []
    for t, at in hits.items():
        of, n = ALL_SHINGLES[t]
        need = next(m for m in range(1, len(of) + 1) if m / len(of) >= SIMILAR)
        now: dict[str, int] = {}  # the latest different shingles, in order
        tight = []
        for i, (k, g) in enumerate(at):
            if g in now:
                now = {x: j for x, j in now.items() if j > now[g]}
            now[g] = i
            if len(now) >= need:
                first = list(now.values())[-need]
                tight.append((k - at[first][0], first, i))
        used: set[int] = set()
        for _, first, last in sorted(tight):
            if used.isdisjoint(range(first, last + 1)):
                a, b, have = first, last, {g for _, g in at[first : last + 1]}
                while b + 1 < len(at) and b + 1 not in used and at[b + 1][1] not in have and at[b + 1][0] - at[b][0] <= 2 * n:
                    b += 1
                    have.add(at[b][1])
                while a and a - 1 not in used and at[a - 1][1] not in have and at[a][0] - at[a - 1][0] <= 2 * n:
                    a -= 1
                    have.add(at[a][1])
                used.update(range(a, b + 1))
                out.append([(at[a][0], at[b][0] + n), (at[first][0], at[last][0] + n)])
    return sorted(out, key=lambda spans: spans[0][0] - spans[0][1])


def _paragraph(model: Model, lines: list[tuple[int, list[str]]]) -> list[tuple[int, str, float, float, bool]]:
    """Rows of the lines of a paragraph, of templates wrapped over several of them, and of the whole."""
    rows = [r for k, ws in lines for r in _row(model, k, ws)]
    if len(lines) < 2:
        return rows
    every, line = [w for _, ws in lines for w in ws], [k for k, ws in lines for _ in ws]
    taken: list[tuple[str, int, int]] = []
    for spans in notices(every):
        for a, b in spans:
            found = [r for r in _row(model, line[a], every[a:b]) if r[4]] if line[a] < line[b - 1] else []
            if found:
                family = found[0][1]
                if not any(f == family and a < d and c < b for f, c, d in taken):
                    taken.append((family, a, b))
                    rows = [r for r in rows if r[4] or r[1] != family or not line[a] <= r[0] <= line[b - 1]] + found
                break
    families = {r[1] for r in rows}
    return sorted(rows + [r for r in _row(model, lines[0][0], every) if r[1] not in families])


def scan_text(model: Model, text: str) -> list[tuple[int, str, float, float, bool]]:
    out, own = [], []
    for k, p in enumerate(text.split("\n")):
        if p.strip():
            own.append((k, words(p)))
        elif own:
            out += _paragraph(model, own)
            own = []
    return out + _paragraph(model, own)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed: a row for each paragraph with a licence family."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(d, *r) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for r in scan_text(shared.value, t.as_py() or "")]
            types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], ["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(rows, "doc_id long, paragraph int, family string, probability double, similarity double, confirmed boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
