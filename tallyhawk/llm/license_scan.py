"""Licence scans by a trained paragraph classifier.

A sparse logistic regression over hashed word n-grams tells licence families from ordinary
paragraphs. It is trained here, on notices of each family with words dropped, swapped in
from the corpus or cut off, against paragraphs of the corpus (a bounded sample) as the
unknown class; a temperature fitted on held-out examples calibrates its probabilities. A
family is reported only where one of its notices confirms it: the words of the notice have
to stand in the paragraph to a set share. The paragraph is what the notice itself takes up,
from its first pair of words to its last, in a line of any length or wrapped over lines
without a blank one between: words around it do not weaken it. Texts whose pairs of words
confirm no notice cannot have a stretch that does, and are not looked at further.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import dealt

UNKNOWN = "unknown"
BITS = 15
CONFIRM = 0.7

# Short notices by which licences are named in texts.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL, version 2 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU LGPL, version 3.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Proprietary": ["All rights reserved.", "Copyright 2020 by the publisher. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the copyright holder."],
}
ANCHORS = ("license", "licence", "licensed", "licenced", "copyright", "rights", "permission", "redistribution", "domain", "software")
ANCHOR_PATTERN = r"(?i)\b(?:" + "|".join(ANCHORS) + r")\b"
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(tokens: list[str]) -> np.ndarray:
    """Distinct hashed n-grams of one to three words."""
    grams = [" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)]
    return np.unique(np.array([zlib.crc32(g.encode()) >> (32 - BITS) for g in grams], dtype=np.int64))


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # unknown first
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        logit = _logits(self.weights, self.bias, features(words(text))) / self.temperature
        p = np.exp(logit - logit.max())
        return p / p.sum()

    def family(self, text: str | None, least: float = 0.5) -> tuple[str, float]:
        """Most likely family and its probability; ``unknown`` unless likely enough and confirmed by a notice."""
        tokens = words(text or "")
        p = self.probabilities(text or "")
        for k in np.argsort(-p, kind="stable"):
            name = self.families[k]
            if name == UNKNOWN or p[k] < least:
                break
            if confirmed(tokens, name):
                return name, float(p[k])
        return UNKNOWN, float(p[0])


def _logits(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    return weights[at].sum(axis=0) / np.sqrt(max(1, len(at))) + bias


def confirmed(tokens: list[str], family: str) -> bool:
    """A notice of the family of which the paragraph has at least ``CONFIRM`` of the words' pairs."""
    have = set(zip(tokens, tokens[1:], strict=False))
    for notice in NOTICES[family]:
        w = words(notice)
        pairs = set(zip(w, w[1:], strict=False))
        if len(pairs & have) >= CONFIRM * len(pairs):
            return True
    return False


@dataclass(frozen=True)
class Notice:
    """A notice's pairs of words, how many of them confirm it, and within how many words they have to stand."""

    family: str
    pairs: frozenset[tuple[str, str]]
    need: int
    within: int


def _notice(family: str, text: str) -> Notice:
    w = words(text)
    pairs = frozenset(zip(w, w[1:], strict=False))
    return Notice(family, pairs, -int(-CONFIRM * len(pairs) // 1), 3 * len(w) // 2 + 4)


_NOTICES = [_notice(f, n) for f, notices in NOTICES.items() for n in notices]
_PAIRS = frozenset().union(*[n.pairs for n in _NOTICES])


def spans(tokens: list[str], block: list[int], notice: Notice) -> Iterator[tuple[int, int]]:
    """Stretches of words, none overlapping, that confirm ``notice``: from its first pair to its last, within one block of lines.

    Two ends go over the places of its pairs once, so a text of many notices costs no more than its length.
    """
    hits = [k for k, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in notice.pairs and block[k] == block[k + 1]]
    held: Counter = Counter()
    left = right = 0

    def drop() -> None:
        nonlocal left
        p = tokens[hits[left]], tokens[hits[left] + 1]
        held[p] -= 1
        if not held[p]:
            del held[p]
        left += 1

    while right < len(hits):
        k = hits[right]
        right += 1
        held[tokens[k], tokens[k + 1]] += 1
        while block[hits[left]] != block[k] or k + 2 - hits[left] > notice.within:
            drop()
        if len(held) < notice.need:
            continue
        while held[tokens[hits[left]], tokens[hits[left] + 1]] > 1 or len(held) > notice.need:
            drop()
        start, end = hits[left], k + 2
        # The rest of the notice belongs to it, as far as its pairs are new.
        while right < len(hits) and (p := (tokens[hits[right]], tokens[hits[right] + 1])) not in held and block[hits[right]] == block[start] and hits[right] + 2 - start <= notice.within:
            held[p] += 1
            end = hits[right] + 2
            right += 1
        yield start, end
        held.clear()
        left = right


def findings(model: Model, text: str | None, least: float = 0.5) -> list[tuple[int, str, float]]:
    """(line it begins at, family, probability) of each confirmed notice of a text; one of a family for a line."""
    tokens = words(text or "")
    met = _PAIRS.intersection(zip(tokens, tokens[1:], strict=False))
    able = [n for n in _NOTICES if len(n.pairs & met) >= n.need]
    if not able:
        return []
    line, block, blank = [], [], 0
    for i, raw in enumerate(text.split("\n")):
        blank += not raw.strip()
        n = len(words(raw))
        line += [i] * n
        block += [blank] * n
    out, taken, known = [], set(), {}
    for notice in able:
        at = model.families.index(notice.family)
        for start, end in spans(tokens, block, notice):
            said = " ".join(tokens[start:end])
            if said not in known:
                known[said] = model.probabilities(said)
            p = float(known[said][at])
            own = {(i, notice.family) for i in range(line[start], line[end - 1] + 1)}
            if p >= least and not own & taken:
                out.append((line[start], notice.family, p))
                taken |= own
    return sorted(out)


def examples(corpus: list[str], copies: int, rng: np.random.Generator) -> list[tuple[list[str], str]]:
    """Notices, whole and disturbed, by family, and corpus paragraphs as unknown."""
    filler = [w for p in corpus[:500] for w in words(p)] or ["the"]
    out = []
    for family, notices in NOTICES.items():
        for notice in notices:
            w = words(notice)
            out.append((w, family))
            for _ in range(copies):
                kept = [t if rng.random() > 0.08 else filler[rng.integers(len(filler))] for t in w]
                around = [filler[rng.integers(len(filler))] for _ in range(int(rng.integers(0, 40)))]
                cut = int(rng.integers(0, len(around) + 1))
                out.append((around[:cut] + kept + around[cut:], family))
    for p in corpus:
        w = words(p)
        out.append((w, UNKNOWN))
        if rng.random() < 0.5:  # licence words in no notice's order stay unknown
            some = [ANCHORS[rng.integers(len(ANCHORS))] for _ in range(int(rng.integers(1, 4)))]
            out.append(([x for t in w[:40] for x in ([t, some.pop()] if some and rng.random() < 0.1 else [t])], UNKNOWN))
    return out


def train(corpus: list[str], copies: int = 30, epochs: int = 12, rate: float = 0.5, decay: float = 1e-5, seed: int = 8) -> Model:
    """Multinomial logistic regression by AdaGrad over sparse features; temperature from the held-out fifth."""
    rng = np.random.default_rng(seed)
    families = (UNKNOWN, *NOTICES)
    rows = [(features(w), families.index(f)) for w, f in examples(corpus, copies, rng)]
    held = rng.random(len(rows)) < 0.2
    weights, bias = np.zeros((1 << BITS, len(families))), np.zeros(len(families))
    g_w, g_b = np.full(weights.shape, 1e-6), np.full(len(families), 1e-6)
    size = np.bincount([y for _, y in rows], minlength=len(families))
    balance = np.sqrt(size.mean() / np.maximum(1, size))
    fit = np.nonzero(~held)[0]
    for _ in range(epochs):
        for k in rng.permutation(fit):
            at, y = rows[k]
            logit = _logits(weights, bias, at)
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            p *= balance[y]
            grad = p / np.sqrt(max(1, len(at))) + decay * weights[at]
            g_w[at] += grad**2
            g_b += p**2
            weights[at] -= rate * grad / np.sqrt(g_w[at])
            bias -= rate * p / np.sqrt(g_b)
    logits = np.array([_logits(weights, bias, rows[k][0]) for k in np.nonzero(held)[0]])
    truth = np.array([rows[k][1] for k in np.nonzero(held)[0]])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean())

    temperature = min(np.geomspace(0.2, 5, 60), key=loss) if len(logits) else 1.0
    return Model(families, weights, bias, float(temperature))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = 400) -> Model:
    """A model with the first blocks of lines of about ``rows`` documents, dealt by a hash of the id, as unknown class; those that a notice confirms are left out."""
    share = rows / max(1, docs.count())
    block = F.get(F.split(F.col(text), r"\n\s*\n", 2), F.lit(0)).alias("block")
    some = docs.where((dealt(F.col(doc_id), 8) < share) & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), block)
    told = sorted(some.collect(), key=lambda r: (r.id or 0, r.block))
    return train([r.block for r in told if not any(confirmed(words(r.block), f) for f in NOTICES)])


def _found(docs: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    @F.pandas_udf("array<struct<paragraph int, family string, probability double>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("paragraph", "family", "probability"), x, strict=True)) for x in findings(model, t)] for t in texts], dtype=object)

    return docs.select("*", of(text).alias(out))


def paragraphs(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, paragraph (number of its first line, from 0), family, probability`` of the paragraphs with a confirmed licence."""
    told = _found(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, "text", "f")
    return told.where(F.size("f") > 0).select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.paragraph", "f.family", "f.probability")


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, license, probability, families, paragraphs``.

    ``license`` is the family of the most probable paragraph (ties: first name), ``unknown``
    with probability 0 where none is confirmed, also for null and empty texts. Repeated ids
    and null ids have the findings of their own row; an empty table gives an empty result.
    """
    found = _found(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, "text", "f").select("doc_id", "f")
    best = F.get(F.array_sort(F.transform("f", lambda x: F.struct((-x["probability"]).alias("p"), x["family"].alias("family")))), F.lit(0))
    return found.select(
        "doc_id", F.coalesce(best["family"], F.lit(UNKNOWN)).alias("license"), F.coalesce(-best["p"], F.lit(0.0)).alias("probability"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("f", lambda x: x["family"]))), ",").alias("families"), F.size("f").cast("long").alias("paragraphs"),
    )
