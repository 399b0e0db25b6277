"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A logistic regression over hashed word 1- and 2-grams gives each paragraph a licence family or `unknown`. It is fitted on
the templates, with words left out and surroundings added, and as `unknown` on paragraphs of a bounded sample of documents, on words
of the templates out of order and on licences of other families. Its confidence is calibrated by a temperature on wordings that the
model has not seen: each fold's templates are scored by a model that was fitted without them. What stays under the threshold
is `unknown`. A prediction counts if a template of its family shares enough of its words in the same order with the
paragraph, and the words that tell its family from the others stand there together and are not denied.

Licence texts are often wrapped: beside the lines, each block of lines up to a blank one, without their comment marks, is
read as one text, and adds the families that none of its lines has alone.

Rows: a null or empty text has no paragraph; a paragraph is a line that is not blank; texts are read whole, a long
paragraph or block in windows that overlap by half; repeated rows, those that repeat an id and those without one give a
result each; an empty table gives an empty result (the classifier is then fitted on the templates alone); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# Names and SPDX identifiers of public licences.
NAMES: dict[str, list[str]] = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License"],
    "mit": ["MIT License", "MIT/X11 License", "Expat License"],
    "isc": ["ISC License"],
    "bsd": ["BSD License", "BSD-style License"],
    "bsd-2-clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL version 3", "GPLv3", "GPL v2"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v2.1", "GNU Library General Public License", "GNU LGPL version 3", "LGPLv3"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "epl": ["Eclipse Public License, version 2.0", "Eclipse Public License v1.0", "EPL 2.0"],
    "zlib": ["zlib License", "zlib/libpng License"],
    "boost": ["Boost Software License, Version 1.0", "Boost License 1.0"],
    "unlicense": ["Unlicense"],
    "cc0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "cc-by": ["CC BY 4.0", "CC-BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-sa": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nc-nd": ["CC BY-NC-ND 4.0", "CC-BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
SPDX: dict[str, list[str]] = {
    "apache": ["Apache-2.0"], "mit": ["MIT"], "isc": ["ISC"], "bsd-2-clause": ["BSD-2-Clause"], "bsd-3-clause": ["BSD-3-Clause"], "gpl": ["GPL-2.0-only", "GPL-3.0-or-later"], "lgpl": ["LGPL-2.1-only", "LGPL-3.0-or-later"],
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "mpl": ["MPL-2.0"], "epl": ["EPL-2.0"], "zlib": ["Zlib"], "boost": ["BSL-1.0"], "unlicense": ["Unlicense"], "cc0": ["CC0-1.0"], "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"],
    "cc-by-nd": ["CC-BY-ND-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-nc-sa": ["CC-BY-NC-SA-4.0"], "cc-by-nc-nd": ["CC-BY-NC-ND-4.0"],
}
#: Licences of no family, as examples of `unknown`.
OTHERS = [
    "Artistic License 2.0", "Python Software Foundation License", "Open Software License 3.0", "Academic Free License v3.0", "PHP License 3.01", "Ruby License", "European Union Public Licence", "Common Development and Distribution License",
    "Microsoft Public License", "SIL Open Font License", "Zope Public License 2.1", "Q Public License", "Beerware License", "Business Source License 1.1", "Server Side Public License", "Elastic License 2.0",
]
FRAMES = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under a {}.", "Distributed under the {}.", "This project is available under the terms of the {}.", "Licensed under {}.", "Published under {}.", "This work is licensed under the {}."]
# Characteristic sentences of public licence texts. Braces hold the words that tell a family from others.
TEXTS: dict[str, list[str]] = {
    "apache": [
        "Licensed under the {Apache License}, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://{www.apache.org} licenses LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-3-clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the {GNU General Public License} along with this program.",
        "This program is distributed under the terms of the {GNU General Public License}, see the file COPYING.",
    ],
    "lgpl": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the {GNU Lesser General Public License} along with this library.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Affero General Public License} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the {GNU Affero General Public License} along with this program.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the {Mozilla Public License}, v. 2.0.",
        "If a copy of the {MPL} was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "epl": ["This program and the accompanying materials are made available under the terms of the {Eclipse Public License} 2.0 which is available at", "All rights reserved. This program and the accompanying materials are made available under the terms of the {Eclipse Public License} v1.0 which accompanies this distribution"],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
        "Distributed under the {Boost Software License}, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
UNKNOWN = "unknown"
FAMILIES = [*NAMES, UNKNOWN]
BUCKETS = 1 << 14
#: Documents of which a paragraph is an example of `unknown`, at most; words of a window of a long paragraph.
SAMPLE, WINDOW = 500, 64
#: Words of a block's windows -> lengths of the templates that they are compared with: short ones would be lost in long windows.
BLOCK_WINDOWS = {16: range(1, 10), WINDOW: range(10, 10**6)}
#: What a paragraph must hold one of to be looked at: each template does.
CUES = ("licen", "permi", "redistribut", "free", "under", "spdx", "copy", "name", "software", "damages", "law")
#: Words that deny what follows in their sentence, and words that make another name of the one before.
NOT, MORE = {"not", "never", "no", "unlike", "neither", "nor", "without", "cannot", "isn", "aren", "wasn", "t", "instead", "formerly"}, {"nc", "sa", "nd", "noncommercial", "non-commercial", "sharealike", "noderivatives", "noderivs"}
#: What a line of a comment starts with.
_COMMENT = re.compile(r"^\s*(?:(?://+|/\*+|\*+/|\*+|#+|;+|--+|%+|<!--|>+|(?:rem|dnl)(?=\s|$))\s*)*")
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*|[.;!?](?=\s|$)")
_VERSION = re.compile(r"v\.?|version|v?[0-9][0-9.]*(?:-only|-or-later)?|[.]|universal|international")


def sentence_words(paragraph: str) -> list[str]:
    """Words and the marks that end sentences."""
    return _WORD.findall(paragraph.lower())


def words(paragraph: str) -> list[str]:
    return [w for w in sentence_words(paragraph) if w[0].isalnum()]


@dataclass(frozen=True)
class Template:
    family: int
    tokens: tuple[str, ...]
    #: words that must stand together; none if the wording itself tells the family
    core: tuple[str, ...]
    #: a name alone counts only in a paragraph of few words more
    heading: bool = False
    distinct: frozenset = field(default=frozenset())


def _template(family: str, text: str, core: str, heading: bool = False) -> Template:
    tokens = tuple(words(text))
    return Template(FAMILIES.index(family), tokens, tuple(words(core)), heading, frozenset(tokens))


def _core(name: str) -> str:
    """A name without its version."""
    out = words(name)
    while len(out) > 1 and _VERSION.fullmatch(out[-1]):
        out.pop()
    return " ".join(out)


@cache
def templates() -> list[Template]:
    out = [_template(k, f.format(n), _core(n)) for k, names in NAMES.items() for n in names for f in FRAMES]
    out += [_template(k, n, n, True) for k, names in NAMES.items() for n in names]
    out += [_template(k, f"{field}: {x}", f"{field} {x}") for k, ids in SPDX.items() for x in ids for field in ("SPDX-License-Identifier", "License")]
    for k, texts in TEXTS.items():
        for text in texts:
            core = re.search(r"\{(.*?)\}", text)
            out.append(_template(k, text.replace("{", "").replace("}", ""), core[1] if core else ""))
    return out


def buckets(tokens: list[str]) -> np.ndarray:
    """Hashed 1- and 2-grams."""
    import xxhash

    grams = [*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))]
    return np.unique(np.array([xxhash.xxh64_intdigest(g) % BUCKETS for g in grams], np.int64))


def shared_order(template: tuple[str, ...], tokens: list[str]) -> float:
    """Length of the longest common subsequence over the template's length."""
    best = np.zeros(len(tokens) + 1, np.int64)
    for w in template:
        hit = np.array([t == w for t in tokens], bool)
        new = best.copy()
        new[1:] = np.maximum(new[1:], np.where(hit, best[:-1] + 1, 0))
        best = np.maximum.accumulate(new)
    return float(best[-1]) / max(1, len(template))


def core_stands(core: tuple[str, ...], marked: list[str]) -> bool:
    """Whether the words stand together somewhere, are not a part of a longer name, and are not denied in their sentence."""
    n = len(core)
    for i in range(len(marked) - n + 1):
        if tuple(marked[i : i + n]) == core and (i + n == len(marked) or marked[i + n] not in MORE):
            before: list[str] = []
            for w in reversed(marked[max(0, i - 12) : i]):
                if w in (".", ";", "!", "?"):
                    break
                before.append(w)
            if NOT.isdisjoint(before):
                return True
    return False


@dataclass
class Classifier:
    weights: np.ndarray  # (BUCKETS + 1, families)
    temperature: float = 1.0

    def logits(self, found: np.ndarray) -> np.ndarray:
        return self.weights[found].sum(axis=0) / np.sqrt(max(1, found.size)) + self.weights[-1]

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        x = self.logits(found) / self.temperature
        e = np.exp(x - x.max())
        return e / e.sum()


def examples(unknown: list[str], folds: int, seed: int = 3, copies: int = 2) -> list[tuple[np.ndarray, int, int]]:
    """(features, family, fold): all copies of one wording (a frame, or a sentence of a text) are in one fold."""
    rng = np.random.default_rng(seed)
    filler = np.array([w for p in unknown for w in words(p)] or ["text"], object)
    around = lambda tokens, most: [*rng.choice(filler, rng.integers(0, most)), *tokens, *rng.choice(filler, rng.integers(0, most))]
    none = len(FAMILIES) - 1
    out = [(buckets(words(p)[:24]), none, i % folds) for i, p in enumerate(unknown)]
    pool = np.array([w for t in templates() for w in t.tokens], object)
    # words of the templates out of their order are no licence, and neither are frames with other words in them
    out += [(buckets(around(rng.choice(pool, rng.integers(1, 6)), 20)), none, i % folds) for i in range(200)]
    out += [(buckets(around(words(f.format(" ".join(rng.choice(filler, rng.integers(1, 5))))), 12)), none, i % folds) for i, f in enumerate(FRAMES * 8)]
    out += [(buckets(around(words(f.format(n)), 12)), none, j % folds) for i, n in enumerate(OTHERS) for j, f in enumerate(FRAMES) if (i + j) % 2]
    wordings: dict[tuple, int] = {}
    for t in templates():
        # a frame is the same wording in all families; a text is its own
        wording = (tuple(w for w in t.tokens if w not in t.core), len(t.core) > 0)
        fold = wordings.setdefault(wording, len(wordings) % folds)
        for _ in range(copies if len(t.tokens) > 3 else 4 * copies):
            tokens = [w for w in t.tokens if w in t.core or rng.random() > 0.08]
            out.append((buckets(around(tokens, 3 if t.heading else 12)), t.family, fold))
    return out


def fit(rows: list[tuple[np.ndarray, int]], rounds: int = 40, rate: float = 6.0, decay: float = 2e-4) -> Classifier:
    """Full-batch gradient steps with momentum, on the features that occur."""
    used, at = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True)
    sizes = np.array([x.size for x, _ in rows])
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(used.size))
    scale = (1 / np.sqrt(sizes))[:, None].astype(np.float32)
    target = np.eye(len(FAMILIES), dtype=np.float32)[[y for _, y in rows]]
    balance = 1 / np.sqrt(np.maximum(1, target.sum(axis=0)))[[y for _, y in rows]]
    balance /= balance.sum()
    weights, bias = np.zeros((used.size, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    speed, bias_speed = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(rounds):
        z = np.add.reduceat(weights[at], first, axis=0) * scale + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = ((p / p.sum(axis=1, keepdims=True) - target) * balance[:, None]).astype(np.float32)
        step = np.add.reduceat((error * scale)[row[order]], starts, axis=0)
        speed = 0.9 * speed - rate * len(FAMILIES) * step - decay * weights
        bias_speed = 0.9 * bias_speed - rate * error.sum(axis=0)
        weights, bias = weights + speed, bias + bias_speed
    full = np.zeros((BUCKETS + 1, len(FAMILIES)))
    full[used], full[-1] = weights, bias
    return Classifier(full)


def train(unknown: list[str], folds: int = 3) -> Classifier:
    """Fitted on all examples; the temperature makes each fold's wordings, scored by a model fitted without them, most likely."""
    rows = examples([p for p in unknown if words(p)], folds)
    logits, labels = [], []
    for k in range(folds):
        part = fit([(x, y) for x, y, fold in rows if fold != k])
        held = [(x, y) for x, y, fold in rows if fold == k]
        logits += [part.logits(x) for x, _ in held]
        labels += [y for _, y in held]
    z, labels = np.array(logits), np.array(labels)
    losses = {}
    for t in np.geomspace(0.1, 10, 41):
        y = z / t
        y -= y.max(axis=1, keepdims=True)
        losses[float(t)] = -(y[np.arange(labels.size), labels] - np.log(np.exp(y).sum(axis=1))).mean()
    model = fit([(x, y) for x, y, _ in rows])
    model.temperature = min(losses, key=losses.get)
    return model


class Judge:
    """Classifies a window of words and confirms its family by the templates."""

    def __init__(self, model: Classifier, threshold: float, agreement: float):
        self.model, self.threshold, self.agreement = model, threshold, agreement
        self.own: dict[int, list[Template]] = {}
        for t in templates():
            self.own.setdefault(t.family, []).append(t)

    def __call__(self, marked: list[str], lengths: range = range(10**6)) -> tuple[int, float] | None:
        tokens = [w for w in marked if w[0].isalnum()]
        if not tokens:
            return None
        p = self.model.probabilities(buckets(tokens))
        k = int(p.argmax())
        return (k, float(p[k])) if FAMILIES[k] != UNKNOWN and p[k] >= self.threshold and self.confirms(k, tokens, marked, lengths) else None

    def confirms(self, family: int, tokens: list[str], marked: list[str], lengths: range) -> bool:
        here, stands = set(tokens), {}
        for t in self.own[family]:
            if len(t.tokens) not in lengths or t.heading and len(tokens) > len(t.tokens) + 3 or len(t.distinct & here) < self.agreement * len(t.distinct):
                continue
            if t.core and not stands.setdefault(t.core, core_stands(t.core, marked)):
                continue
            if shared_order(t.tokens, tokens) >= self.agreement:
                return True
        return False


def windows(tokens: list[str], size: int = WINDOW) -> Iterator[list[str]]:
    for start in range(0, max(1, len(tokens) - size // 2), size // 2):
        yield tokens[start : start + size]


def blocks(lines: list[str]) -> Iterator[list[str]]:
    """Runs of lines that are not blank, without comment marks at their starts."""
    block: list[str] = []
    for line in lines:
        if bare := _COMMENT.sub("", line, count=1).strip():
            block.append(bare)
        elif block:
            yield block
            block = []
    if block:
        yield block


def first_words(agreement: float) -> set[str]:
    """Words one of which every confirmed paragraph has: for each template the rarest of its core, or so many of its rarest words
    that not all of them can be among those that the agreement allows to be missing."""
    times: dict[str, int] = {}
    for t in templates():
        for w in t.distinct:
            times[w] = times.get(w, 0) + 1
    out: set[str] = set()
    for t in templates():
        rare = sorted(t.core or t.distinct, key=lambda w: (times[w], -len(w), w))
        out |= {*rare[: 1 if t.core else len(t.distinct) - int(np.ceil(agreement * len(t.distinct))) + 1]}
    return out


def learn(documents: DataFrame) -> Classifier:
    """The classifier, with a paragraph of each of SAMPLE documents as `unknown`: those of the least hashes of their ids."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(SAMPLE)  # the column of ids alone
    some = docs.where(F.col("doc_id").isin([r[0] for r in ids.collect()]))
    some = some.select(F.split("text", "\n").alias("lines"), F.xxhash64("doc_id", F.lit(5)).alias("h")).select(F.expr("element_at(lines, cast(pmod(h, size(lines)) as int) + 1)").alias("line"))
    marks = "(?i)licen[sc]e|permission|redistribut|warrant|copyright|spdx|apache|creative commons|\\bcc"
    # of many texts with one of these ids no more than four times the sample, the least ones
    return train([r[0] for r in some.where(F.col("line").isNotNull() & ~F.col("line").rlike(marks)).distinct().orderBy("line").limit(4 * SAMPLE).collect()])


def scan(documents: DataFrame, threshold: float = 0.5, agreement: float = 0.75, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licence (those with a confirmed licence, and for each block its families beyond those), licences (families, sorted and joined by commas),
    confidence (the highest of a confirmed paragraph, else 0)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(classifier or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, keys = Judge(model.value, threshold, agreement), first_words(agreement)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                lowered = (text or "").lower()
                paragraphs = [p for p in lowered.split("\n") if p.strip()]
                here = any(c in lowered for c in CUES)
                found, lines = [], {}
                for p in paragraphs if here else ():
                    if any(c in p for c in CUES) and not keys.isdisjoint(marked := sentence_words(p)):
                        verdicts = [v for w in windows(marked) if not keys.isdisjoint(w) and (v := judge(w))]
                        if verdicts:
                            found.append(max(verdicts, key=lambda v: v[1]))
                            lines.setdefault(_COMMENT.sub("", p, count=1).strip(), set()).update(k for k, _ in verdicts)
                for block in blocks(lowered.split("\n")) if here else ():
                    if len(block) > 1 and any(c in p for p in block for c in CUES):
                        marked, best = sentence_words("\n".join(block)), {}
                        for size, lengths in BLOCK_WINDOWS.items():
                            for w in windows(marked, size):
                                if not keys.isdisjoint(w) and (v := judge(w, lengths)):
                                    best[v[0]] = max(v[1], best.get(v[0], 0.0))
                        known = {k for p in block for k in lines.get(p, ())}
                        found += [(k, c) for k, c in best.items() if k not in known]
                rows.append((len(paragraphs), len(found), ",".join(sorted({FAMILIES[k] for k, _ in found})), max((c for _, c in found), default=0.0)))
            columns = [*zip(*rows, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True))], names=["doc_id", "n_paragraphs", "n_licence", "licences", "confidence"])

    return docs.mapInArrow(run, "doc_id long, n_paragraphs long, n_licence long, licences string, confidence double")
