"""Licence scans: a trained paragraph classifier confirmed by templates, with Spark expressions only.

A paragraph is a line, or a run of neighbouring lines that may each declare a licence, taken as one (a licence text broken
over lines). Its features are its distinct 1- and 2-grams of words (lower-cased runs of letters, digits and dots), a
sparse vector. A multinomial logistic regression over licence families and `unknown` is fitted, on the driver, to a fixed
and bounded set: pieces of each family's templates, and as many made-up and neutral lines, plus up to `n_unknown` distinct
lines of whole texts that overlap no template. The temperature and the least probability (calibrated unknown class) come
from templates and lines that a fit has not seen: they are parted in two before pieces are made of them, a fit to each
part is scored on the other, and the weights are those of a third fit to all. Only families can be predicted whose
name and version, or a clause that is theirs alone, the paragraph holds (KEYS), and nothing of a near relation's (RIVALS):
LGPL, AGPL and the GPL's versions differ by these few words, and what several licences share declares none. A prediction is
confirmed if enough of the family's best template is in the paragraph, or of the paragraph in the template. "All rights
reserved", which public licences say too, declares only where nothing else does.

Which lines are scored follows from the templates and neutral lines alone, never from the sample: those with a cue (a word
of templates that no neutral line has), or a 2-gram of a template with a word of LONG letters or more, and those of at most
SHORT words that are all of templates. What other lines share with templates are short, common words: they declare nothing.

Scoring is one projection of each text by itself: nothing is shuffled, and a row gives a row. Weights (a few thousand
numbers, whose count the templates bound) are constants of the expression.

Cases: a null or empty text has one empty line and no candidate; a null doc_id stays null; each input row is judged by
itself (rows that repeat a doc_id give that many rows); a very long line or text is taken whole by the task that has it; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and of declarations that name them, by family (fixed values).
TEMPLATES = {
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
        "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution.",
    ),
    "mit": (
        "This software is released under the MIT license; its terms are in the file that comes with it.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "The code is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the GNU GPL, version 3 or later.",
        "All files are licensed under the GNU General Public License, version 3 or any later one.",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Distributed under the GNU GPL, version 2 or later.",
        "All files are licensed under the GNU General Public License, version 2 of June 1991.",
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Distributed under the GNU LGPL, version 2.1 or later.",
        "The library is licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "lgpl-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "Distributed under the GNU LGPL, version 3 or later.",
        "The library is licensed under the GNU Lesser General Public License, version 3.",
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Distributed under the GNU AGPL, version 3 or later.",
        "The server is licensed under the GNU Affero General Public License, version 3.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
        "The code is available under the MPL 2.0.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License.",
        "The code is licensed under the ISC license.",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "This work is marked with CC0 1.0 Universal.",
        "Released into the public domain under CC0.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the 3-clause BSD license.",
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors as is",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the 2-clause BSD license.",
        "Use of this code is governed by the simplified BSD license of two clauses.",
    ),
    "cc-by-4.0": (
        "The text is available under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under Creative Commons Attribution 4.0 International (CC BY 4.0).",
    ),
    "cc-by-nc-4.0": (
        "The text is available under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under Creative Commons Attribution-NonCommercial 4.0 International (CC BY-NC 4.0).",
    ),
    "cc-by-sa-4.0": (
        "The text is available under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Licensed under Creative Commons Attribution-ShareAlike 4.0 International (CC BY-SA 4.0).",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without written permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "Copyright by the author, all rights reserved.",
        "All rights are reserved by the publisher.",
        "Rights reserved by the owner.",
    ),
}
#: What a paragraph of a family must hold, one of these lists in whole: names, versions and clauses that are its alone (fixed
#: values). What several licences share (a warranty, a redistribution clause, a licence without its version) confirms none.
KEYS = {
    "apache-2.0": (("apache 2.0",), ("apache license", "version 2.0")),
    "mit": (("mit",), ("person obtaining", "deal in"), ("permission notice", "substantial portions")),
    "gpl-3.0": (("general public", "version 3"), ("gnu gpl", "version 3"), ("gpl 3.0",)),
    "gpl-2.0": (("general public", "version 2"), ("gnu gpl", "version 2"), ("gpl 2.0",)),
    "lgpl-2.1": (("lesser general", "version 2.1"), ("gnu lgpl", "version 2.1"), ("lgpl 2.1",)),
    "lgpl-3.0": (("lesser general", "version 3"), ("gnu lgpl", "version 3"), ("lgpl 3.0",)),
    "agpl-3.0": (("affero general", "version 3"), ("gnu agpl", "version 3"), ("agpl 3.0",)),
    "mpl-2.0": (("mozilla public", "v 2.0"), ("mozilla public", "version 2.0"), ("mpl 2.0",)),
    "isc": (("without fee", "hereby granted"), ("isc license",), ("identifier isc",)),
    "cc0-1.0": (("cc0",),),
    "bsd-3-clause": (("neither the", "endorse or"), ("bsd style",), ("bsd 3",), ("3 clause", "clause bsd")),
    "bsd-2-clause": (("redistributions in", "binary form", "provided by"), ("bsd 2",), ("2 clause", "clause bsd"), ("simplified bsd",)),
    "cc-by-4.0": (("by 4.0",), ("attribution 4.0",)),
    "cc-by-nc-4.0": (("nc 4.0",), ("noncommercial 4.0",)),
    "cc-by-sa-4.0": (("sa 4.0",), ("sharealike 4.0",)),
    "proprietary": (("rights reserved",), ("rights are", "are reserved"), ("proprietary and",), ("unauthorized copying",)),
}
#: What it must not hold: marks of its nearest relations (fixed values).
RIVALS = {
    "gpl-3.0": ("lesser", "lgpl", "affero", "agpl", "version 2", "gpl 2.0"),
    "gpl-2.0": ("lesser", "lgpl", "affero", "agpl", "version 3", "gpl 3.0"),
    "lgpl-2.1": ("affero", "agpl", "version 3"),
    "lgpl-3.0": ("affero", "agpl", "version 2.1"),
    "agpl-3.0": ("lesser", "lgpl"),
    "bsd-3-clause": ("2 clause",),
    "bsd-2-clause": ("neither the", "3 clause"),
    "cc-by-4.0": ("nc 4.0", "noncommercial", "sa 4.0", "sharealike"),
    "cc-by-nc-4.0": ("sharealike",),
    "cc-by-sa-4.0": ("noncommercial",),
    "mit": ("without fee",),
    "isc": ("person obtaining",),
}
#: A family that public licences' texts seem to declare too ("all rights reserved"): it stands only where no other does,
#: or where a paragraph holds one of these.
WEAK, STRONG = "proprietary", ("proprietary and", "unauthorized copying", "strictly prohibited", "be reproduced")
#: Lines that speak of other things (fixed values).
NEUTRAL = (
    "This page was last edited under review by the work group in version 2 of the report.",
    "You may not use the general entrance; the public door is open and free of charge.",
    "The program runs on this file and the source of the data is the project report.",
    "He passed the driving test and was granted permission to work in the following year.",
    "Please read the terms and conditions of the sale before you use the software.",
    "The attribution of the painting to a person of that name is not certain.",
    "A copy of the letter was released to the press without notice.",
    "No part of the river is open to the public in winter, except in May.",
    "Rights of way on the common are reserved for members.",
    "The following forms are permitted in source and target languages.",
    "It will be with us as an old friend at home or far from it, by day and by night, if that is what you like.",
)
UNKNOWN = "unknown"
#: The score of a family that a paragraph can't be of.
NEVER = -1e9
_WORD = r"[\p{L}\p{N}.]+"
#: Lines that are left out of the sample of unknown ones: with a licence word, or this share of a template's n-grams.
_LICENCE, APART, SHORT, LONG = r"licen[sc]e|spdx|copyright|creative commons|all rights", 0.3, 3, 5


def _words(line: str) -> list[str]:
    return [w for w in (x.strip(".") for x in regex.findall(_WORD, line.lower())) if w]


def _grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def word_list(line: Column) -> Column:
    """The words of a line: lower-cased runs of letters, digits and inner dots."""
    raw = F.regexp_extract_all(F.lower(line), F.lit(_WORD), F.lit(0))
    return F.filter(F.transform(raw, lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def pair_list(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.filter(pairs, lambda p: p.isNotNull())


def gram_list(words: Column) -> Column:
    return F.array_distinct(F.concat(words, pair_list(words)))


_WORDS = {w for family in TEMPLATES.values() for line in family for w in _words(line)}
#: Words of templates that no neutral line has, and 2-grams of templates with a word of LONG letters: a line with one is a
#: candidate.
CUES = sorted(w for w in _WORDS - {w for line in NEUTRAL for w in _words(line)} if not w.isdigit())
GRAMS = sorted({g for family in TEMPLATES.values() for line in family for g in _grams(_words(line))})
PAIRS = [g for g in GRAMS if " " in g and max(map(len, g.split())) >= LONG]


def _strings(values) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")  # folded to one constant


def may_declare(words: Column) -> Column:
    """Whether a line of these words is a candidate."""
    short = (F.size(words) > 0) & (F.size(words) <= SHORT) & (F.size(F.array_except(words, _strings(sorted(_WORDS)))) == 0)
    return F.arrays_overlap(words, _strings(CUES)) | short | F.arrays_overlap(pair_list(words), _strings(PAIRS))


def overlap(shapes: Column, grams: Column, n_grams: Column) -> Column:
    """The greatest share of n-grams, of the smaller side, that a line has in common with one of the templates."""
    return F.array_max(F.transform(shapes, lambda t: F.size(F.array_intersect(t, grams)) / F.least(F.size(t), F.greatest(n_grams, F.lit(1)))))


def can_be(family: str, grams: set[str]) -> bool:
    """told() of a paragraph's n-grams on the driver."""
    return any({*k} <= grams for k in KEYS[family]) and not {*RIVALS.get(family, ())} & grams


def told(family: str, known: Column) -> Column:
    """Whether a paragraph of these n-grams holds what the family's must, and nothing of its relations'."""
    keys = F.array(*[_strings(k) for k in KEYS.get(family, (("-",),))])
    return F.exists(keys, lambda k: F.size(F.array_except(k, known)) == 0) & ~F.arrays_overlap(known, _strings(RIVALS.get(family, ("-",))))


def _shapes(family: str) -> Column:
    return F.array(*[_strings(sorted(_grams(_words(t)))) for t in TEMPLATES.get(family, ("-",))])


class Model:
    """families; weights: a row for each of GRAMS, a column for each family; bias; temperature, least."""

    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.families, self.weights, self.bias = families, weights, bias
        self.temperature, self.least = temperature, least


def unknown_lines(documents: DataFrame, n: int, seed: int) -> list[str]:
    """The n distinct lines of least hash that overlap no template, or all of them if there are fewer."""
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(20, 400)).withColumn("h", F.xxhash64("line", F.lit(seed)))
    distinct = lines.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, 8 * n / max(1, distinct))
    while True:
        # lines of a range of hashes that holds more than n distinct ones; a wider one if too many of them overlap
        some = lines.where(F.col("h") <= F.lit(min(2**63 - 1, int(2**64 * share) - 2**63))).distinct()
        some = some.where(~F.lower("line").rlike(_LICENCE))
        grams = F.array(gram_list(word_list(F.col("line"))))  # bound by transform(), so that it is made once a line
        apart = F.transform(grams, lambda g: F.greatest(*[overlap(_shapes(f), g, F.size(g)) for f in TEMPLATES]))[0] < APART
        found = [r["line"] for r in some.where(apart).select("line", "h").orderBy("h", "line").limit(n).collect()]
        if len(found) == n or share == 1:
            return found
        share = min(1.0, 8 * share)


def _pieces(templates: list[tuple[str, int]], others: list[str], rng: random.Random) -> list[tuple[set[str], int]]:
    """Templates and pieces of them that hold a cue, other words around; other lines, and with a cue among their words."""
    plain = sorted({w for line in [*NEUTRAL, *others] for w in _words(line)})
    sure, rows = {*CUES, *PAIRS}, []
    for line, k in templates:
        w = _words(line)
        rows += [(_grams(w), k)] * 6
        for _ in range(30):
            n = rng.randint(max(3, len(w) // 2), len(w))
            a = rng.randint(0, len(w) - n) if len(w) > n else 0
            around = rng.sample(plain, 4)
            piece = [*around[: rng.randint(0, 2)], *w[a : a + n], *around[2 : 2 + rng.randint(0, 2)]]
            if _grams(piece) & sure:
                rows.append((_grams(piece), k))
        # two words on end, if only this family has them so
        rows += [({*p.split(), p}, k) for p in sorted(_grams(w)) if _OWNERS.get(p) == {k}] * 3
    for line in others:
        w = _words(line)
        rows.append((_grams(w), len(TEMPLATES)))
        for cue in rng.sample(CUES, 1):  # a licence word alone is no declaration
            rows.append((_grams([*w[: len(w) // 2], cue, *w[len(w) // 2 :]]), len(TEMPLATES)))
    rng.shuffle(rows)
    return rows


_PLACE = {g: i for i, g in enumerate(GRAMS)}
#: The families whose templates have a 2-gram with a cue or of two longer words.
_OWNERS = {p: {k for k, family in enumerate(TEMPLATES.values()) if any(p in _grams(_words(line)) for line in family)} for p in PAIRS if {*p.split()} & {*CUES} or min(map(len, p.split())) > 5}


def _sparse(rows: list[tuple[set[str], int]]) -> list[np.ndarray]:
    """Each row's places in GRAMS; place len(GRAMS), whose weight stays 0, stands for none."""
    return [np.array(sorted(_PLACE[g] for g in grams if g in _PLACE) or [len(GRAMS)]) for grams, _ in rows]


def _scores(x: list[np.ndarray], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w[np.concatenate(x)], np.cumsum([0, *map(len, x[:-1])]), axis=0) + b


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _fit(rows: list[tuple[set[str], int]], epochs: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = _sparse(rows), np.array([k for _, k in rows])
    w, b = np.zeros((len(GRAMS) + 1, len(TEMPLATES) + 1)), np.zeros(len(TEMPLATES) + 1)
    for epoch in range(epochs):
        for a in range(0, len(x), 64):
            part = x[a : a + 64]
            z = _softmax(_scores(part, w, b))
            z[np.arange(len(z)), y[a : a + 64]] -= 1
            step = 0.5 * (1 - epoch / epochs) / len(z)
            np.add.at(w, np.concatenate(part), -step * np.repeat(z, [len(i) for i in part], axis=0))
            w *= 1 - 1e-3 * step
            w[-1] = 0
            b -= step * z.sum(0)
    return w, b


def train(documents: DataFrame, n_unknown: int = 500, epochs: int = 60, seed: int = 5) -> Model:
    """Fit to the templates, the neutral lines and at most n_unknown corpus lines."""
    rng = random.Random(seed)
    others = [*NEUTRAL, *unknown_lines(documents, n_unknown, seed)]
    halves = [([(line, k) for k, family in enumerate(TEMPLATES.values()) for line in family[half::2]], others[half::2]) for half in (0, 1)]
    rows = [_pieces(*half, rng) for half in halves]
    z, truth = [], []
    for own, unseen in (rows, rows[::-1]):
        z.append(_scores(_sparse(unseen), *_fit(own, epochs)))
        truth += [k for _, k in unseen]
    z, truth = np.concatenate(z), np.array(truth)
    held = [g for g, _ in rows[1]] + [g for g, _ in rows[0]]
    for k, family in enumerate(TEMPLATES):
        z[[not can_be(family, g) for g in held], k] = NEVER
    at = np.arange(len(z))
    loss = {float(t): -np.log(np.maximum(_softmax(z / t)[at, truth], 1e-12)).mean() for t in np.geomspace(0.25, 8, 41)}
    temperature = min(loss, key=loss.get)
    p = _softmax(z / temperature)
    # the least probability from which on predicted families are right 99 times of 100
    family = np.flatnonzero(p.argmax(1) != len(TEMPLATES))
    family = family[np.argsort(-p[family].max(1), kind="stable")]
    right = np.cumsum(p[family].argmax(1) == truth[family]) >= 0.99 * np.arange(1, len(family) + 1)
    least = float(p[family[np.flatnonzero(right)[-1]]].max()) if right.any() else 0.9
    w, b = _fit([*rows[0], *rows[1]], epochs)
    return Model([*TEMPLATES, UNKNOWN], w[:-1], b, temperature, min(0.9, max(0.3, least)))


def _kept_lines(text: str) -> Column:
    """A text with the lines that can't declare a licence left empty. Each line's words are made once."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(x.alias("line"), word_list(x).alias("words")))
    return F.array_join(F.transform(lines, lambda x: F.when(may_declare(x["words"]), x["line"]).otherwise("")), "\n")


def scan(documents: DataFrame, model: Model | None = None, min_overlap: float = 0.6) -> DataFrame:
    """documents (doc_id, text, ...) -> a row for each input row:

    doc_id, n_paragraphs (lines), n_candidates (lines that may declare a licence), families (sorted, of confirmed
    paragraphs), family (of the surest confirmed paragraph, else `unknown`; of equally sure ones the first, lines before
    runs), score (its probability, else 0), n_unconfirmed (lines predicted to be of a family that no template confirms).
    """
    model = model or train(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_paragraphs"), _kept_lines("text").alias("kept"))
    single = F.filter(F.split("kept", "\n"), lambda x: x != "")
    runs = F.filter(F.transform(F.split("kept", "\n\n+"), lambda x: F.btrim(x, F.lit("\n"))), lambda x: F.contains(x, F.lit("\n")))
    rows = rows.select("doc_id", "n_paragraphs", F.size(single).alias("n_candidates"), F.concat(single, runs).alias("x"))
    column = lambda k: F.split(F.lit(" ".join(map(repr, model.weights[:, k].tolist()))), " ").cast("array<double>")
    vocabulary, columns = _strings(GRAMS), [column(k) for k in range(len(model.families))]
    shapes = F.array(*map(_shapes, model.families))


    def scores(u: Column) -> Column:
        def total(of: Column) -> Column:
            return F.aggregate(u["at"], F.lit(0.0), lambda s, i: s + F.get(of, i - 1))

        sums = map(total, columns)
        z = [F.round((s + float(model.bias[k])) / model.temperature, 9) for k, s in enumerate(sums)]
        return F.array(*[x if f == UNKNOWN else F.when(told(f, u["known"]), x).otherwise(NEVER) for f, x in zip(model.families, z, strict=True)])

    steps = (
        word_list,
        gram_list,
        lambda g: F.struct(F.array_intersect(g, vocabulary).alias("known"), F.size(g).alias("n")),
        lambda u: F.struct(u["known"], u["n"], F.transform(u["known"], lambda g: F.array_position(vocabulary, g).cast("int")).alias("at")),
        lambda u: F.struct(u["known"], u["n"], scores(u).alias("z")),
        lambda u: F.struct(u["known"], u["n"], u["z"], F.array_max(u["z"]).alias("top")),
        lambda u: F.struct(
            u["known"], u["n"], F.array_position(u["z"], u["top"]).cast("int").alias("k"), (1 / F.aggregate(u["z"], F.lit(0.0), lambda s, v: s + F.exp(v - u["top"]))).alias("p")
        ),
        lambda u, i: F.struct((i >= F.col("n_candidates")).alias("run"), F.element_at(_strings(model.families), u["k"]).alias("family"), u["p"], overlap(F.element_at(shapes, u["k"]), u["known"], u["n"]).alias("alike"), F.arrays_overlap(u["known"], _strings(STRONG)).alias("strong")),
    )
    found = F.col("x")
    for step in steps:
        found = F.transform(found, step)
    sure = F.filter(found, lambda u: (u["p"] >= model.least) & (u["family"] != UNKNOWN))
    rows = rows.select("doc_id", "n_paragraphs", "n_candidates", sure.alias("sure"))
    rows = rows.withColumn("ok", F.filter("sure", lambda u: u["alike"] >= min_overlap))
    others = F.exists("ok", lambda u: u["family"] != WEAK)
    rows = rows.withColumn("others", others).withColumn("ok", F.filter("ok", lambda u: (u["family"] != WEAK) | u["strong"] | ~F.col("others")))
    best = F.array_max(F.transform("ok", lambda u, i: F.struct(F.round(u["p"], 6).alias("p"), (-i).alias("i"), u["family"].alias("family"))))
    return rows.select(
        "doc_id", "n_paragraphs", "n_candidates", F.array_sort(F.array_distinct(F.transform("ok", lambda u: u["family"]))).alias("families"),
        F.coalesce(best["family"], F.lit(UNKNOWN)).alias("family"), F.coalesce(best["p"], F.lit(0.0)).alias("score"), F.size(F.filter("sure", lambda u: ~u["run"] & (u["alike"] < min_overlap))).cast("long").alias("n_unconfirmed"),
    )
