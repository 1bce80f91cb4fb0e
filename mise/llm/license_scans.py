"""License scans: a trained paragraph classifier with template comparison.

Paragraphs are the lines of a text and, for notices that are wrapped (also inside comments),
blocks: lines with an anchor that follow each other with one line between them at most, joined
without their marks.  A block stands for its lines where a template confirms it and none of them
alone.  Features are word 1..3-grams of the ASCII
words in lower case; a multinomial logistic regression over licence families and
``none`` is trained on the licence phrases below (whole, shortened and set among
corpus words) against the n-grams of the paragraphs of a bounded sample of documents,
also of those that use a licence word otherwise.  The vocabulary is every n-gram of the
phrases, so a word that is ordinary too (German "mit") has the weights that training
gives it.  Only paragraphs with an anchor, an n-gram of the phrases that no ordinary
paragraph of the sample has, are scored; the others are ``none``.

Unknown class: each family is left out of training once and its phrases are scored
by the others; the probability below which such strangers fall more often than known
phrases is the threshold of ``unknown``.  A prediction is confirmed when
``CONFIRM`` of the n-grams of one of the family's templates stand in the paragraph.

Scoring is SQL expressions only.  Null and empty texts hold no licence; a text with
equal paragraphs reports each; equal texts have equal results; an empty table gives an empty one.  Other
columns stay; one named ``licenses`` is replaced.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

# Short notices of each licence family.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "SPDX-License-Identifier: Apache-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation, either version 3 of the License, or any later version.",
            "Released under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is distributed under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Released under the BSD 3-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Licensed under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights (CC0).",
            "SPDX-License-Identifier: CC0-1.0"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "SPDX-License-Identifier: ISC"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without written permission.",
                    "Copyright the authors. All rights reserved.", "This material is proprietary and confidential."],
}
CUES = ("license", "licence", "licensed", "licenced", "copyright", "copyrighted", "redistribution", "proprietary", "spdx")
GRANTS = ("released under", "licensed under", "licenced under", "distributed under", "available under", "rights reserved", "under the terms")
NONE, UNKNOWN = "none", "unknown"
ORDERS = (1, 2, 3)
SAMPLE_DOCS = 400
NEGATIVE_PARAGRAPHS = 2000
VARIANTS = 8
STEPS = 200
MAX_VOCABULARY = 4000
CONFIRM = 0.6
WORD = re.compile(r"[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.translate(_LOWER))


def grams_of(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i:i + n]) for n in ORDERS for i in range(len(words) - n + 1)})


class Model:
    """Families, one weight row per n-gram, biases, and the unknown threshold."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], bias: list[float], anchors: list[str], threshold: float = 0.0):
        self.classes, self.weights, self.bias, self.anchors, self.threshold = classes, weights, bias, anchors, threshold

    def probs(self, paragraph: str) -> np.ndarray:
        z = np.array(self.bias)
        grams = grams_of(words_of(paragraph))
        if not set(grams) & set(self.anchors):
            return np.array([float(c == NONE) for c in self.classes])
        for g in grams:
            if g in self.weights:
                z = z + np.array(self.weights[g])
        e = np.exp(z - z.max())
        return e / e.sum()


def variants(template: str, filler: list[str], rng) -> list[str]:
    """The phrase whole, with words dropped, and with corpus words before or after."""
    words = template.split()
    out = [template]
    for _ in range(VARIANTS):
        kept = [w for w in words if len(words) < 5 or rng.random() > 0.1] or words
        around = [str(w) for w in rng.choice(filler, int(rng.integers(0, 6)))] if filler else []
        k = int(rng.integers(0, len(around) + 1))
        out.append(" ".join([*around[:k], *kept, *around[k:]]))
    return out


def train(templates: dict[str, list[str]], negatives: list[str], seed: int = 11) -> Model:
    """Full-batch gradient descent on sparse 0/1 features with shrinkage."""
    rng = np.random.default_rng(seed)
    classes = [*templates, NONE]
    filler = [w for p in negatives[:200] for w in p.split()]
    own = [grams_of(words_of(p)) for p in negatives]
    rows = [(p, k) for k, family in enumerate(templates) for t in templates[family] for p in variants(t, filler, rng)]
    count = Counter(g for family in templates for t in templates[family] for g in grams_of(words_of(t)))
    kept = sorted(count, key=lambda g: (g.count(" "), -count[g], g))[:MAX_VOCABULARY - len(CUES)]
    vocab = {g: i for i, g in enumerate(dict.fromkeys([*CUES, *kept]))}
    anchors = sorted((set(vocab) - {g for grams in own for g in grams}) | set(CUES))
    # Equal feature sets of one class are one row with their number.
    patterns = Counter((tuple(sorted(vocab[g] for g in grams_of(words_of(p)) if g in vocab)), k) for p, k in rows)
    patterns.update((tuple(sorted(vocab[g] for g in grams if g in vocab)), len(classes) - 1) for grams in own)
    patterns[((), len(classes) - 1)] += 1
    x = np.zeros((len(patterns), len(vocab)), np.float32)
    y = np.zeros((len(patterns), len(classes)), np.float32)
    for i, (ids, k) in enumerate(patterns):
        x[i, list(ids)] = 1
        y[i, k] = 1
    times = np.array(list(patterns.values()), np.float32)[:, None]
    share = y * times / np.maximum((y * times).sum(0), 1)  # each class weighs the same
    w, b = np.zeros((len(vocab), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    b[-1] = 1.0
    for _ in range(STEPS):
        z = x @ w + b
        e = np.exp(z - z.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - y) * share.sum(1, keepdims=True)
        w -= 2.0 * (x.T @ g + 1e-4 * w)
        b -= 0.5 * g.sum(0)
    b[-1] = max(b[-1], float(b[:-1].max()) + 1.0)  # no vocabulary word: none
    return Model(classes, {g: [round(float(v), 6) for v in w[i]] for g, i in vocab.items()}, [round(float(v), 6) for v in b], anchors)


def calibrate(model: Model, templates: dict[str, list[str]], negatives: list[str]) -> Model:
    """The threshold that best parts known phrases from those of a left-out family."""
    strangers, known = [], []
    for family in templates:
        rest = {f: t for f, t in templates.items() if f != family}
        other = train(rest, negatives)
        for t in templates[family]:
            p = other.probs(t)
            if other.classes[int(p.argmax())] != NONE:
                strangers.append(float(p.max()))
            known.append(float(model.probs(t).max()))
    cuts = sorted({*strangers, *known})
    errors = [(sum(k < c for k in known) / max(1, len(known)) + sum(s >= c for s in strangers) / max(1, len(strangers)), -c) for c in cuts]
    model.threshold = -min(errors)[1] if errors else 0.0
    return model


def is_ordinary(paragraph: str, cue: bool) -> bool:
    """No template stands in the paragraph; where it has a cue word, no two or three words of one with a cue either."""
    grams = set(grams_of(words_of(paragraph)))
    own = [set(grams_of(words_of(t))) for ts in TEMPLATES.values() for t in ts]
    if cue and any(" " in g and set(g.split()) & set(CUES) for o in own for g in o & grams):
        return False
    if cue and any(g in grams for g in GRANTS):
        return False
    return all(len(o & grams) < CONFIRM * len(o) for o in own)


def fit(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model whose ordinary paragraphs come from about ``sample_docs`` documents."""
    sample = hash_sample(docs.select(F.col(text).alias("t")).where("t is not null"), ["t"], sample_docs)
    lines = sample.select(F.explode(F.split("t", "\n")).alias("p")).where(F.length("p") > 0)
    lines = lines.select("p", F.xxhash64("p").alias("h"), F.lower("p").rlike("|".join(CUES)).alias("cue")).distinct()
    some = [r for cue in (False, True) for r in lines.where(F.col("cue") == cue).orderBy("h", "p").limit(NEGATIVE_PARAGRAPHS).collect()]
    negatives = [r.p for r in some if is_ordinary(r.p, r.cue)]
    return calibrate(train(TEMPLATES, negatives), TEMPLATES, negatives)


def _literal(value, kind: str) -> Column:
    """A constant map or array as one folded literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words(paragraph: Column) -> Column:
    folded = F.translate(paragraph, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0))


def _grams(words: Column) -> Column:
    def of(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, some).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(words, *[of(n) for n in ORDERS[1:]]))


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``licenses``: paragraph (0-based first line), n_lines, family, probability, template
    share and whether the template confirms it."""
    every = _literal(sorted(model.weights), "array<string>")
    weights = _literal(model.weights, "map<string,array<double>>")
    bias = _literal(model.bias, "array<double>")
    classes = _literal(model.classes, "array<string>")
    templates = _literal({f: [grams_of(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()}, "map<string,array<array<string>>>")
    # Whole texts first: the lines of a text without an anchor are not looked at.
    cue = "(?i)(?<![a-z0-9])(?:" + trie(model.anchors) + ")(?![a-z0-9])"
    lines = F.when(F.col(text).rlike(cue), F.split(F.col(text), "\n")).otherwise(F.array().cast("array<string>"))
    hits = F.filter(F.transform("__lines", lambda p, i: F.struct(i.alias("paragraph"), p.alias("p"))), lambda s: s["p"].rlike(cue))
    begins = F.filter(F.sequence(F.lit(0), F.size("__hits") - 1), lambda i: (i == 0) | (
        F.get("__hits", i)["paragraph"] - F.get("__hits", i - 1)["paragraph"] > 2))
    begins = F.when(F.size("__hits") > 0, begins).otherwise(F.array().cast("array<int>"))

    def group(i: Column, k: Column) -> Column:
        """A block's lines, after the block itself where it has several."""
        own = F.slice("__hits", i + 1, F.coalesce(F.get("__begins", k + 1), F.size("__hits")) - i)
        alone = F.transform(own, lambda h: F.struct(h["paragraph"].alias("paragraph"), F.lit(1).alias("n_lines"), h["p"].alias("p")))
        first, last = F.get(own, 0)["paragraph"], F.get(own, F.size(own) - 1)["paragraph"]
        block = F.struct(first.alias("paragraph"), (last - first + 1).alias("n_lines"), F.array_join(F.slice("__lines", first + 1, last - first + 1), " ").alias("p"))
        return F.when(F.size(own) > 1, F.concat(F.array(block), alone)).otherwise(alone)

    def each(name: str, *kept: str, **new) -> Column:
        """Every paragraph of every group with ``kept`` fields and new ones."""
        return F.transform(name, lambda g: F.transform(g, lambda s: F.struct(*[s[c].alias(c) for c in ("paragraph", "n_lines", *kept)], *[f(s).alias(c) for c, f in new.items()])))

    out = docs.withColumn("__lines", lines).withColumn("__hits", hits).withColumn("__begins", begins)
    out = out.withColumn("__groups", F.transform("__begins", group))
    out = out.withColumn("__words", each("__groups", words=lambda s: _words(s["p"])))
    out = out.withColumn("__grams", each("__words", grams=lambda s: _grams(s["words"])))
    out = out.withColumn("__logits", each("__grams", "grams", z=lambda s: F.aggregate(
        F.array_intersect(s["grams"], every), bias, lambda acc, g: F.zip_with(acc, weights[g], lambda a, b: a + b))))
    out = out.withColumn("__scored", each(
        "__logits", "grams", best=lambda s: F.get(classes, F.array_position(s["z"], F.array_max(s["z"])).cast("int") - 1),
        probability=lambda s: F.lit(1.0) / F.aggregate(s["z"], F.lit(0.0), lambda acc, z: acc + F.exp(z - F.array_max(s["z"])))))
    out = out.withColumn("__shared", each(
        "__scored", "best", "probability", template_share=lambda s: F.coalesce(F.array_max(F.transform(
            F.element_at(templates, s["best"]), lambda t: F.size(F.array_intersect(t, s["grams"])) / F.size(t))), F.lit(0.0))))
    sure = lambda s: (s["best"] != NONE) & (s["template_share"] >= CONFIRM)
    picked = F.flatten(F.transform("__shared", lambda g: F.when(F.size(g) == 1, g).when(
        sure(F.get(g, 0)) & ~F.exists(F.slice(g, 2, F.size(g)), sure), F.slice(g, 1, 1)).otherwise(F.slice(g, 2, F.size(g)))))
    final = F.transform(F.filter(picked, lambda s: s["best"] != NONE), lambda s: F.struct(
        s["paragraph"].cast("long").alias("paragraph"), s["n_lines"].cast("long").alias("n_lines"),
        F.when((s["probability"] < model.threshold) & (s["template_share"] < CONFIRM), F.lit(UNKNOWN)).otherwise(s["best"]).alias("family"),
        s["probability"].alias("probability"), s["template_share"].alias("template_share"),
        (s["template_share"] >= CONFIRM).alias("confirmed")))
    return out.withColumn("licenses", final).drop("__lines", "__hits", "__begins", "__groups", "__words", "__grams", "__logits", "__scored", "__shared")


def trie(words: list[str]) -> str:
    """An alternation that branches once per character; a space stands for what parts words."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def render(node: dict) -> str:
        parts = [("[^a-z0-9]+" if c == " " else re.escape(c)) + render(child) for c, child in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return f"(?:{body})?" if "" in node else body

    return render(tree)


def families(name: str = "licenses") -> Column:
    """The families of a text, each once, comma-joined in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(name, lambda x: x["family"]))), ",")
