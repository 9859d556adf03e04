"""Licence scan: a trained paragraph classifier over word n-grams, confirmed by templates.

Training happens on the driver over fixed notices; scoring is DataFrame work without user functions.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.plans.storage import stored

UNKNOWN = "unknown"
VARIANTS = 40  # training rows made from each notice
THRESHOLD = 0.5
COVERAGE = 0.5  # share of a template's weight that confirms a prediction

# Usual notices of each licence family.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "Licensed under Apache 2.0.",
        "Under the Apache License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the 2-Clause BSD License.",
        "Under the BSD license.",
        "Under a BSD-style license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY 3.0.",
        "Under a Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Under a Creative Commons Attribution-NonCommercial-ShareAlike License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This content may be shared under CC BY-NC-ND 4.0.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL v3 or later.",
        "Released under GPLv3.",
        "Licensed under the GPL v2.",
        "Under GPLv2.",
        "Under the GNU GPL.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Under an MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
}
# Sentences with words of notices that license nothing.
OTHERS = (
    "He lost his driving license in May and had to apply for a new one.",
    "The apache helicopter was released under the terms of the contract.",
    "Students at MIT presented their work in version 2 of the paper.",
    "The general public may use the library free of charge.",
    "A license is required to sell food at the market.",
    "The software was published by a company from Texas with permission of the author.",
    "All rights reserved. Copyright of the publisher.",
    "The commercial is under review by the creative team.",
    "The work of the foundation is known around the world.",
    "Version 3 of the file was modified without notice.",
    "You can use this form to redistribute the load and conditions are met.",
    "The committee licensed the new stadium for concerts.",
    "A common attribution in the sciences names all authors.",
)
# One of these n-grams has to stand in a passage of the family, none of the next ones.
NAMES = {
    "Apache-2.0": ("apache license", "apache 2"),
    "BSD": ("bsd license", "bsd style", "bsd 2", "bsd 3", "binary forms"),
    "CC-BY": ("creative commons", "cc by"),
    "CC-BY-NC": ("by nc", "attribution noncommercial"),
    "GPL": ("gnu general", "gnu gpl", "gpl v2", "gpl v3", "gpl 2", "gpl 3", "gpl version", "gpl license", "gplv2", "gplv3"),
    "MIT": ("mit license", "identifier mit", "hereby granted"),
}
REFUTED = {
    "CC-BY": ("by nc", "attribution noncommercial"),
    "GPL": ("lesser general", "library general", "affero general", "gnu lesser", "gnu affero"),
    "MIT": ("mit like",),
}
NEGATED = (
    "not licensed", "not released", "not distributed", "not published", "not available", "not covered", "not under",
    "not governed", "never licensed", "never released", "t licensed", "t released",
)
_OPEN_NEGATION = (
    r"\b((?:not|never) (?:licensed|released|distributed|published|available|covered|governed|under|made|provided|subject))([^\n.;:!?]{0,60})\n"
)
# What notices are made of; names of the known families and of others.
SUBJECTS = ("", "this work is", "this software is", "this file is", "the code is", "all content is", "our library is", "code")
VERBS = (
    "licensed under", "released under", "distributed under", "available under", "published under", "provided under",
    "made available under the terms of", "covered by", "subject to", "governed by", "licensed under the terms of",
)
WORDINGS = {
    "Apache-2.0": ("the apache license version 2 0", "apache license 2 0", "the apache 2 0 license", "apache 2 0"),
    "BSD": ("the bsd license", "the bsd 3 clause license", "a bsd style license", "the 2 clause bsd license", "the new bsd license"),
    "CC-BY": (
        "cc by 4 0", "cc by sa 4 0", "cc by 3 0", "the creative commons attribution 4 0 international license",
        "a creative commons attribution sharealike license",
    ),
    "CC-BY-NC": (
        "cc by nc 4 0", "cc by nc sa 4 0", "cc by nc nd 4 0",
        "a creative commons attribution noncommercial 4 0 international license",
        "the creative commons attribution noncommercial sharealike license",
    ),
    "GPL": (
        "the gnu general public license version 3", "the gnu general public license version 2 or later", "the gnu gpl v3",
        "gplv3", "gplv2", "gpl 3 0 or later", "the gpl v2", "the gnu gpl",
    ),
    "MIT": ("the mit license", "an mit license", "the expat mit license"),
    UNKNOWN: (
        "the mozilla public license 2 0", "the isc license", "the eclipse public license 2 0", "the zlib license",
        "the unlicense", "the gnu lesser general public license version 3", "the lgpl v3", "a commercial license",
        "the gnu affero general public license version 3", "the agpl v3", "the artistic license 2 0", "a proprietary license",
        "the boost software license 1 0", "the microsoft public license", "the european union public license 1 2",
        "the mit like foo license", "the apple public source license", "the open software license 3 0",
        "the python software foundation license", "the common development and distribution license",
        "the sil open font license 1 1", "the academic free license", "the educational community license 2 0",
    ),
}
# Words that are in most texts.
USUAL = frozenset(
    "a an and any are as be by can first following for free found from in is it may nd not of on only or project provided "
    "public shared source text that the this to under use version with without work you".split()
)


def _tokens(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower().replace("licence", "license")).split()


def _features(tokens: list[str]) -> set[str]:
    return set(tokens) | {f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)}


@dataclass(frozen=True)
class Model:
    families: list[str]  # the last one is unknown
    bias: list[float]
    weights: dict[str, list[float]]
    templates: list[tuple[int, frozenset[str]]]  # family and n-grams of each notice
    temperature: float


def wordings(held_out: bool, rng: random.Random, share: float = 1.0) -> list[tuple[list[str], str]]:
    """Words and family of made notices. One in four pairs of subject and verb, and the last six unknown names, are
    in the held-out part only; of the other part a share is drawn."""
    rows = []
    for i, (subject, verb) in enumerate((s, v) for s in SUBJECTS for v in VERBS):
        for family, names in WORDINGS.items():
            if family == UNKNOWN:
                names = names[-6:] if held_out else names[:-6]
            for name in names:
                if (i % 4 == 3) == held_out and rng.random() < share:
                    rows.append((f"{subject} {verb} {name}".split(), family))
                    if family != UNKNOWN and subject.endswith("is") and rng.random() < 0.3:
                        rows.append((f"{subject} not {verb} {name}".split(), UNKNOWN))
    return rows


def fit(variants: int = VARIANTS, rounds: int = 300, seed: int = 3) -> Model:
    """Softmax regression with a quadratic penalty; held-out wordings set the temperature."""
    rng = random.Random(seed)
    families = [*sorted(NOTICES), UNKNOWN]
    rows: list[tuple[set[str], int]] = []
    for label, family in enumerate(families):
        for text in NOTICES.get(family, OTHERS):
            tokens = _tokens(text)
            rows.append((_features(tokens), label))
            for _ in range(variants):
                part = [t for t in tokens if rng.random() > (0.3 if family == UNKNOWN else 0.12)]
                rows.append((_features(part), label))
    rows += [(set(), len(families) - 1)] * variants
    rows += [(_features(tokens), families.index(family)) for tokens, family in wordings(False, rng, 0.4)]
    held = [(_features(tokens), families.index(family)) for tokens, family in wordings(True, rng, 0.5)]
    index = {f: i for i, f in enumerate(sorted(set().union(*(f for f, _ in rows))))}

    def matrix(some: list[tuple[set[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(some), len(index) + 1), np.float32)
        x[:, -1] = 1
        for i, (found, _) in enumerate(some):
            x[i, [index[f] for f in found if f in index]] = 1
        return x, np.array([label for _, label in some])

    x, y = matrix(rows)
    truth = np.eye(len(families), dtype=np.float32)[y]
    w = np.zeros((x.shape[1], len(families)), np.float32)
    for _ in range(rounds):
        p = _softmax(x @ w)
        w += 2.0 / len(x) ** 0.5 * (x.T @ (truth - p) / len(x) ** 0.5 - 0.02 * w)
    other, named = matrix(held)
    score = other @ w
    loss = lambda t: -np.log(_softmax(score / t)[np.arange(len(score)), named] + 1e-12).mean()
    best = min((0.25, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    templates = [(i, frozenset(_features(_tokens(t)))) for i, f in enumerate(families[:-1]) for t in NOTICES[f]]
    return Model(
        families, [float(v) for v in w[-1]], {f: [float(v) for v in w[i]] for f, i in index.items()}, templates, best
    )


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _telling(model: Model) -> dict[str, int]:
    """Weight of each n-gram of the templates: the fewer templates have it, the more it tells; one with a usual word
    tells half."""
    held: dict[str, int] = {}
    for _, grams in model.templates:
        for g in grams:
            held[g] = held.get(g, 0) + 1
    usual = lambda g: 50 if USUAL & set(g.split()) else 100
    return {g: round(usual(g) * math.log((1 + len(model.templates)) / n)) for g, n in held.items()}


def _bits(model: Model, grams_of: dict[str, tuple[str, ...]], gram: str) -> int:
    return sum(1 << i for i, f in enumerate(model.families) if gram in grams_of.get(f, ()))


def _grams(model: Model) -> list[str]:
    """All n-grams that weigh, name, refute or negate something."""
    return sorted(set(model.weights).union(NEGATED, *NAMES.values(), *REFUTED.values()))


def _words(text: Column) -> Column:
    """Runs of a-z and 0-9."""
    return F.array_remove(F.split(text, "[^a-z0-9]+"), "")


def _known_words(text: Column, model: Model) -> Column:
    """Words in their places; null for one that is in no known n-gram, as then no n-gram with it is known."""
    known = sorted({w for gram in _grams(model) for w in gram.split()})
    return F.transform(_words(text), lambda w: F.when(w.isin(known), w))


def _ngrams(tokens: Column) -> Column:
    """Distinct words and pairs of neighbours; a pair with an unknown word is null and not looked up."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(tokens, pairs))


def _table(spark: SparkSession, model: Model) -> DataFrame:
    """gram, weights, what it adds to each template, and bits of the families it names or refutes.

    It has as many rows as the fixed notices and wordings have n-grams.
    """
    telling, every = _telling(model), (1 << len(model.families)) - 1
    names = [f"w{i}" for i in range(len(model.families))] + [f"t{j}" for j in range(len(model.templates))]
    rows = [
        (
            gram, *model.weights.get(gram, [0.0] * len(model.families)),
            *(telling[gram] if gram in own else 0 for _, own in model.templates),
            _bits(model, NAMES, gram), every if gram in NEGATED else _bits(model, REFUTED, gram),
        )
        for gram in _grams(model)
    ]
    kinds = ", ".join(f"{n} {'double' if n[0] == 'w' else 'int'}" for n in names)
    return spark.createDataFrame(rows, f"gram string, {kinds}, named int, refuted int")


def _distinctive(model: Model) -> list[str]:
    """Words without any of which no template reaches ``COVERAGE``; usual words come last."""
    chosen: set[str] = set()
    telling = _telling(model)
    weight = lambda grams: sum(telling[g] for g in grams)
    for _, grams in model.templates:
        while weight(left := [g for g in grams if not chosen & set(g.split())]) >= COVERAGE * weight(grams):
            hit = lambda w: sum(telling[g] for g in left if w in g.split())  # noqa: B023, E731
            chosen.add(min(sorted({w for g in left for w in g.split()}), key=lambda w: (w in USUAL, -hit(w), -len(w))))
    return sorted(chosen)


def _length(grams: frozenset[str]) -> int:
    """At least as many words as the notice of these n-grams has; no notice has more than one pair of words twice."""
    return 2 + sum(" " in g for g in grams)


UNIT = ("doc_id", "row", "first", "last")


def _scored(units: DataFrame, model: Model, repeats: DataFrame | None = None) -> DataFrame:
    """doc_id, row, first, last, family, probability, coverage, confirmed and cover (of each family) of every unit.

    ``units``: doc_id, row (a key of the row's content), first, last, tokens (as ``_known_words`` gives them), and
    inner: words between the first and the last line, which have to be fewer than the template's for it to count.
    ``repeats``: doc_id, row and copies of the rows that stand in the table more than once, whose n-grams are added up
    once per copy.
    """
    hits = units.select(*UNIT, "inner", F.explode(_ngrams(F.col("tokens"))).alias("gram")).join(
        F.broadcast(_table(units.sparkSession, model)), "gram"
    )
    n_families, n_templates = len(model.families), len(model.templates)
    sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(n_families)]
    sums += [F.sum(f"t{j}").alias(f"t{j}") for j in range(n_templates)]
    sums += [F.bit_or(name).alias(name) for name in ("named", "refuted")]
    total = hits.groupBy(*UNIT, "inner").agg(*sums).withColumn("copies", F.lit(1))
    if repeats is not None:
        known = repeats.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("copies").alias("_copies"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
        total = total.join(known, same, "left").withColumn("copies", F.coalesce("_copies", "copies"))
    each = lambda name: F.col(name) / F.col("copies")
    scores = F.array(*[(each(f"w{i}") + model.bias[i]) / model.temperature for i in range(n_families)])
    telling = _telling(model)
    share = lambda j, g: F.when(
        F.col("inner") < _length(g), each(f"t{j}") / sum(telling[x] for x in g)
    ).otherwise(0.0)
    covered = [
        F.greatest(F.lit(0.0), *[share(j, g) for j, (own, g) in enumerate(model.templates) if own == i])
        for i in range(n_families - 1)
    ]
    ranked = total.select(
        *UNIT, "named", "refuted", scores.alias("scores"), F.array(*covered, F.lit(0.0)).alias("cover")
    )
    top: Column = F.array_max("scores")
    spread = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    best = (F.array_position("scores", top) - 1).cast("int")
    named = ranked.select(*UNIT, "named", "refuted", best.alias("best"), (1 / spread).alias("probability"), "cover")
    bit = F.expr("shiftleft(1, best)")
    fitting = (F.col("named").bitwiseAND(bit) != 0) & (F.col("refuted").bitwiseAND(bit) == 0)
    sure = (F.col("probability") >= THRESHOLD) & (F.col("best") < n_families - 1) & fitting
    coverage = F.get("cover", F.col("best"))
    return named.select(
        *UNIT, "best",
        F.when(sure, F.get(F.array(*[F.lit(f) for f in model.families]), F.col("best"))).otherwise(UNKNOWN).alias("family"),
        "probability", coverage.alias("coverage"), (sure & (coverage >= COVERAGE)).alias("confirmed"), "cover",
    )


def _runs(rows: DataFrame, model: Model) -> DataFrame:
    """Runs of lines that may hold a notice, as units; ``rows``: doc_id, row and lines (arrays of ``_known_words``).

    A run has no line without words. Fewer words than the longest template lie between its first and last line, so
    that a notice is within a run however it is wrapped. One without a distinctive word is confirmed by no template.
    """
    longest = max(_length(g) for _, g in model.templates)
    marks = F.array(*[F.lit(w) for w in _distinctive(model)])
    windows = rows.select(
        "doc_id", "row", F.posexplode(F.transform("lines", lambda x, i: F.slice("lines", i + 1, longest + 1))).alias("first", "_w")
    ).filter((F.size(F.get("_w", F.lit(0))) > 0) & F.arrays_overlap(F.flatten("_w"), marks))
    # Blank lines end a window; what is then left of it is nowhere empty.
    blank = F.array_position(F.transform("_w", lambda x: F.size(x) == 0), F.lit(True))
    windows = windows.withColumn("_w", F.when(blank > 0, F.slice("_w", F.lit(1), (blank - 1).cast("int"))).otherwise(F.col("_w")))
    runs = windows.select("doc_id", "row", "first", "_w", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("_k"))
    inner = F.aggregate(
        F.slice("_w", F.lit(2), F.greatest(F.col("_k") - 2, F.lit(0))), F.lit(0), lambda acc, x: acc + F.size(x)
    )
    runs = runs.withColumn("inner", inner).filter(F.col("inner") < longest)
    runs = runs.withColumn("tokens", F.flatten(F.slice("_w", F.lit(1), F.col("_k"))))
    return runs.filter(F.arrays_overlap("tokens", marks)).select(
        "doc_id", "row", "first", (F.col("first") + F.col("_k") - 1).alias("last"), "inner", "tokens"
    )


def _wrapped(runs: DataFrame) -> DataFrame:
    """Of scored runs, the confirmed notices over several lines; those of one family do not overlap.

    Both end lines add to the coverage of such a run. Of runs that overlap the one with the highest coverage stays,
    then the more probable, the shorter and the first.
    """
    by_last, by_first = Window.partitionBy("doc_id", "row", "last").orderBy("first"), Window.partitionBy("doc_id", "row", "first").orderBy("last")
    near = runs.select(
        "*", F.lead("first").over(by_last).alias("_f"), F.lead("cover").over(by_last).alias("_fc"),
        F.lag("last").over(by_first).alias("_l"), F.lag("cover").over(by_first).alias("_lc"),
    )
    part = lambda there, cover: F.when(there, F.get(cover, F.col("best"))).otherwise(0.0)
    tight = near.filter(
        F.col("confirmed") & (F.col("last") > F.col("first"))
        & (F.col("coverage") > part(F.col("_f") == F.col("first") + 1, "_fc"))
        & (F.col("coverage") > part(F.col("_l") == F.col("last") - 1, "_lc"))
    )
    ranked = F.struct(
        (-F.col("coverage")).alias("c"), (-F.col("probability")).alias("p"), (F.col("last") - F.col("first")).alias("n"),
        "first", "last", "family", "probability", "coverage",
    )
    every = tight.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(ranked)).alias("_runs"))
    clash = lambda x, r: (x["family"] == r["family"]) & (x["first"] <= r["last"]) & (r["first"] <= x["last"])
    kept = F.aggregate(
        "_runs", F.slice("_runs", 1, 0),
        lambda acc, r: F.when(F.exists(acc, lambda x: clash(x, r)), acc).otherwise(F.concat(acc, F.array(r))),
    )
    return every.select("doc_id", "row", F.inline(kept)).drop("c", "p", "n")


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, known: bool = False
) -> DataFrame:
    """doc_id, paragraph, last_line, family, probability, coverage, confirmed of every passage with a known n-gram.

    A passage is a line, or a run of lines without a blank one that holds more of a notice than its parts; it takes
    the place of its lines that are of its family, not confirmed, or of a lower coverage. ``paragraph`` is the number of
    its first line. Words are runs of a-z and 0-9 after lower-casing; a line without any is blank. N-grams count once.
    Coverage is the share of a template's weight, where n-grams of few templates weigh more. A family needs one of its
    ``NAMES`` in the passage and nothing that refutes it; it is confirmed by half of a template. A line without any
    known n-gram is unknown by the model and has no row; with ``known`` no unknown one has. Null and empty texts have no
    lines. Lines of any length are read whole. Rows are told apart by id and text: rows with one id are read one by one,
    and rows that repeat both have their passages once.
    """
    model = model or fit()
    return _passages(_rows(docs, doc_id, text), model, known).drop("row")


def _rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    lowered = F.replace(F.lower(whole), F.lit("licence"), F.lit("license"))
    # A line that goes on after a negation would be a notice by itself: the negation is said again at its start.
    for word in ("not", "never"):
        lowered = F.replace(lowered, F.lit(f" {word}\n"), F.lit(f"\n{word} "))
    negated = F.contains(lowered, F.lit("not ")) | F.contains(lowered, F.lit("never "))
    lowered = F.when(negated, F.regexp_replace(lowered, _OPEN_NEGATION, "$1$2\n$1 ")).otherwise(lowered)
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("row"), lowered.alias("text"))


def _passages(rows: DataFrame, model: Model, known: bool) -> DataFrame:
    repeats = stored(
        rows.groupBy("doc_id", "row").agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated-rows"
    )
    repeats = None if repeats.isEmpty() else repeats
    tokens = lambda line: _known_words(line, model)
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("first", "line"))
    single = _scored(
        lines.select(
            "doc_id", "row", "first", F.col("first").alias("last"), F.lit(0).alias("inner"), tokens("line").alias("tokens")
        ),
        model, repeats,
    )
    if known:
        single = single.filter(F.col("family") != UNKNOWN)
    marks = _distinctive(model)
    marked = rows.filter(F.exists(_words(F.col("text")), lambda w: w.isin(marks)))
    split = marked.select("doc_id", "row", F.transform(F.split("text", "\n"), tokens).alias("lines"))
    runs = _wrapped(_scored(_runs(split, model), model, repeats))
    inside = runs.select(
        F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.explode(F.sequence("first", "last")).alias("_line"),
        F.struct("coverage", "family").alias("_run"),
    ).groupBy("_id", "_row", "_line").agg(F.max("_run.coverage").alias("_cover"), F.collect_set("_run.family").alias("_families"))
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")) & (F.col("first") == F.col("_line"))
    )
    placed = single.join(inside, same, "left")
    alone = placed.filter(
        F.col("_cover").isNull()
        | (F.col("confirmed") & ~F.array_contains("_families", F.col("family")) & (F.col("coverage") >= F.col("_cover")))
    )
    found = alone.unionByName(runs.withColumn("confirmed", F.lit(True)), allowMissingColumns=True)
    return found.select(
        "doc_id", "row", F.col("first").alias("paragraph"), F.col("last").alias("last_line"), "family", "probability",
        "coverage", "confirmed",
    )


def documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, family, probability, n_paragraphs, n_confirmed of every document.

    The family is that of the confirmed passage with the highest probability, the first one among equals; null
    without one. ``n_paragraphs`` counts passages of a known family. Repeated rows and rows with a null id have a
    result each, the same as they would have alone. A document is one row of its passages at the end.
    """
    rows = _rows(docs.select("doc_id", "text"))
    found = _passages(rows, model or fit(), True)
    order = F.when(F.col("confirmed"), F.struct(F.col("probability"), (-F.col("paragraph")).alias("p"), F.col("family")))
    per_doc = found.groupBy("doc_id", "row").agg(
        F.max(order).alias("_top"), F.count("*").alias("_n"), F.count_if("confirmed").alias("_c")
    )
    marked = per_doc.withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    return rows.select("doc_id", "row").join(marked, same, "left").select(
        "doc_id", "_top.family", "_top.probability", F.coalesce("_n", F.lit(0)).alias("n_paragraphs"),
        F.coalesce("_c", F.lit(0)).alias("n_confirmed"),
    )
