"""License scans by a trained paragraph classifier (native on the data path).

Every paragraph is the set of its word 1- and 2-grams.  A sparse multinomial
logistic regression over the licence families, a class ``unknown`` that is trained
on notices of other licences, and a class ``none`` for other prose, is fitted on the
fixed sentences below when the operator is built; its weights are a small table that
is joined to the grams.  Probabilities are calibrated by a temperature fitted out of
fold.  A paragraph that states a licence but is not confidently one family, or whose
family no template confirms, is ``unknown``, too.
"""
from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least calibrated probability of a family, and least share of a template's
#: grams that a paragraph must have to confirm it.
CONFIDENT = 0.5
CONFIRMED = 0.6

# Usual notices of each family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "This project is released under the Apache 2.0 license.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This software is distributed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 3 or later.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Released under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU GPL version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "Released under the GPLv2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "Licensed under the LGPL version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPLv3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the simplified BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under CC-BY 3.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work is dedicated to the public domain under CC0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 by the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
# Notices of licences that have no family here.
UNKNOWN = [
    "Licensed under the Eclipse Public License, version 2.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Published under the EUPL 1.2.",
    "This is free and unencumbered software released into the public domain.",
    "Released under the Unlicense.",
    "Free and unencumbered software under the Unlicense.",
    "Licensed under the zlib license.",
    "This software is provided as is, without any express or implied warranty.",
    "Licensed under the ISC license.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Released under the Artistic License 2.0.",
    "Licensed under the WTFPL, version 2.",
    "Licensed under the terms of the Example Software License Agreement.",
    "Use of this data is governed by the Open Database License.",
    "This document may be used under the GNU Free Documentation License.",
    "SPDX-License-Identifier: LicenseRef-Custom",
    "This product is licensed, not sold, under the end user license agreement.",
]
# Prose that shares words with notices but states no licence.
OTHER = [
    "He was licensed to drive a bus and to work in public.",
    "The general public was free to visit the foundation in the afternoon.",
    "A source of light is subject to the terms of the treaty.",
    "The version of the story that was released in May is under review.",
    "Permission to enter is granted by the office at the gate.",
    "The copy of the file is in the box under the table.",
    "Members of the public can use the library with or without a card.",
    "The clause was published in the first part of the report.",
    "Common people and their rights were reserved for the last chapter.",
    "Many tribes of Apache lived in the south.",
    "Students at MIT built the machine.",
    "The work is done by the person who has the most time.",
    "The software has a new form and a binary file.",
    "International law and attribution of conduct to a state.",
    "The author of this work is a creative writer.",
    "A license plate was found near the commons.",
    "It is the domain of the related species, and the terms are met.",
    "You may obtain a seat at the door.",
    "Er kam mit dem Bus und mit ihr nach Hause, mit allen und mit mir.",
    "Die Frau mit der Tasche ist mit dem Mann auf der Reise.",
    "Le public est libre et la source de la loi est dans le domaine.",
    "La obra de su autor es libre para el lector en general.",
    "The rights of the members were discussed under the new rules.",
    "A new version of the song was released under another name.",
    "The library is free and open to the general public.",
    "The driver had no license and no permission to leave.",
    "The software was provided to the school under a contract.",
    "Creative people share their common interests.",
    "The author waived the fee for the related event.",
    "Conditions in the domain of physics are met to a large extent.",
    "He obtained a copy of the document from the publisher.",
    "The redistribution of income is an international question.",
    "Clause 3 of the agreement was published in 2020.",
    "Version 2 of the plan has a source in the earlier text.",
    "All seats were reserved by the company.",
    "Charge the battery before use, free of any warranty.",
    "The king granted the town its first rights in 1201.",
    "The public domain of the city was opened to all.",
    "Under the law, no person may enter without prior written notice.",
]
# Words that alone say nothing about a licence.
STOP = "a an and any are as at be by can de der die du el en for from has he http https in is it its la le not of on or that the their this to was were who with without you your work use file files copy may part person terms form forms all more".split()

#: Characters between words: all of ASCII but letters, digits and dots; letters outside
#: ASCII belong to words.
_SPACE = r"[\x00-\x2d\x2f\x3a-\x60\x7b-\x7f]+"
_SPACE_OR_DOT = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_DOT = r"\.(?![0-9])|(?<![0-9])\."
OTHER_CLASS, UNKNOWN_CLASS = "none", "unknown"
#: Steps in which the words' evidence is counted before paragraphs are scored.
LEVELS = 4
#: A line end that ends a paragraph: not one after which the line goes on in lower case.
_BREAK = r"(?<![a-z0-9,])\n|\n(?![a-z])"


def grams_of(text: str) -> list[str]:
    """Distinct 1- and 2-grams, as :func:`gram_column` makes them."""
    words = re.sub(_DOT, " ", re.sub(_SPACE, " ", text.lower())).split()
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def words_column(text):
    """Words of a paragraph: lower case, letters, digits and dots before digits."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), _SPACE, " "), _DOT, " ")
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def gram_column(words):
    return F.array_distinct(
        F.concat(words, F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>")))
    )


def _fit(x: np.ndarray, y: np.ndarray, classes: int, l1: float = 0.0015, rounds: int = 400, rate: float = 1.5):
    """Proximal gradient steps of the L1-penalised multinomial model."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    hot = np.eye(classes)[y]
    weight = 1.0 / np.bincount(y, minlength=classes)[y]
    weight = weight / weight.sum()
    for _ in range(rounds):
        z = np.einsum("ij,jk->ik", x, w) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - hot) * weight[:, None]
        w -= rate * np.einsum("ij,ik->jk", x, d)
        b -= rate * d.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, b


def _temperature(held: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section."""

    def loss(log_t):
        z = held / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean()

    lo, hi, ratio = np.log(0.2), np.log(8.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def sentences() -> list[tuple[str, str]]:
    """All training sentences and their classes."""
    return [(t, f) for f in sorted(TEMPLATES) for t in TEMPLATES[f]] + [(t, UNKNOWN_CLASS) for t in UNKNOWN] + [(t, OTHER_CLASS) for t in OTHER]


def train(examples: list[tuple[str, str]] | None = None):
    """The fitted model: classes, rows ``(gram, class, weight)``, intercepts,
    temperature.  ``examples`` are :func:`sentences` unless given."""
    return _train(tuple(examples or sentences()))


@lru_cache(maxsize=8)
def _train(examples):
    classes = [*sorted(TEMPLATES), UNKNOWN_CLASS, OTHER_CLASS]
    texts = [(t, classes.index(c)) for t, c in examples]
    stop = set(STOP)
    telling = lambda g: any(w not in stop for w in g.split())
    vocabulary = sorted({g for t, _ in texts for g in grams_of(t) if telling(g)})
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)))
    for i, (t, _) in enumerate(texts):
        x[i, [index[g] for g in grams_of(t) if g in index]] = 1
    y = np.array([c for _, c in texts])
    w, b = _fit(x, y, len(classes))
    held = np.zeros((len(texts), len(classes)))
    for fold in range(3):
        out = np.arange(len(texts)) % 3 == fold
        fw, fb = _fit(x[~out], y[~out], len(classes), rounds=150)
        held[out] = np.einsum("ij,jk->ik", x[out], fw) + fb
    rows = [(vocabulary[i], classes[c], float(w[i, c])) for i, c in zip(*np.nonzero(w))]
    return classes, rows, [float(v) for v in b], _temperature(held, y)


def evidence(model=None) -> list[list[str]]:
    """Words by the evidence that they can add at most, in ``LEVELS`` steps and one
    for words that are enough alone: a paragraph whose steps do not sum to more than
    ``LEVELS`` is ``none`` with a probability of one half or more.

    For each class the lead over ``none`` is at most its intercept's and the positive
    leads of the grams.  The most that a gram adds for any class is counted for one
    of its words, the longest; of a word with a dot, for its first part."""
    classes, rows, intercepts, heat = model or train()
    lead: dict[str, dict[str, float]] = {}
    for gram, c, w in rows:
        lead.setdefault(gram, dict.fromkeys(classes, 0.0))[c] = w
    most: dict[str, float] = {}
    for gram, by in lead.items():
        gain = max(by[c] - by[OTHER_CLASS] for c in classes)
        if gain > 0:
            word = max(gram.split(), key=lambda x: (x not in STOP, len(x), x)).split(".")[0]
            most[word] = most.get(word, 0.0) + gain
    # with a lead of x for every class the odds against none are at most exp(x / heat)
    # times what the intercepts give
    needed = -heat * float(np.log(sum(np.exp((b - intercepts[-1]) / heat) for b in intercepts[:-1])))
    if needed <= 0:
        raise ValueError("paragraphs without any known word would state a licence")
    steps = [[] for _ in range(LEVELS + 1)]
    for word, gain in sorted(most.items()):
        steps[min(LEVELS, int(np.ceil(LEVELS * gain / needed - 1e-9)) - 1)].append(word)
    return steps


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """One row per paragraph that states a licence: id, ``paragraph`` (its number
    from 0), ``family`` (or ``unknown``), ``probability`` of the likeliest class
    but ``none``, ``template_match`` (largest share of one of its templates) and
    ``n_grams``.

    Paragraphs end at line ends, but for a line that goes on in lower case after one
    without an end.  Null and empty texts have no paragraph; rows that repeat an id
    give repeated rows; an empty table gives none; other columns are not read.  Only
    paragraphs that :func:`evidence` cannot tell to be ``none`` leave their task, as
    the few grams that the model knows; the model and the templates are one small
    table of fixed size.
    """
    spark = docs.sparkSession
    classes, weights, intercepts, heat = model or train()
    lines = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(text_col, _BREAK)).alias("paragraph", "line"))
    steps = evidence((classes, weights, intercepts, heat))
    tokens = F.split(F.lower("line"), _SPACE_OR_DOT)
    some = [w for step in steps for w in step]
    lines = lines.where(F.exists(tokens, lambda w: w.isin(some)))
    told = F.array_distinct(F.filter(tokens, lambda w: w.isin(some)))
    level = lambda w: sum(((F.when(w.isin(step), k + 1).otherwise(0)) for k, step in enumerate(steps) if step), F.lit(0))
    lines = lines.where(F.aggregate(told, F.lit(0), lambda total, w: total + level(w)) > LEVELS)
    grams = lines.select("id", "row", "paragraph", gram_column(words_column(F.col("line"))).alias("grams"))
    known = [(g, c, None, w, 0.0) for g, c, w in weights]
    known += [(g, f, f"{f}/{i}", 0.0, 1.0 / len(grams_of(t))) for f in sorted(TEMPLATES) for i, t in enumerate(TEMPLATES[f]) for g in grams_of(t)]
    known = F.broadcast(spark.createDataFrame(known, "gram string, class string, template string, weight double, share double"))
    key = ["id", "row", "paragraph"]
    each = grams.select(*key, F.size("grams").cast("long").alias("n_grams"), F.explode("grams").alias("gram"))
    sums = each.join(known, "gram").groupBy(*key, "n_grams", "class", "template").agg(F.sum("weight").alias("weight"), F.sum("share").alias("share"))
    sums = sums.groupBy(*key, "n_grams", "class").agg(F.sum("weight").alias("weight"), F.max("share").alias("match"))
    z = lambda i, c: (F.coalesce(F.max(F.when(F.col("class") == c, F.col("weight"))), F.lit(0.0)) + intercepts[i]) / heat
    seen = lambda c: F.coalesce(F.max(F.when(F.col("class") == c, F.col("match"))), F.lit(0.0))
    scored = sums.groupBy(*key, "n_grams").agg(F.array(*[F.struct(z(i, c).alias("z"), seen(c).alias("match"), F.lit(c).alias("class")) for i, c in enumerate(classes)]).alias("z"))
    scored = scored.withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v["z"] - F.col("top.z")))
    scored = scored.select(
        *key,
        "n_grams",
        F.array_max(F.filter("z", lambda v: v["class"] != OTHER_CLASS)).alias("best"),
        F.filter("z", lambda v: v["class"] == OTHER_CLASS)[0]["z"].alias("other"),
        F.col("top.z").alias("ztop"),
        total.alias("total"),
    )
    chance = lambda v: F.exp(v - F.col("ztop")) / F.col("total")
    found = scored.where(chance(F.col("other")) < 0.5).select(*key, "n_grams", F.col("best.class").alias("class"), chance(F.col("best.z")).alias("probability"), F.round("best.match", 6).alias("template_match"))
    # the class unknown has no templates, so none confirms it
    sure = (F.col("probability") >= CONFIDENT) & (F.col("template_match") >= CONFIRMED)
    return found.select(
        F.col("id").alias(id_col),
        F.col("paragraph").cast("long").alias("paragraph"),
        F.when(sure, F.col("class")).otherwise(F.lit("unknown")).alias("family"),
        F.round("probability", 6).alias("probability"),
        "template_match",
        "n_grams",
    )


def scan_sql() -> str:
    """SQL (DuckDB dialect) for the rows of :func:`scan` over ``documents``, with
    the fitted weights and the templates as literal rows."""
    classes, weights, intercepts, heat = train()
    text = lambda x: "'" + x.replace("'", "''") + "'"
    known = [f"({text(g)}, {text(c)}, NULL, {w!r}, 0.0)" for g, c, w in weights]
    known += [f"({text(g)}, {text(f)}, {text(f'{f}/{i}')}, 0.0, {1.0 / len(grams_of(t))!r})" for f in sorted(TEMPLATES) for i, t in enumerate(TEMPLATES[f]) for g in grams_of(t)]
    base = ", ".join(f"({text(c)}, {b!r})" for c, b in zip(classes, intercepts))
    number = "regexp_replace({0}, '([0-9])\\.([0-9])', '\\1~\\2', 'g')"
    plain = f"regexp_replace(lower(line), '{_SPACE}', ' ', 'g')"
    plain = f"replace(replace({number.format(number.format(plain))}, '.', ' '), '~', '.')"
    wrapped = "regexp_replace({0}, '([a-z0-9,])\\n([a-z])', '\\1 \\2', 'g')"
    wrapped = wrapped.format(wrapped.format("text"))
    return f"""
        WITH model(gram, class, template, weight, share) AS (VALUES {", ".join(known)}),
        base(class, b) AS (VALUES {base}),
        l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS paragraph,
                   row_number() OVER () AS r FROM (SELECT doc_id, {wrapped} AS text FROM documents WHERE text IS NOT NULL)),
        w AS (SELECT doc_id, paragraph, r, list_filter(string_split({plain}, ' '), lambda w: w <> '') AS words FROM l),
        g AS (
            SELECT doc_id, paragraph, r, list_distinct(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS grams FROM w),
        e AS (SELECT doc_id, paragraph, r, len(grams) AS n_grams, unnest(grams) AS gram FROM g),
        s AS (
            SELECT doc_id, paragraph, r, n_grams, class, template, sum(weight::DOUBLE) AS weight, sum(share::DOUBLE) AS share
            FROM e JOIN model USING (gram) GROUP BY ALL),
        t AS (SELECT doc_id, paragraph, r, n_grams, class, sum(weight) AS weight, max(share) AS match FROM s GROUP BY ALL),
        z AS (
            SELECT k.doc_id, k.paragraph, k.r, k.n_grams, base.class, (coalesce(t.weight, 0) + base.b::DOUBLE) / {heat!r} AS z, coalesce(t.match, 0) AS match
            FROM (SELECT DISTINCT doc_id, paragraph, r, n_grams FROM t) k CROSS JOIN base LEFT JOIN t ON t.r = k.r AND t.paragraph = k.paragraph AND t.class = base.class),
        p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY r, paragraph) AS p FROM z),
        f AS (
            SELECT doc_id, paragraph, n_grams, max(p) FILTER (class = '{OTHER_CLASS}') AS other,
                   arg_max(class, z) FILTER (class <> '{OTHER_CLASS}') AS class, max(p) FILTER (class <> '{OTHER_CLASS}') AS probability,
                   arg_max(match, z) FILTER (class <> '{OTHER_CLASS}') AS match
            FROM p GROUP BY doc_id, paragraph, r, n_grams)
        SELECT doc_id, paragraph, CASE WHEN probability >= {CONFIDENT} AND round(match, 6) >= {CONFIRMED} THEN class ELSE 'unknown' END AS family,
               round(probability, 6) AS probability, round(match, 6) AS template_match, n_grams
        FROM f WHERE other < 0.5"""
