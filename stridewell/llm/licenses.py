"""Licence scan with DataFrame functions only.

A paragraph classifier: softmax logistic regression over the distinct word
1- and 2-grams of licence notices, trained by full-batch gradient descent on
DataFrames.  Notices to learn from are made of usual openings and names of
licences, alone and amid prose of the corpus; class 0, unknown, learns from lines
about other things and from that prose.  The probability from which a family is
accepted is calibrated on openings and lines that training does not see.  A
prediction stands only if the text also holds enough of the 2-grams of a template
of the predicted family.

A text's lines are classified, and so are windows over the words of its paragraphs
(parted by blank lines), which find notices broken over several lines.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Usual names of licences by family.
NAMES = {
    "mit": ["the MIT License", "an MIT license", "the MIT licence", "MIT License", "the Expat MIT license"],
    "apache": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license", "Apache License v2.0", "the Apache Software License, version 2"],
    "gpl": ["the GNU General Public License, version 3", "the GNU GPL v3", "the GPL version 2 or any later version", "the GNU General Public License as published by the Free Software Foundation", "GNU GPL version 2"],
    "lgpl": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v3", "the LGPL version 2.1 or later", "the GNU Library General Public License", "GNU Lesser GPL"],
    "bsd": ["the BSD 3-Clause License", "the BSD license", "a BSD-style license", "the 2-clause BSD license", "the New BSD License"],
    "mpl": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "the MPL 2.0 license", "Mozilla Public License version 1.1"],
    "cc-by": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 3.0 license", "CC-BY 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike license"],
    "public-domain": ["the CC0 1.0 Universal public domain dedication", "the Unlicense public domain dedication", "a CC0 public domain waiver"],
}
#: Sentences of licences and their headers.
TEXTS = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT", "The software is provided as is, without warranty of any kind, express or implied"],
    "apache": ["You may not use this file except in compliance with the Apache License", "SPDX-License-Identifier: Apache-2.0",
               "You may obtain a copy of the License at apache.org licenses LICENSE-2.0"],
    "gpl": ["you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later",
            "You should have received a copy of the GNU General Public License along with this program"],
    "lgpl": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only",
             "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-2-Clause",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "public-domain": ["This work has been released into the public domain", "This is free and unencumbered software released into the public domain",
                      "To the extent possible under law, the author has waived all copyright and related rights", "SPDX-License-Identifier: CC0-1.0"],
}
#: How notices begin; the second list is for calibration only.
OPENINGS = ["Released under", "Licensed under", "Licensed under the terms of", "This project is licensed under", "This work is licensed under the terms of",
            "Distributed under", "Published under", "Use of this source code is governed by", ""]
OTHER_OPENINGS = ["This repository is covered by", "The code is made available under", "All files here fall under", "We offer the data set under"]
#: Lines that are no notices; the second list is for calibration only.
NO_LICENSES = [
    "He lost his driving license in the spring.", "The license plate was covered with mud.", "All copyright questions go to the editor.",
    "The general public was not admitted without permission.", "A license fee is due each year.", "They were released under the condition that they stay in town.",
    "The software was distributed to schools free of charge.", "The version of the story that you know is the later one.",
    "Apache helicopters flew over the town, see the report for details.", "The university released the results, and any person may obtain a copy.",
    "The work of the commons committee is subject to review.", "The source of the river is in the domain of the king.",
    "Permission to enter was denied by the public officer.", "A warranty of two years covers parts and labour.",
    "Redistribution of income is a question for parliament.", "The licensed trade has its own rules.", "MIT is a university in the state of Massachusetts.",
    "The terms of the contract are set out in section 2.", "Copies without modification are of no use to the artist.", "The GNU is a large antelope.",
    "The general public may use the park.", "A public license hearing was held in the town hall.", "Mozilla released a new version of its browser.",
    "Creative people have much in common.", "The attribution of the painting is disputed.", "Students of the MIT were granted a license to sell tea.",
    "This file is part of the archive of the library.", "The free software movement began long ago.", "Under the law, the author has all rights.",
    "The clause of the contract was struck out.", "You may not use this door.", "The version 2.0 of the report is due in May.",
]
OTHER_LINES = [
    "The driver showed an officer the license that was granted in another state.", "Apache was the name of the street, and the license office stood there.",
    "The public library is open to the general public on each working day.", "A copy of this letter was sent to the foundation.",
    "The domain name was sold to a company in the city.", "No commercial use of the hall is permitted on Sundays.",
    "Sources say that the work is subject to the rules of the committee.", "The common terms of such a contract are found in this book.",
    "Software from the university was distributed under another name.", "A person obtaining a copy of the key has to sign for it.",
]
FAMILIES = ["unknown", *NAMES]
#: What confirms a prediction: names as they follow "under", and the sentences.
TEMPLATES = {f: [*names, *TEXTS[f]] for f, names in NAMES.items()}
#: Words that say little of a pair.
PLAIN = frozenset("0 a all an and any as at by for has have in is it may not of on or the this to under you your with".split())
WINDOW = 48  # words


def words_of(line: str) -> list[str]:
    return re.sub(r"[0-9]+", "0", re.sub(r"[^a-z0-9]+", " ", line.lower())).split()


def grams_of(line: str) -> list[str]:
    w = words_of(line)
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))})


def words(text: Column) -> Column:
    """words_of in Spark."""
    spread = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), r"[0-9]+", "0")
    return F.filter(F.split(spread, " "), lambda x: x != "")


def grams(w: Column) -> Column:
    """Distinct words and pairs of neighbours of an array of words."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def gate(confirm: float) -> str:
    """A pattern that every lower-case text holds which ``confirm`` can admit.  Such a
    text lacks fewer than ``spare`` of a template's pairs, so it holds one of any
    ``spare`` of them; those that say most are taken."""
    chosen = set()
    for line in (line for lines in TEMPLATES.values() for line in lines):
        pairs = sorted({g for g in grams_of(line) if " " in g}, key=lambda g: (-len(set(g.split()) - PLAIN), -len(g), g))
        spare = sum(k / len(pairs) >= confirm - 1e-9 for k in range(len(pairs) + 1))  # 1 + how many may be lacking
        chosen.update(pairs[:spare])
    # by first letter and first word, so that most words of a text are told after a letter
    spell = lambda w: w.replace("0", "[0-9]+")
    seconds: dict[str, dict[str, list[str]]] = {}
    for g in sorted(chosen):
        first, second = g.split(" ")
        seconds.setdefault(first[0], {}).setdefault(first, []).append(second)
    letters = [spell(c) + "(?:" + "|".join(
        spell(first[1:]) + "[^a-z0-9]+(?:" + "|".join(map(spell, seconds[c][first])) + ")" for first in seconds[c]) + ")" for c in seconds]
    return "(?<![a-z0-9])(?:" + "|".join(letters) + ")(?![a-z0-9])"


def rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small table from driver values, by way of one JSON literal; one partition,
    so that what is grouped or joined by it needs no shuffle."""
    one = spark.range(0, 1, 1, 1)
    return one.select(F.inline(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")))


def prose(docs: DataFrame, cue: Column, most: int) -> list[str]:
    """About ``most`` windows of the corpus's lines that the gate refuses, by hash
    order of the texts: the bounded sample of the unknown class."""
    n = docs.count()
    h = F.pmod(F.xxhash64(F.lit("license"), "doc_id"), F.lit(1_000_000))
    some = docs.where(h < max(1, min(1_000_000, 1_000_000 * 2 * most // max(1, n)))).select(h.alias("h"), "doc_id", F.explode(F.split("text", r"\n")).alias("line"))
    some = some.select("h", "doc_id", F.array_join(F.slice(F.split("line", r"\s+"), 1, WINDOW), " ").alias("line")).where(
        (F.length("line") > 20) & (F.length("line") < 1_000) & ~F.rlike(F.lower("line"), cue))
    return [r.line for r in some.orderBy(F.xxhash64("line"), "line").limit(most).collect()]


def examples(unknown: list[str]) -> list[tuple[str, int, bool]]:
    """Line, class, held out for calibration."""
    out = [(line, 0, False) for line in NO_LICENSES] + [(line, 0, True) for line in OTHER_LINES]
    out += [(line, 0, k % 4 == 0) for k, line in enumerate(unknown)]
    lead = [u.split() for u in unknown] or [["so", "it", "was", "said"]]
    for k, family in enumerate(FAMILIES[1:], 1):
        for i, name in enumerate(NAMES[family]):
            out += [(f"{o} {name}.", k, False) for o in OPENINGS] + [(f"{o} {name}.", k, True) for o in OTHER_OPENINGS]
            for j in range(4):  # amid prose of the corpus
                around = lead[(31 * k + 7 * i + j) % len(lead)]
                opening = OTHER_OPENINGS[i % len(OTHER_OPENINGS)] if j == 3 else OPENINGS[(i + j) % len(OPENINGS)]
                out.append((" ".join([*around[:8 + 2 * j], opening, name, *around[8 + 2 * j:24]]), k, j == 3))
        for i, text in enumerate(TEXTS[family]):
            w, around = text.split(), lead[(17 * k + i) % len(lead)]
            out += [(text, k, False), (" ".join(w[1:]), k, False), (" ".join(w[:-1]), k, False), (" ".join([*around[:12], *w, *around[12:24]]), k, True)]
    return out


def train(spark: SparkSession, unknown: list[str], steps: int = 30, rate: float = 0.8, decay: float = 2e-4) -> tuple[dict, list[float], float]:
    """Weights by gram, biases, and the calibrated acceptance probability.  A step
    is one small job; weights pass through the driver (as many rows as the
    templates and openings have grams)."""
    data = examples(unknown)
    known = {g for line, y, held in data if y and not held for g in grams_of(line)} & {
        g for lines in (*TEMPLATES.values(), OPENINGS, NO_LICENSES) for line in lines for g in grams_of(line)}
    table = materialize(rows(spark, [{"ex": i, "y": y, "held": held, "gram": g} for i, (line, y, held) in enumerate(data) for g in ["", *grams_of(line)]
                                     if g == "" or g in known], "ex int, y int, held boolean, gram string")).coalesce(1).cache()
    classes = range(len(FAMILIES))
    n = [max(1, sum(not held and y == k for _, y, held in data)) for k in classes]
    weights = {g: [0.0] * len(FAMILIES) for g in ["", *sorted(known)]}  # "": the bias
    speed = {g: [0.0] * len(FAMILIES) for g in weights}

    def probabilities() -> DataFrame:
        w = rows(spark, [{"gram": g, "w": [round(x, 4) for x in v]} for g, v in weights.items()], "gram string, w array<double>")
        z = table.join(F.broadcast(w), "gram").groupBy("ex", "y", "held").agg(*[F.sum(F.get("w", k)).alias(f"z{k}") for k in classes])
        top = F.greatest(*[F.col(f"z{k}") for k in classes])
        total = sum((F.exp(F.col(f"z{k}") - top) for k in classes), F.lit(0.0))
        return z.select("ex", "y", "held", *[(F.exp(F.col(f"z{k}") - top) / total).alias(f"p{k}") for k in classes])

    share = F.get(F.array(*[F.lit(1.0 / (len(n) * c)) for c in n]), F.col("y"))  # classes weigh alike
    for _ in range(steps):
        slope = (table.join(probabilities().where("not held").drop("y", "held"), "ex").groupBy("gram")
                 .agg(*[F.sum(share * (F.col(f"p{k}") - (F.col("y") == k).cast("double"))).alias(f"g{k}") for k in classes]))
        for r in slope.collect():
            speed[r.gram] = [0.9 * s + r[f"g{k}"] + decay * w for k, (s, w) in enumerate(zip(speed[r.gram], weights[r.gram]))]
            weights[r.gram] = [w - rate * s for s, w in zip(speed[r.gram], weights[r.gram])]
    best = F.greatest(*[F.col(f"p{k}") for k in classes if k])
    held = sorted((r.best, r.y > 0) for r in probabilities().where("held").select("y", best.alias("best")).collect())
    table.unpersist()
    # the cut with the fewest wrong of the held-out lines, in the middle of the gap, not under one half
    yes = sum(y for _, y in held)
    wrong, below, no = [], 0, len(held) - yes
    for k in range(len(held) + 1):
        wrong.append(below + no)
        if k < len(held):
            below, no = below + held[k][1], no - (not held[k][1])
    ties = [k for k, x in enumerate(wrong) if x == min(wrong)]
    k = ties[len(ties) // 2]
    gap = ([0.0] + [p for p, _ in held])[k], ([p for p, _ in held] + [1.0])[k]
    return {g: w for g, w in weights.items() if g}, weights[""], max(0.5, sum(gap) / 2)


def scan(docs: DataFrame, confirm: float = 0.65, sample: int = 300) -> DataFrame:
    """``doc_id, licenses, n_notices, best`` for every row of ``docs`` (doc_id, text).

    licenses: the families found, sorted, joined by commas, "" if none; n_notices:
    lines accepted, and in each paragraph runs of windows accepted for a family that
    none of its lines shows; best: the largest probability of an accepted family, 0
    if none.  Only lines, paragraphs and windows that hold none of the pairs of
    ``gate``, which ``confirm`` would refuse, are left out before the classifier.
    ``sample``: lines of the corpus that teach the unknown class.  Null and empty
    texts have no notices.  Repeated rows are scanned each; extra columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs, cue = docs.select("doc_id", "text"), F.lit(gate(confirm))
    weights, bias, accept = train(spark, prose(docs, cue, sample))
    lines = [(k, line) for k, f in enumerate(FAMILIES) if k for line in TEMPLATES[f]]
    pairs = [{g for g in grams_of(line) if " " in g} for _, line in lines]
    every = sorted({*weights, *(g for p in pairs for g in p)})
    classes, none = range(len(FAMILIES)), [0.0] * len(FAMILIES)
    table = rows(spark, [{"gram": g, "v": [round(x, 4) for x in weights.get(g, none)] + [round(1 / len(p), 12) if g in p else 0 for p in pairs]} for g in every], "gram string, v array<double>")
    hit = lambda x: F.rlike(F.lower(x), cue)
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                       F.when(hit(F.col("text")), F.filter(F.split("text", r"\n[ \t\r]*\n"), hit)).alias("paragraphs"))
    part = base.select("doc_id", "row", F.posexplode_outer("paragraphs").alias("part", "paragraph"))
    w = words(F.col("paragraph"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - WINDOW) / (WINDOW // 2))).cast("int"))
    windows = F.when(F.contains("paragraph", F.lit("\n")), F.transform(starts, lambda k: F.struct(k.alias("nth"), F.slice(w, k * (WINDOW // 2) + 1, WINDOW).alias("w"), F.lit(True).alias("window"))))
    own = F.transform(F.filter(F.split("paragraph", "\n"), hit), lambda x: F.struct(F.lit(-1).alias("nth"), words(x).alias("w"), F.lit(False).alias("window")))
    units = F.concat(own, F.coalesce(F.filter(windows, lambda x: hit(F.array_join(x.w, " "))), F.array().cast("array<struct<nth:int,w:array<string>,window:boolean>>")))
    unit = part.select("doc_id", "row", "part", F.posexplode_outer(units).alias("place", "unit"))
    each = unit.select("doc_id", "row", "part", "place", "unit.nth", "unit.window", F.explode_outer(grams(F.col("unit.w"))).alias("gram"))
    keys = ["doc_id", "row", "part", "place", "nth", "window"]
    # the table is as large as the templates
    sums = each.join(F.broadcast(table), "gram", "left").groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.get("v", i)), F.lit(0.0)).alias(f"s{i}") for i in range(len(FAMILIES) + len(lines))])
    z = [F.col(f"s{k}") + F.lit(bias[k]) for k in classes]
    total = sum((F.exp(x - F.greatest(*z)) for x in z), F.lit(0.0))
    scored = sums.select(*keys, *[(F.exp(z[k] - F.greatest(*z)) / total).alias(f"p{k}") for k in classes], *[
        F.greatest(F.lit(0.0), *[F.col(f"s{len(FAMILIES) + i}") for i, (k, _) in enumerate(lines) if k == c]).alias(f"t{c}") for c in classes if c])
    top = F.array_max(F.array(*[F.struct(F.col(f"p{c}").alias("p"), F.lit(c).alias("c")) for c in classes]))
    sure = F.get(F.array(F.lit(0.0), *[F.col(f"t{c}") for c in classes if c]), F.col("top.c"))
    ok = (F.col("top.c") > 0) & (F.col("top.p") >= accept) & (sure >= confirm - 1e-9) & F.col("place").isNotNull()
    names = F.array(*[F.lit(f) for f in FAMILIES])
    got = scored.withColumn("top", top).select(*keys, F.when(ok, F.get(names, F.col("top.c"))).alias("family"), F.when(ok, F.col("top.p")).alias("p"))
    # in a paragraph, windows count for families that no line shows, neighbouring ones once
    shown = F.collect_set(F.when(~F.col("window"), F.col("family")))
    seen = F.array_sort(F.collect_list(F.when(F.col("window") & F.col("family").isNotNull(), F.struct("family", "nth", "p"))))
    per = got.groupBy("doc_id", "row", "part").agg(
        shown.alias("shown"), seen.alias("seen"), F.sum((~F.col("window") & F.col("family").isNotNull()).cast("long")).alias("n"),
        F.max(F.when(~F.col("window"), F.col("p"))).alias("p"))
    rest = F.filter("seen", lambda x: ~F.array_contains("shown", x.family))
    runs = F.size(F.filter(F.col("rest"), lambda x: ~F.exists(F.col("rest"), lambda y: (y.family == x.family) & (y.nth == x.nth - 1))))
    per = per.withColumn("rest", rest).select("doc_id", "row", F.array_union("shown", F.transform("rest", lambda x: x.family)).alias("found"),
                                             (F.coalesce("n", F.lit(0)) + runs).alias("n"), F.greatest("p", F.array_max(F.transform("rest", lambda x: x.p))).alias("p"))
    return per.groupBy("doc_id", "row").agg(
        F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))).alias("licenses"),
        F.sum("n").alias("n_notices"), F.coalesce(F.max("p"), F.lit(0.0)).alias("best")).drop("row")
