"""Licence notices in paragraphs: a trained classifier, confirmed by comparison with templates.

A multinomial logistic regression over the word 1- and 2-grams of a paragraph gives each licence family a probability.
It is trained on variations of the notices below, on paragraphs that mention licences without granting one, which
form the class `none`, and on notices of families that aren't told apart, which form the class `unknown`; n-grams that have no anchor word carry no weight, so that prose around a notice doesn't count.
Logits are divided by a temperature fitted on variations kept apart. A prediction counts if its probability is at
least SURE and the paragraph holds CONFIRMED of the word pairs of one of the family's notices; a paragraph that is of
the class `unknown` or looks like a licence but isn't confirmed is `unknown`. The whole corpus is scored by DataFrame operations alone: the
weights are a small table of n-grams (bounded by the notices below), joined with the n-grams of paragraphs.

Defined cases: paragraphs are lines; null and blank texts have none; a document without a notice is `none` with
probability 0; of several notices the most probable is the document's family, the first by name of equals, and all
are listed; rows that repeat an id are read as one document and give a row each; rows without an id are one document if
their texts are equal; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
from functools import lru_cache

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: Notices by family.
NOTICES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law the author has waived all copyright. CC0 1.0 Universal"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "Copyright the authors. All rights reserved. No part may be reproduced without permission.", "Proprietary and confidential."],
}
NONE = [
    "He lost his driving license last week.", "A fishing license is required in this state.", "Licensed drivers may apply at the office.",
    "Permission to enter the building was refused.", "The public domain of knowledge is wide.", "Your rights and duties are explained below.",
    "The software was free and the source was open.", "Version 2.0 of the plan was published.", "She worked at MIT for ten years.",
    "Apache helicopters were seen.", "A table was reserved for all guests.", "The general public was invited.", "The commons were open to all, a creative place.",
    "The copyright debate went on.", "Terms of use may change.", "Work is done under the bridge.", "A person obtaining a copy pays a fee.", "Mozilla released a browser.",
]
#: Notices of other families, from which the class `unknown` is learned.
OTHERS = [
    "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "Distributed under the Boost Software License, Version 1.0.",
    "Released under the zlib License.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Released under the Artistic License 2.0.",
    "Licensed under the Common Development and Distribution License.", "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the European Union Public Licence.", "Licensed under the Microsoft Public License.", "Released under the PostgreSQL License.",
    "Licensed under the Open Database License.", "Released under the Unlicense.", "Licensed under the Python Software Foundation License.", "Licensed under the Academic Free License version 3.0.",
]
FILLER = "the of and a in to it was by at as which this that for on with from here please see our page site notes about text work data more".split()
#: Words that an n-gram needs at least one of to carry weight.
ANCHORS = (
    "license licensed licence licenced licenses agpl gpl lgpl mpl bsd mit apache gnu affero lesser mozilla cc cc0 nc sa spdx identifier creative commons attribution "
    "noncommercial sharealike public domain copyright rights reserved permission permitted redistribution redistribute proprietary confidential granted waived reproduced"
).split()
SEPARATOR = "[^a-z0-9]+"
SURE, CONFIRMED = 0.5, 0.6
VARIATIONS = 24
#: One of the anchors as a word of a lower-case text; by first letter, so that most words are left at once.
HAS = "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in sorted(ANCHORS) if w[0] == c)})" for c in sorted({w[0] for w in ANCHORS})) + ")(?![a-z0-9])"


def has_anchor(text: Column) -> Column:
    return F.arrays_overlap(F.split(text, SEPARATOR), F.array(*(F.lit(a) for a in ANCHORS)))


def grams(text: Column) -> Column:
    """Distinct word 1- and 2-grams of a lower-case text that hold an anchor word."""

    def of(words: Column) -> Column:
        one = F.filter(words, lambda w: w.isin(*ANCHORS))
        two = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when(a.isin(*ANCHORS) | b.isin(*ANCHORS), F.concat(a, F.lit(" "), b)))
        return F.array_distinct(F.concat(one, F.array_compact(two)))

    words = F.filter(F.split(text, SEPARATOR), lambda w: w != "")
    # inside a lambda the words are one value; as an expression they would be split anew for each of them
    return F.flatten(F.transform(F.array(words), of))


def rows_of(spark: SparkSession, values: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")))


def examples(seed: int = 11) -> list[dict]:
    """Variations of the notices: words around them, words left out."""
    g, out = random.Random(seed), []
    families = sorted(NOTICES)
    for label, notices in [*((i + 1, NOTICES[f]) for i, f in enumerate(families)), (0, NONE), (len(families) + 1, OTHERS)]:
        for notice in notices:
            for v in range(VARIATIONS // (4 if label == 0 else 1)):
                words = notice.split()
                if v and len(words) > 4:
                    del words[g.randrange(len(words))]
                before, after = ([g.choice(FILLER) for _ in range(g.randrange(12) if v else 0)] for _ in range(2))
                out.append({"label": float(label), "text": " ".join([*before, *words, *after]), "apart": v % 4 == 3})
    out += [{"label": 0.0, "text": " ".join(g.choice(FILLER) for _ in range(20)), "apart": False} for _ in range(40)]
    return out


@lru_cache(maxsize=1)
def trained(spark: SparkSession) -> tuple[list[dict], list[float]]:
    """Weights of n-grams by class, and the intercepts, both divided by the temperature. Fitted once a session."""
    data = rows_of(spark, examples(), "label double, text string, apart boolean").withColumn("grams", grams(F.lower("text"))).cache()
    vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(data)
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.2, maxIter=60).fit(vectors.transform(data.where(~F.col("apart"))))
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    apart = [(int(r["label"]), [vectors.vocabulary.index(x) for x in r["grams"] if x in vectors.vocabulary]) for r in data.where("apart").select("label", "grams").collect()]
    data.unpersist()

    def loss(t: float) -> float:
        total = 0.0
        for y, at in apart:
            z = [(sum(w[c][i] for i in at) + b[c]) / t for c in range(len(b))]
            top = max(z)
            total += math.log(sum(math.exp(x - top) for x in z)) + top - z[y]
        return total

    t = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    weights = [{"gram": g, "w": [float(w[c][i]) / t for c in range(len(b))]} for i, g in enumerate(vectors.vocabulary) if abs(w[:, i]).max() > 1e-6]
    return weights, [float(x) / t for x in b]


def pairs_of(notice: str) -> set[str]:
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in notice.lower()).split() if w]
    own = [*words, *(" ".join(p) for p in zip(words, words[1:], strict=False))]
    return {g for g in own if any(w in ANCHORS for w in g.split())}


def licenses(docs: DataFrame, sure: float = SURE, confirmed: float = CONFIRMED) -> DataFrame:
    """doc_id, license, probability, template_share, families and n_notices of each document."""
    spark = docs.sparkSession
    families = ["none", *sorted(NOTICES), "unknown"]
    weights, intercepts = trained(spark)
    vocabulary = rows_of(spark, weights, "gram string, w array<double>")
    notices = [(f, pairs_of(n)) for f in sorted(NOTICES) for n in NOTICES[f]]
    templates = rows_of(spark, [{"gram": g, "template": i, "share": 1 / len(own)} for i, (_, own) in enumerate(notices) for g in sorted(own)], "gram string, template int, share double")
    family_of = F.array(*(F.lit(f) for f, _ in notices))

    # a document by its id, or by its text if it has none
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("_key")
    lower = docs.select(key, F.lower("text").alias("low")).where(has_anchor(F.col("low")))
    found = lower.select("_key", F.posexplode(F.split("low", "\n")).alias("paragraph", "p"))
    # n-grams are made of paragraphs with an anchor only, also where Spark asks for their number before the filter
    own = F.when(has_anchor(F.col("p")), grams(F.col("p"))).otherwise(F.array().cast("array<string>"))
    one = found.select("_key", "paragraph", F.explode(own).alias("gram")).distinct()
    n = len(families)
    scores = one.join(F.broadcast(vocabulary), "gram").groupBy("_key", "paragraph").agg(*(F.sum(F.col("w")[c]).alias(f"z{c}") for c in range(n)))
    z = F.array(*(F.col(f"z{c}") + F.lit(intercepts[c]) for c in range(n)))
    scores = scores.select("_key", "paragraph", z.alias("z"))
    top = F.array_max("z")
    scores = scores.select("_key", "paragraph", F.array_position("z", top).alias("at"), (1 / F.aggregate(F.transform("z", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)).alias("probability"))
    scores = scores.withColumn("family", F.element_at(F.array(*(F.lit(f) for f in families)), F.col("at").cast("int"))).where("family != 'none'")
    alike = one.join(F.broadcast(templates), "gram").groupBy("_key", "paragraph", "template").agg(F.sum("share").alias("share"))
    alike = alike.groupBy("_key", "paragraph", F.element_at(family_of, F.col("template") + 1).alias("family")).agg(F.max("share").alias("template_share"))
    notes = scores.join(alike, ["_key", "paragraph", "family"], "left").withColumn("template_share", F.coalesce("template_share", F.lit(0.0)))
    ok = (F.col("probability") >= sure) & (F.col("template_share") >= confirmed)
    notes = notes.withColumn("name", F.when(ok, F.col("family")).when(F.col("probability") >= sure, F.lit("unknown"))).where("name is not null")
    rank = F.struct((F.col("name") != "unknown").alias("known"), F.col("probability").alias("p"), F.col("template_share").alias("s"), "name")
    per = notes.groupBy(F.col("_key").alias("_id")).agg(
        F.max(rank).alias("best"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("families"), F.count(F.lit(1)).alias("n_notices")
    )
    # texts are read again for rows without an id only
    rows = docs.where("doc_id is not null").select("doc_id", F.col("doc_id").cast("string").alias("_key"))
    rows = rows.unionByName(docs.where("doc_id is null").select("doc_id", key))
    return rows.join(per, F.col("_key") == F.col("_id"), "left").select(
        "doc_id",
        F.coalesce("best.name", F.lit("none")).alias("license"),
        F.coalesce("best.p", F.lit(0.0)).alias("probability"),
        F.coalesce("best.s", F.lit(0.0)).alias("template_share"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
