"""License scan: a trained paragraph classifier, in DataFrame and SQL operations only.

A paragraph is a run of lines of which each but the last runs on: it has a letter or digit, ends in no sentence or clause
mark and is not followed by a line without letters and digits; its number is that of its first line, so wrapped notices
are read whole.  Its features are its distinct word bigrams and trigrams as 64-bit hashes.  A sparse (elastic-net)
multinomial logistic regression, `none` weighing as much as all families and these the same, is trained on pieces of the templates below, by licence
family, against PLAIN and paragraphs of a bounded sample of the corpus (NEGATIVES rows).  The weights are one row per
template n-gram, so their number does not depend on the corpus.  Paragraphs meet the weights in a join; those without a
template n-gram cannot score.

A paragraph is reported when the licence families together reach the level that all but FALSE of the held-out plain
paragraphs stay under, and at least one half, and a HINT of its n-grams are template n-grams (or a template is there to
WHOLE).  It gets its best family if that family's probability reaches the family's
calibrated level (the PASS quantile of its held-out template pieces) and a comparison with the family's templates confirms
it (COVER of the paragraph's n-grams occur there, or a template is there to WHOLE); otherwise `unknown`.

Edge cases: null and empty texts have no paragraph, an empty table gives no rows; a paragraph under two words is never
reported; repeated rows (same id and text) are reported once; rows without id are reported with a null id; other columns
are not read.
"""
from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

# fixed values: short public notices by family
NOTICES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "This software is released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 2 or later.", "Released under the GPL.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0."],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "See the GNU Affero General Public License for more details."],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."],
    "EUPL": [
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence). You may not use this work except in compliance with the Licence."],
    "BSL": [
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.", "Released under CC0 1.0 Universal, no rights reserved.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
# fixed values: names and identifiers of the licences by family
NAMES = {
    "MIT": ["MIT License", "MIT license (MIT)"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "GPL": ["GNU General Public License", "GNU General Public License version 2", "GNU General Public License v3", "GNU GPL", "GPL v2", "GPLv3"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License v2.1", "GNU LGPL", "LGPL v3"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License v3", "GNU AGPL", "AGPL v3", "AGPLv3"],
    "BSD": ["BSD license", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "simplified BSD license"],
    "MPL": ["Mozilla Public License", "Mozilla Public License 2.0", "MPL 2.0"], "ISC": ["ISC License"],
    "EPL": ["Eclipse Public License", "Eclipse Public License 2.0", "EPL 2.0"], "EUPL": ["European Union Public Licence", "EUPL 1.2"],
    "BSL": ["Boost Software License", "Boost Software License 1.0"], "Zlib": ["zlib License", "zlib/libpng license"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Public-Domain": ["CC0 1.0 Universal", "Unlicense", "public domain"],
}
IDENTIFIERS = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"], "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "MPL": ["MPL-2.0"], "ISC": ["ISC"], "EPL": ["EPL-1.0", "EPL-2.0"], "EUPL": ["EUPL-1.2"],
    "BSL": ["BSL-1.0"], "Zlib": ["Zlib"], "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "Public-Domain": ["CC0-1.0", "Unlicense"],
}
# fixed values: how a notice names its licence, and ordinary sentences with the same words
PHRASES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This project is licensed under the {}.",
           "This work is made available under the {}.", "{}, see the LICENSE file for details.", "{} or later.")
TAGS = ("SPDX-License-Identifier: {}", "License: {}")
PLAIN = (
    "The software was released under the old name in May and sold well in the first year.", "You can use this program to copy files from one disk to another.",
    "She was granted permission to use the library for any purpose related to her work.", "The general public was invited to the foundation's open day.",
    "Conditions in the north were worse than expected, with no warranty of better weather.", "He published the second version of his book under a different title.",
    "A driving license is required to rent a car, and the fee is not free of charge.", "The council may modify or merge the two public schools without notice.",
    "Her work is distributed in many countries and read in the original language.", "Copies of the letter were sent to all members of the committee.",
    "See the next chapter for more details on how the files are used.", "In no event was the train ever late, as far as the authors could tell.",
    "The terms of the agreement were made available to the press by the commission.", "The project was subject to the approval of the European Commission.",
    "This page describes how to build the source code and run the program.", "The rights of the people are not limited by any other version of the story.",
    "The MIT campus is open to visitors, as is the public library in Boston.", "The Apache helicopter and the eclipse were both seen by the public on that day.")
TEMPLATES = {f: [*texts, *(p.format(n) for n in NAMES[f] for p in PHRASES), *(g.format(i) for i in IDENTIFIERS[f] for g in TAGS)] for f, texts in NOTICES.items()}
NONE, UNKNOWN = "none", "unknown"
FAMILIES = sorted(TEMPLATES)
NEGATIVES = 1500     # corpus paragraphs used as examples of no licence
PIECES = 40          # training pieces cut from each template, at most
PASS, FALSE, COVER, WHOLE, HINT = 0.02, 0.002, 0.5, 0.8, 0.25
# a line that its paragraph goes on after, read from its end: forwards, each letter would look for the end again
RUNS_ON = r"^[^.!?:;。！？\p{L}\p{N}]*[\p{L}\p{N}]"
FILLED = r"[\p{L}\p{N}]"
SCALE = 1 << 30


def words(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(w):
    """Distinct hashes of the word bigrams and trigrams of an array of words."""
    at = lambda k: F.sequence(F.lit(0), F.size(w) - k)
    two = F.when(F.size(w) >= 2, F.transform(at(2), lambda i: F.xxhash64(F.lit(2), F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<bigint>"))
    three = F.when(F.size(w) >= 3, F.transform(at(3), lambda i: F.xxhash64(F.lit(3), F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(two, three))


def _templates(spark: SparkSession) -> DataFrame:
    """(family, words): one row per template."""
    rows = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f in FAMILIES for t in TEMPLATES[f]))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.family", words(F.col("r.text")).alias("words"))


def _pieces(templates: DataFrame) -> DataFrame:
    """(family, grams, held): whole templates and runs of at least three words cut from them."""
    n = F.size("words")
    cut = templates.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    length = F.when(F.col("k") == 0, n).otherwise(F.greatest(F.least(n, F.lit(4)), (n * (1 + F.pmod(F.hash("words", "k"), F.lit(10))) / 10).cast("int")))
    cut = cut.withColumn("len", length).withColumn("from", F.when(F.col("k") == 0, 0).otherwise(F.pmod(F.hash("k", "words"), F.greatest(n - F.col("len") + 1, F.lit(1)))))
    cut = cut.select("family", F.slice("words", F.col("from") + 1, F.col("len")).alias("words"), "k").dropDuplicates(["family", "words"])
    return cut.select("family", grams(F.col("words")).alias("grams"), (F.col("k") % 5 == 4).alias("held"))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph, copy, words): the paragraphs of each text; copy tells rows with the same id apart."""
    # all that is needed of a whole text is computed before its paragraphs become rows, and the words with them: made
    # after, the filter on their number would compute them twice
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), F.split(F.col(text_col).cast("string"), "\n").alias("lines"))
    line = lambda i: F.get("lines", i)
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | ~F.reverse(line(i - 1)).rlike(RUNS_ON) | ~line(i).rlike(FILLED))
    whole = whole.where(F.col("lines").isNotNull()).withColumn("begins", begins)
    text = lambda i, k: F.array_join(F.slice("lines", i + 1, F.coalesce(F.get("begins", k + 1), F.size("lines")) - i), " ")
    rows = whole.select("id", "copy", F.inline_outer(F.transform("begins", lambda i, k: F.struct(i.alias("paragraph"), words(text(i, k)).alias("words")))))
    return rows.where(F.size("words") >= 2)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, float], list[float]]:
    """Weights (gram, w0.. one per class, c1.. whether a family's templates hold it), levels of the families and, under
    NONE, of all of them together, intercepts."""
    spark = docs.sparkSession
    templates = stored(_templates(spark), "templates")
    pieces = stored(_pieces(templates), "pieces")
    vocabulary = templates.select("family", F.explode(grams(F.col("words"))).alias("gram")).groupBy("gram").agg(F.collect_set("family").alias("own"))
    vocabulary = stored(vocabulary, "vocabulary")
    total = docs.count()
    share = min(1.0, 4 * NEGATIVES / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(SCALE)) < int(share * SCALE))
    lines = paragraphs(sample, id_col, text_col).select(grams(F.col("words")).alias("grams")).limit(8 * NEGATIVES)
    # template notices occur in the corpus too: a paragraph that is mostly template n-grams is no example of `none`
    plain = stored(lines.where(F.size("grams") > 0).withColumn("n", F.monotonically_increasing_id()), "plain")
    known = plain.select("n", F.size("grams").alias("size"), "grams").select("n", "size", F.explode("grams").alias("gram")).join(F.broadcast(vocabulary), "gram", "left")
    known = known.groupBy("n").agg((F.count("own") / F.max("size")).alias("share")).where("share < 0.3").limit(NEGATIVES)
    none = plain.join(known.select("n"), "n").select(F.lit(NONE).alias("family"), "grams", (F.col("n") % 5 == 4).alias("held"))
    plain = F.array(*(F.struct((F.lit(k) % 5 == 4).alias("held"), F.lit(s).alias("text")) for k, s in enumerate(PLAIN)))
    plain = spark.range(1).select(F.explode(plain).alias("r")).select(F.lit(NONE).alias("family"), grams(words(F.col("r.text"))).alias("grams"), "r.held")
    rows = pieces.union(none).union(plain).withColumn("label", F.array_position(F.array(*(F.lit(c) for c in [NONE, *FAMILIES])), F.col("family")).cast("double") - 1)
    rows = rows.select("family", "label", "held", F.transform("grams", lambda g: g.cast("string")).alias("terms"))
    rows = stored(rows, "training")
    share = rows.groupBy("family").agg(F.count("*").alias("n")).withColumn("weight", rows.count() / F.when(F.col("family") == NONE, 2.0).otherwise(2.0 * len(FAMILIES)) / F.col("n"))
    rows = stored(rows.join(share.drop("n"), "family"), "weighted")
    counter = CountVectorizer(inputCol="terms", outputCol="features", binary=True, vocabSize=1 << 14).fit(templates.select(F.transform(grams(F.col("words")), lambda g: g.cast("string")).alias("terms")))
    model = LogisticRegression(regParam=0.002, elasticNetParam=0.2, maxIter=30, family="multinomial", standardization=False, weightCol="weight").fit(counter.transform(rows.where("not held")))
    # calibrated level of each family: nearly all of its held-out pieces reach it
    seen = model.transform(counter.transform(rows.where(F.col("family") != NONE))).select("family", vector_to_array("probability")[F.col("label").cast("int")].alias("p"), "held")
    levels = {r.family: min(0.9, max(0.2, r.level)) for r in seen.where("held").groupBy("family").agg(F.percentile_approx("p", PASS).alias("level")).collect()}
    held = model.transform(counter.transform(rows.where((F.col("family") == NONE) & F.col("held")))).select((1 - vector_to_array("probability")[0]).alias("p"))
    levels[NONE] = max(0.5, held.agg(F.coalesce(F.percentile_approx("p", 1 - FALSE), F.lit(0.5))).first()[0])
    matrix = model.coefficientMatrix.toArray().T.tolist()
    weights = spark.createDataFrame([(int(g), w) for g, w in zip(counter.vocabulary, matrix)], "gram long, w array<double>").join(vocabulary, "gram")
    weights = weights.select("gram", *(F.col("w")[k].alias(f"w{k}") for k in range(len(FAMILIES) + 1)), *(F.array_contains("own", f).cast("int").alias(f"c{k + 1}") for k, f in enumerate(FAMILIES)))
    return stored(weights, "weights"), levels, [float(x) for x in model.interceptVector]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, probability, cover): the licence paragraphs; family may be `unknown`."""
    weights, levels, bias = fit(docs, id_col, text_col)
    names = weights.columns[1:]
    lines = paragraphs(docs, id_col, text_col).select("id", "copy", "paragraph", grams(F.col("words")).alias("grams"))
    lines = lines.select("id", "copy", "paragraph", F.size("grams").alias("size"), "grams")
    hit = lines.select("id", "copy", "paragraph", "size", F.explode_outer("grams").alias("gram"))  # the outer form: the other filters on the n-grams first, and computes them twice
    # the weights are one row per template n-gram, whatever the corpus; repeated rows count their n-grams once
    hit = hit.join(F.broadcast(weights.select("gram")), "gram", "left_semi").distinct()
    got = stored(hit.join(F.broadcast(weights), "gram").groupBy("id", "copy", "paragraph", "size").agg(*(F.sum(c).alias(c) for c in names), F.collect_list("gram").alias("found")), "sums")
    logit = F.array(*(F.col(f"w{k}") + F.lit(b) for k, b in enumerate(bias)))
    power = F.transform("logit", lambda x: F.exp(x - F.array_max("logit")))
    got = got.withColumn("logit", logit).withColumn("power", power).withColumn("total", F.aggregate("power", F.lit(0.0), lambda a, x: a + x))
    ranked = F.array_max(F.array(*(F.struct((F.col("power")[k + 1] / F.col("total")).alias("p"), F.lit(f).alias("family"), (F.col(f"c{k + 1}") / F.col("size")).alias("cover"),
                                            F.lit(levels.get(f, 0.5)).alias("level")) for k, f in enumerate(FAMILIES))))
    got = got.withColumn("p_none", F.col("power")[0] / F.col("total")).where(1 - F.col("p_none") >= levels[NONE]).withColumn("best", ranked)
    # of the templates of the best family, the one that the paragraph holds most of; as many rows as families
    own = _templates(docs.sparkSession).select("family", grams(F.col("words")).alias("t")).where(F.size("t") > 0).groupBy("family").agg(F.collect_list("t").alias("templates"))
    got = got.withColumn("family", F.col("best.family")).join(F.broadcast(own), "family")
    got = got.withColumn("whole", F.array_max(F.transform("templates", lambda x: F.size(F.array_intersect(x, "found")) / F.size(x))))
    got = got.where((F.size("found") >= HINT * F.col("size")) | (F.col("whole") >= WHOLE))
    sure = (F.col("best.p") >= F.col("best.level")) & ((F.col("best.cover") >= COVER) | (F.col("whole") >= WHOLE))
    return got.select(F.col("id").alias(id_col), F.col("paragraph").cast("long").alias("paragraph"), F.when(sure, F.col("best.family")).otherwise(UNKNOWN).alias("family"),
                      F.round(F.when(sure, F.col("best.p")).otherwise(1 - F.col("p_none")), 6).alias("probability"), F.round("best.cover", 6).alias("cover"))


def op1_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs)
