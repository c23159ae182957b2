"""License scans, in DataFrame operations only.

Every line of a document and every run of consecutive lines of up to RUN_TERMS terms, as a header, and every whole
text, as a license file, is compared with license templates, headers and whole license texts, by the cosine of sparse
TF-IDF vectors. Runs find headers that are wrapped, at any column and with any comment marks; lines without terms don't
count as lines in them. The document frequencies are counted over all documents. A line that shares none of a header's
heaviest terms, those without which the cosine cannot reach the threshold, is not looked at further, neither is a
run with fewer terms of each header than its cosine asks for, or one whose first or last line shares no term with any
header, as it is better without that line, and neither is a whole text, unless its terms hold the threshold's
square of the squared weights of a license text, which by Cauchy and Schwarz the cosine asks for. Nothing else is left out.

A document with a line, a run of lines, or a whole text, that reaches THRESHOLD has that license. A document whose
whole text does is a license file: its license holds for its directory and all below, and
documents without a license of their own inherit from the nearest such directory above them. The
directories' ancestors are joined with the licensed directories by path; documents join with
their directory's result.

Terms outside the templates weigh as much as the templates' mean. Counts weigh 1 + ln(count).

Defined cases: null and empty texts have no license of their own; texts may be of any length; ties between templates go to
the first by name; of several license files in a directory the one with the highest cosine counts,
then the smallest doc_id; repeated rows each get a result; a null source is the directory `_`; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache, reduce
from itertools import accumulate
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.llm.common import cut, cut_table, scope

THRESHOLD = 0.7
#: License statements: headers as they stand in files, and the opening of the license texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
#: Lines that runs are looked for in at once, besides those that the last of them may go on to.
TILE = 64
#: Whole license texts, a file for each in a folder, named as the license.
TEXTS = Path(__file__).parent / "templates"
_NOT_TERM = r"[^\p{L}\p{N}]+"


def terms(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _NOT_TERM), lambda t: t != "")


@cache
def templates() -> list[tuple[str, list[str]]]:
    """Licenses with their templates' terms: headers, then whole texts."""
    whole = [(path.stem, path.read_text()) for path in sorted(TEXTS.glob("*.txt"))]
    return [(name, terms(text)) for name, text in [*TEMPLATES, *whole]]


#: Terms that a run of several lines may have: those of the longest header and some around it on its first and last line.
RUN_TERMS = max(len(terms(text)) for _, text in TEMPLATES) + 16


def weights(documents: int, counts: dict[str, int]) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """Weight of each template term by the number of documents that have it, and the templates as
    vectors of length 1."""
    idf = {t: math.log((1 + documents) / (1 + counts.get(t, 0))) + 1 for _, found in templates() for t in found}
    out = []
    for name, found in templates():
        vector = {t: (1 + math.log(n)) * idf[t] for t, n in Counter(found).items()}
        length = math.sqrt(sum(w * w for w in vector.values()))
        out.append((name, {t: w / length for t, w in vector.items()}))
    return idf, out


def heavy_terms(vectors: list[tuple[str, dict[str, float]]]) -> list[str]:
    """Terms of which a text must have at least one to reach THRESHOLD with any of the templates."""
    out = set()
    for _, vector in vectors:
        rest = sum(w * w for w in vector.values())
        for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < THRESHOLD**2:
                break
            out.add(t)
            rest -= w * w
    return sorted(out)


def least_terms(vector: dict[str, float]) -> int:
    """Different terms that a text must share with a template at least to reach THRESHOLD with it."""
    held = accumulate(sorted((w * w for w in vector.values()), reverse=True))
    return 1 + sum(x < THRESHOLD**2 - 1e-9 for x in held)


def _words(spelt: list[str]) -> Column:
    return F.split(F.lit(" ".join(spelt)), " ")


def _runs(texts: DataFrame, headers: list[tuple[str, dict[str, float]]]) -> DataFrame:
    """(key, part) of runs of several lines of texts (key, text) that may be a header, terms with spaces between. A text's lines are
    gone through in tiles, so that long texts make many small rows."""
    # a line with more terms than a run may have is in none
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.slice(_terms(x), 1, RUN_TERMS + 1)), lambda x: F.size(x) > 0)
    found = texts.select("key", lines.alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all")), F.lit(TILE))
    found = found.select("key", F.explode(F.transform(starts, lambda a: F.slice("all", a, TILE + RUN_TERMS))).alias("lines")).where(F.size("lines") > 1)
    spelt = sorted({t for _, v in headers for t in v})
    found = found.select("key", "lines", F.transform("lines", F.size).alias("n"), F.transform("lines", lambda x: F.arrays_overlap(x, _words(spelt))).alias("has"))
    ends = F.transform(F.sequence(F.lit(1), F.size("n")), lambda b: F.aggregate(F.slice("n", 1, b), F.lit(0), lambda s, x: s + x))
    found = found.select("key", "lines", "n", "has", ends.alias("ends"))
    at = lambda c, k: F.element_at(c, k)
    fits = lambda a, b: at("has", b) & (at("ends", b) - at("ends", a) + at("n", a) <= RUN_TERMS)
    last = lambda a: F.least(a + RUN_TERMS - 1, F.size("n"))
    heads = F.filter(F.sequence(F.lit(1), F.least(F.lit(TILE), F.size("n") - 1)), lambda a: at("has", a))
    runs = F.transform(heads, lambda a: F.transform(F.filter(F.sequence(a + 1, F.greatest(a + 1, last(a))), lambda b: fits(a, b)), lambda b: F.flatten(F.slice("lines", a, b - a + 1))))
    found = found.select("key", F.explode(F.flatten(runs)).alias("run"))
    enough = [F.size(F.array_intersect("run", _words(sorted(v)))) >= least_terms(v) for _, v in headers]
    return found.where(reduce(or_, enough)).select("key", F.array_join("run", " ").alias("part"))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table, bounded by the templates, from a literal."""
    names = [field.split(":")[0] for field in schema.split(", ")]
    made = F.from_json(F.lit(json.dumps([dict(zip(names, row)) for row in rows])), f"array<struct<{schema}>>")
    return F.broadcast(spark.range(1).select(F.explode(made).alias("r")).select("r.*"))


def _scores(rows: DataFrame) -> DataFrame:
    """(key, whole, license, score) for the whole texts, lines and runs of lines of rows (key, text) that reach THRESHOLD."""
    spark = rows.sparkSession
    spelt = sorted({t for _, found in templates() for t in found})
    known = F.array_intersect(_terms(F.col("text")), _words(spelt))
    has = cut_table(rows.select("key", known.alias("has")))
    found = has.select(F.explode("has").alias("t")).groupBy("t").agg(F.count("*")).collect()  # a row for each template term
    idf, vectors = weights(has.count(), {t: n for t, n in found})
    headers, wholes = vectors[: len(TEMPLATES)], vectors[len(TEMPLATES) :]
    # whole texts that may be a license text
    share = _table(spark, [(k, t, w * w) for k, (_, v) in enumerate(wholes) for t, w in v.items()], "number:int, t:string, v:double")
    held = has.where(F.size("has") >= min(least_terms(v) for _, v in wholes)).select("key", F.explode("has").alias("term")).join(share, F.col("term") == F.col("t"))
    held = held.groupBy("key", "number").agg(F.sum("v").alias("held")).where(F.col("held") >= THRESHOLD**2 - 1e-9)
    texts = rows.select("key", "text").join(cut_table(held.select(F.col("key").alias("of")).distinct()), F.col("key") == F.col("of"), "left_semi")
    # lines, runs of them, and whole texts, that may be a header
    heavy = rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(heavy_terms(headers))})(?:$|[^\p{{L}}\p{{N}}])"
    likely = rows.select("key", "text").where(F.lower("text").rlike(heavy))
    lines = likely.select("key", F.explode(F.split("text", "\n")).alias("part")).where(F.lower("part").rlike(heavy)).unionByName(_runs(likely, headers)).withColumn("whole", F.lit(False))
    parts = lines.unionByName(likely.unionByName(texts).select("key", F.col("text").alias("part"), F.lit(True).alias("whole"))).distinct()
    parts = cut(parts.select("key", "whole", F.xxhash64("part").alias("unit"), _terms(F.col("part")).alias("terms")))
    unit = ["key", "whole", "unit"]
    counted = parts.select(*unit, F.explode("terms").alias("term")).groupBy(*unit, "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    weighed = counted.join(_table(spark, sorted(idf.items()), "t:string, idf:double"), F.col("term") == F.col("t"), "left")
    weighed = weighed.select(*unit, "term", (F.col("tf") * F.coalesce("idf", F.lit(sum(idf.values()) / len(idf)))).alias("w"))
    of = _table(spark, [(k, name, t, w) for k, (name, v) in enumerate(vectors) for t, w in v.items()], "number:int, license:string, t:string, v:double")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")))
    dots = weighed.join(of, F.col("term") == F.col("t")).groupBy(*unit, "number", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    lengths = weighed.groupBy(*[F.col(c).alias(f"_{c}") for c in unit]).agg(length.alias("length"))
    same = (F.col("key") == F.col("_key")) & (F.col("whole") == F.col("_whole")) & (F.col("unit") == F.col("_unit"))
    return dots.join(lengths, same).select("key", "whole", "license", F.round(F.col("dot") / F.col("length"), 9).alias("score")).where(F.col("score") >= THRESHOLD)


def _best(score: str, name: str) -> Column:
    """Of (score, name): the highest score, then the first name."""
    return F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n")))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)/?[^/]*$", "")


def scanned(files: DataFrame) -> DataFrame:
    """(doc_id, path, license, score, found) of every row of files (doc_id, path, text); found is
    `file`, `header`, `inherited` or null."""
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "path", "text"))
    with scope(rows.sparkSession) as keep:
        scores = cut(_scores(rows))
        own = scores.groupBy("key").agg(_best("score", "license").alias("b"), F.max("whole").alias("is_file"))
        own = keep(cut_table(own.select(F.col("key").alias("of"), F.col("b.n").alias("license"), (-F.col("b.s")).alias("score"), "is_file")))
    narrow = rows.select("doc_id", "path", "key", directory(F.col("path")).alias("dir"))
    met = narrow.join(own, F.col("key") == F.col("of"), "left").drop("of")
    licensed = met.where("is_file").groupBy(F.col("dir").alias("of")).agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id", "license"))["license"].alias("given"))
    licensed = cut_table(licensed)
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("at")))
    dirs = narrow.groupBy("dir").agg(F.count("*")).select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.at")
    nearest = dirs.join(licensed, F.col("at") == F.col("of")).groupBy(F.col("dir").alias("in")).agg(F.max(F.struct("depth", "given"))["given"].alias("given"))
    out = met.join(cut_table(nearest), F.col("dir") == F.col("in"), "left")
    found = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("license", "given").alias("license"), "score", found.alias("found"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: a directory for each source, in it one for each thousand ids, one for each ten."""
    at = F.col("doc_id").cast("long")
    path = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("_")), F.coalesce(F.expr("cast(doc_id as long) div 1000").cast("string"), F.lit("_")), F.coalesce(F.expr("cast(doc_id as long) div 10 % 100").cast("string"), F.lit("_")), F.coalesce(at.cast("string"), F.lit("_")))
    return docs.select(at.alias("doc_id"), path.alias("path"), "text")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
