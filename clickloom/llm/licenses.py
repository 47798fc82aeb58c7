"""License scans: notices in any line, licence files per folder, and inheritance down the path.

Each line of a file is a possible notice. Lines with enough words of the templates to reach the threshold
become sparse TF-IDF vectors: document frequencies are counted over all lines of all files, words outside the
templates weigh as much as a word never seen. A line is a notice of the template with the greatest
cosine, if that reaches the threshold. A licence file (by its name) is also compared as a whole.
The best notice is a file's own licence; a file without one takes that of the nearest folder above
it whose licence file has one. All of it is built-in expressions and joins by term and by folder;
other lines never leave the row they are in.

Defined cases: a null text has no line; a null path is the empty path, at the root; equal paths are
one file with the lines of all its rows; equal scores go to the template first in name; several
licence files of one folder yield to the best score, then the least path. Lines and texts of any
length are taken whole. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import stored

# Names by SPDX and the usual notices of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Use of this source code is governed"
     " by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
     " software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words that say nothing about a licence.
STOP_WORDS = (
    "a an and any associated at by code copy file files for form general hereby in into is of"
    " person source subject terms that the this to use version without work you"
).split()
LICENCE_FILE = r"(?i)\A(?:licen[cs]e|copying|notice)(?:\.[a-z0-9]+)?\z"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def _terms(text: Column) -> Column:
    """Terms of a text, with repeats, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))
    return F.filter(found, lambda term: ~term.isin(*STOP_WORDS))


def _folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def scan(
    files: DataFrame, threshold: float = 0.6, path: str = "path", text: str = "text"
) -> DataFrame:
    """For every path: licence, score, how it came (own, inherited, none) and the path it is from."""
    spark = files.sparkSession
    named = files.select(
        F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"),
        F.split(F.lower(F.col(f"`{text}`")), "\n").alias("lines"),
    )
    templates = spark.createDataFrame(
        [(number, name, body) for number, (name, body) in enumerate(TEMPLATES)],
        "template int, licence string, body string",
    ).withColumn("terms", _terms(F.col("body")))
    words = sorted({row.term for row in templates.select(F.explode("terms").alias("term")).collect()})
    cue = r"(?<![a-z0-9])(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")(?![a-z0-9])"

    def ours(terms: Column) -> Column:
        return F.filter(terms, lambda term: term.isin(*words))

    # One pass over the texts: how many lines there are, the template words of each, and the lines
    # that can reach the threshold. No term weighs more than one outside the templates; so a line
    # with m template words and o others has a cosine of at most m / sqrt(m * m + o).
    share = threshold**2 / (1 - threshold**2)
    is_file = F.regexp_extract("path", r"[^/]*\z", 0).rlike(LICENCE_FILE)
    lines = (
        named.select(
            "path",
            F.size(F.coalesce("lines", F.array())).cast("long").alias("n_lines"),
            F.transform(
                F.filter("lines", lambda line: line.rlike(cue)),
                lambda line: F.struct(line.alias("unit"), _terms(line).alias("terms")),
            ).alias("cued"),
            F.when(is_file, F.array_join("lines", "\n")).alias("whole"),
        )
        .select(
            "path",
            "n_lines",
            F.flatten(
                F.transform("cued", lambda one: F.array_distinct(ours(one["terms"])))
            ).alias("found"),
            F.filter(
                "cued",
                lambda one: F.pow(F.size(ours(one["terms"])), F.lit(2))
                >= share * (F.size(one["terms"]) - F.size(ours(one["terms"]))),
            ).alias("some"),
            "whole",
        )
    )
    lines = stored(lines, "licence-lines")
    units = (
        lines.select("path", F.explode("some.unit").alias("unit"), F.lit(True).alias("line"))
        .unionByName(
            lines.filter("whole is not null").select(
                "path", F.col("whole").alias("unit"), F.lit(False).alias("line")
            )
        )
        .distinct()
        # From here on a digest stands for the text, which may be long.
        .select("path", F.md5("unit").alias("unit"), "line", _terms(F.col("unit")).alias("terms"))
    )
    counts = lines.select(F.explode("found").alias("term")).groupBy("term")
    counts = counts.agg(F.count("*").alias("df"))
    known = spark.createDataFrame([(w,) for w in words], "term string").join(counts, "term", "left")
    total = lines.agg(F.sum("n_lines")).first()[0] or 0
    rare = F.log(F.lit(float(total + 1))) + 1
    known = known.select(
        "term", (rare - F.log(F.coalesce("df", F.lit(0)) + F.lit(1.0))).alias("idf")
    )
    known = stored(known, "licence-idf")

    weighed = (
        templates.select("template", "licence", F.explode("terms").alias("term"))
        .groupBy("template", "licence", "term")
        .agg(F.count("*").alias("tf"))
        .join(known, "term")
        .withColumn("weight", F.col("tf") * F.col("idf"))
    )
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.pow("weight", 2))).alias("norm"))
    weighed = weighed.join(norms, "template").select(
        "licence", "template", "term", (F.col("weight") / F.col("norm")).alias("share")
    )
    vectors = (
        units.select("path", "unit", "line", F.explode("terms").alias("term"))
        .groupBy("path", "unit", "line", "term")
        .agg(F.count("*").alias("tf"))
        .join(known, "term", "left")
        .withColumn("weight", F.col("tf") * F.coalesce("idf", rare))
    )
    unit = ["path", "unit", "line"]
    sizes = vectors.groupBy(*unit).agg(F.sum(F.pow("weight", 2)).alias("square"))
    dots = (
        vectors.filter("idf is not null")
        .join(weighed, "term")
        .groupBy(*unit, "template", "licence")
        .agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    )
    scored = dots.join(sizes, unit).withColumn(
        "score", F.round(F.col("dot") / F.sqrt("square"), 6)
    )
    best = F.min_by(
        F.struct("licence", "score"), F.struct((-F.col("score")).alias("score"), "licence")
    )
    own = (
        scored.filter(F.col("score") >= threshold)
        .groupBy("path")
        .agg(best.alias("best"))
        .select("path", "best.licence", "best.score")
    )
    own = stored(own, "licence-own")

    # Folders are few against files: each looks up its ancestors, files then join their folder.
    paths = lines.select("path").distinct().withColumn("folder", _folder(F.col("path")))
    granted = (
        own.filter(is_file)
        .withColumn("above", _folder(F.col("path")))
        .groupBy("above")
        .agg(
            F.min_by(
                F.struct("licence", "score", "path"),
                F.struct((-F.col("score")).alias("score"), "path"),
            ).alias("grant")
        )
    )
    parts = F.split("folder", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda depth: F.array_join(F.slice(parts, F.lit(1), depth), "/"),
    )
    folders = (
        paths.select("folder")
        .distinct()
        .select("folder", F.posexplode(F.array_distinct(above)).alias("depth", "above"))
        .join(granted, "above")
        .groupBy("folder")
        .agg(F.max_by("grant", "depth").alias("grant"))
    )
    found = paths.join(own, "path", "left").join(folders, "folder", "left")
    has, gets = F.col("licence").isNotNull(), F.col("grant").isNotNull()
    return found.select(
        "path",
        F.coalesce("licence", "grant.licence").alias("licence"),
        F.coalesce("score", "grant.score").alias("score"),
        F.when(has, "own").when(gets, "inherited").otherwise("none").alias("how"),
        F.when(has, F.col("path")).otherwise(F.col("grant.path")).alias("from_path"),
    )
