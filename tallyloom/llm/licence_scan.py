"""Licence scans with DataFrame functions only: TF-IDF cosine to templates, then inheritance from the nearest directory.

Each line of a file, and the whole of a licence file, is a sparse TF-IDF vector that is compared with the templates. A
file without a licence of its own takes that of the nearest directory above it which holds a licence file.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Template:
    licence: str
    text: str


# The notices by which the licences are known.
TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    Template("MIT", "Released under the MIT License."),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def words_of(template: str) -> list[str]:
    return re.findall(r"[^\W_]+", template.lower())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def units(files: DataFrame) -> DataFrame:
    """(path, unit, words): the lines that have words, numbered from 0, and as unit -1 the whole of a licence file."""
    text = F.coalesce("text", F.lit(""))
    whole = F.when(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.array(F.struct(F.lit(-1).alias("unit"), text.alias("line"))))
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("unit"), line.alias("line")))
    return (
        files.where("path is not null").select("path", F.explode(F.concat(F.coalesce(whole, F.expr("cast(array() as array<struct<unit:int,line:string>>)")), lines)).alias("u"))
        .select("path", "u.unit", _words(F.col("u.line")).alias("words")).where(F.size("words") > 0)
    )


def weights(files: DataFrame, templates: tuple[Template, ...]) -> tuple[dict[str, float], float]:
    """Inverse document frequency of the templates' words over all units, and that of a word without any.

    The counts of the templates' words, one row for each, are all that reaches the driver.
    """
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    counted = units(files).select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", F.array(*map(F.lit, vocabulary))))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counted.collect()}
    total = found.pop("", 0)
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) + 1 for w in vocabulary}, math.log(1 + total) + 1


def _template_vectors(templates: tuple[Template, ...], idf: dict[str, float]) -> list[tuple[int, str, str, float]]:
    rows = []
    for i, t in enumerate(templates):
        own = {w: words_of(t.text).count(w) * idf[w] for w in words_of(t.text)}
        size = math.sqrt(sum(x * x for x in own.values()))
        rows += [(i, t.licence, w, x / size) for w, x in sorted(own.items())]
    return rows


def _needed(vectors: list[tuple[int, str, str, float]], threshold: float) -> list[str]:
    """Words of which a unit must have one to reach the threshold with any template: the lightest words that stay below
    it even all together are left out of each template."""
    needed = set()
    for i in {v[0] for v in vectors}:
        light = 0.0
        for _, _, word, x in sorted((v for v in vectors if v[0] == i), key=lambda v: v[3]):
            light += x * x
            if light >= threshold * threshold * (1 - 1e-9):
                needed.add(word)
    return sorted(needed)


def matches(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, similarity, unit): the best match of each file that has one at the threshold or above.

    The words of a unit count tf x idf; words outside the templates have the highest idf. Units that cannot reach the
    threshold with any template, having none of the words it takes, are left out before anything is joined. Ties go to
    the first licence by name, then the first unit.
    """
    idf, rare = weights(files, templates)
    vectors = _template_vectors(templates, idf)
    spark = files.sparkSession
    table = spark.createDataFrame(vectors, "template int, licence string, word string, weight double")
    known = F.create_map(*[F.lit(x) for pair in sorted(idf.items()) for x in pair])
    near = units(files).where(F.arrays_overlap("words", F.array(*map(F.lit, _needed(vectors, threshold)))))
    terms = near.select("path", "unit", F.explode("words").alias("word")).groupBy("path", "unit", "word").agg(F.count("*").alias("tf"))
    terms = terms.withColumn("x", F.col("tf") * F.coalesce(known[F.col("word")], F.lit(rare)))
    sizes = terms.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dots = terms.join(F.broadcast(table), "word").groupBy("path", "unit", "template", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(sizes, ["path", "unit"]).withColumn("similarity", F.round(F.col("dot") / F.col("size"), 9)).where(F.col("similarity") >= threshold)
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "licence", "unit")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.far")).alias("similarity"), F.col("b.unit").alias("unit"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def licences(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every path with (licence, basis, similarity, source): its own licence, the nearest directory's, or none.

    The licence file of a directory with the best match, then the first by path, speaks for the directory. Directories
    are resolved first, each once, by joining its ancestors to those that have a licence; files, of which one directory
    may hold a third, then join their directory's single row. Null paths are left out; a path listed twice comes back
    twice; null and empty texts have no licence of their own.
    """
    paths = files.where("path is not null").select("path")
    own = matches(files, templates, threshold)
    by_dir = (
        own.where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE))
        .groupBy(parent(F.col("path")).alias("above")).agg(F.min(F.struct((-F.col("similarity")).alias("far"), "path", "licence")).alias("b"))
        .select("above", F.col("b.licence").alias("dir_licence"), F.col("b.path").alias("dir_source"))
    )
    dirs = paths.select(parent(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("above")))
    resolved = (
        dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above").join(by_dir, "above")
        .groupBy("dir").agg(F.max(F.struct("depth", "dir_licence", "dir_source")).alias("b")).select("dir", "b.dir_licence", "b.dir_source")
    )
    joined = paths.withColumn("dir", parent(F.col("path"))).join(own, "path", "left").join(resolved, "dir", "left")
    return joined.select(
        "path", F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("basis"),
        "similarity", F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("dir_source")).alias("source"),
    )
