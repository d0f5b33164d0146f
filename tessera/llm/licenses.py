"""License scans (DataFrame functions only).

Headers and licence files are compared with templates by sparse TF-IDF cosine: each line, each paragraph (what stands
between blank lines) and each file as a whole; files without a license of their own inherit that of the nearest
ancestor directory with a licence file.

Document frequencies are counted over all files: of the templates' words first, then of all other words of the passages
that are weighed, so that a score depends on shares of files, not on their number. Of a template's words, the lightest
that cannot reach the threshold by themselves are set aside (prefix filter): a passage must hold one of the rest, so
only those that could match are weighed, and none that match are missed.
A licence file is one whose matching passage has at least half of its words, or that is named like one.

Inheritance explodes a path into its ancestors and joins them with the directories that have a license; depth bounds
the rows of a path. Templates, their words and weights are bounded by the templates given.

Defined results: null texts have no license; a null path inherits nothing; of equal scores the first template by name
counts; of several licence files in a directory the best score, then the first name; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import let, plain_words
from tessera.runtime import materialize, small, table

THRESHOLD = 0.6
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
#: Short notices by which files say their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_words(spark, templates: dict[str, str]) -> dict[str, dict[str, int]]:
    """Counts of each template's words, by the same rule as files' words. One small job."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string").select("name", plain_words(F.col("text")).alias("w")).collect()
    return {r["name"]: {w: r["w"].count(w) for w in r["w"]} for r in rows}


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """ls_path, ls_hash, license, score, is_file: a row for each distinct file (path and text) with a license of its own."""
    spark = files.sparkSession
    counts = template_words(spark, templates)
    vocabulary = sorted({w for c in counts.values() for w in c})
    known = F.array(*map(F.lit, vocabulary))
    seen = files.select(F.explode_outer(F.array_intersect(plain_words(F.col(text)), known)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).collect()  # the vocabulary at most
    total = files.select(F.lit(1)).count()
    df = {r["w"]: r["df"] for r in seen if r["w"] is not None}

    def idf(word: str) -> float:
        return math.log((1 + total) / (1 + df.get(word, 0))) + 1e-9

    weights, anchors = [], set()
    for name, c in counts.items():
        vector = {w: n * idf(w) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        weights += [(name, w, x / norm, idf(w)) for w, x in vector.items()]
        rest = 0.0
        for w, x in sorted(vector.items(), key=lambda y: (y[1], y[0])):
            rest += x * x
            if rest >= (threshold * norm) ** 2:
                anchors.add(w)
    key = F.array(*map(F.lit, sorted(anchors)))
    rows = files.select(F.col(path).alias("ls_path"), F.xxhash64(F.col(text)).alias("ls_hash"), F.col(text).alias("t"), let(plain_words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), F.arrays_overlap(w, key).alias("some"))).alias("own"))
    passages = F.concat(F.split("t", "\n"), F.split("t", r"\n[\x20\x09-\x0D]*\n"), F.array("t"))
    lines = rows.filter("own.some").select("ls_path", "ls_hash", F.col("own.n").alias("size"), F.posexplode_outer(passages).alias("at", "line"))
    worded = lines.select("ls_path", "ls_hash", "size", "at", plain_words(F.col("line")).alias("w")).filter(F.arrays_overlap("w", key)).distinct()
    heavy = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, idf(w))])
    by_word = worded.select("ls_path", "ls_hash", "size", "at", F.size("w").alias("length"), F.explode("w").alias("word")).groupBy("ls_path", "ls_hash", "size", "at", "length", "word").agg(F.count(F.lit(1)).alias("tf"))
    by_word = materialize(by_word, "license-words")
    others = small(materialize(by_word.filter(~F.array_contains(known, F.col("word"))).select("word").distinct(), "license-others"), 2_000_000)
    # If others is broadcast, the optimizer moves the join below the counts; if not, fewer rows are joined.
    counted = files.select(F.explode(F.array_distinct(plain_words(F.col(text)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(others, "word", "left_semi")
    idfs = small(materialize(counted.select("word", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1e-9).alias("idf")), "license-idf"), 2_000_000)
    weighed = materialize(by_word.join(idfs, "word", "left").withColumn("x", F.col("tf") * F.coalesce(F.try_element_at(heavy, F.col("word")), "idf")).drop("idf"), "license-weights")
    place = ["ls_path", "ls_hash", "size", "at", "length"]
    norms = weighed.groupBy(*place).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    table_ = F.broadcast(spark.createDataFrame([w[:3] for w in weights], "name string, word string, y double"))  # the templates' words
    dots = weighed.join(table_, "word").groupBy(*place, "name").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    same = [dots[c].eqNullSafe(norms[c]) for c in place]
    scored = dots.join(norms, same[0] & same[1] & same[2] & same[3] & same[4]).select(*[dots[c] for c in place], "name", (F.col("dot") / F.col("norm")).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("ls_path", "ls_hash").agg(F.min_by(F.struct("name", "score", "length", "size"), F.struct((-F.round("score", 9)).alias("s"), "name", "at")).alias("b"))
    named = F.coalesce(F.col("ls_path").rlike(FILE_NAMES), F.lit(False))
    return best.select("ls_path", "ls_hash", F.col("b.name").alias("license"), F.col("b.score").alias("score"), (named | (2 * F.col("b.length") >= F.col("b.size"))).alias("is_file"))


def directory(path: Column) -> Column:
    """What stands before the last slash; "" at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(path: Column) -> Column:
    """The directories of a path from the top ("") down."""
    return F.when(path.isNotNull(), let(F.split(directory(path), "/"), lambda p: F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), "/"))))))


def with_licenses(files: DataFrame, path: str = "path", text: str = "text", **options) -> DataFrame:
    """ls_path, ls_hash, license, score, from_dir (where it is inherited from): a row for each row of `files`; null without any."""
    own = materialize(scan(files, path, text, **options), "licenses")
    folders = own.filter("is_file and ls_path is not null").withColumn("dir", directory(F.col("ls_path"))).groupBy("dir").agg(F.min_by("license", F.struct((-F.round("score", 9)).alias("s"), "ls_path")).alias("dir_license"))
    folders = small(materialize(folders, "license-folders"))
    rows = files.select(F.col(path).alias("ls_path"), F.xxhash64(F.col(text)).alias("ls_hash"))
    mine = own.select(F.col("ls_path").alias("p"), F.col("ls_hash").alias("h"), "license", "score")
    joined = materialize(rows.join(mine, rows["ls_path"].eqNullSafe(F.col("p")) & (rows["ls_hash"] == F.col("h")), "left").drop("p", "h"), "license-own")
    # Each directory is looked up once, however many files it has.
    places = joined.filter("license is null and ls_path is not null").select(directory(F.col("ls_path")).alias("own_dir")).distinct()
    up = places.select("own_dir", F.explode_outer(ancestors(F.concat("own_dir", F.lit("/x")))).alias("dir")).join(folders, "dir")
    nearest = small(materialize(up.groupBy("own_dir").agg(F.max_by(F.struct("dir", "dir_license"), F.length("dir")).alias("up")), "license-nearest"))
    final = joined.withColumn("own_dir", F.when(F.col("license").isNull(), directory(F.col("ls_path")))).join(nearest, "own_dir", "left")
    return final.select("ls_path", "ls_hash", F.coalesce("license", "up.dir_license").alias("license"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("license").isNull(), F.col("up.dir")).alias("from_dir"))


def op2_license_scan(spark, sf_dir):
    """Documents as files of a tree: source / language / id."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")).alias("path"), "text")
    found = with_licenses(files)
    return found.select(F.regexp_extract("ls_path", "([^/]*)$", 1).cast("long").alias("doc_id"), "license", F.round("score", 6).alias("score"), "from_dir")
