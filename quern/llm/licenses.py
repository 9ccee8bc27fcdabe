"""Licence scan with DataFrame functions only (operator 8).

A *header* is a line that speaks of a licence. In a document with headers, or named like a licence file, *blocks* are looked at: each header line, each
paragraph that holds one, and the whole text. Blocks and templates (short notices and whole licence texts) are vectors of TF-IDF
weights: the document frequency of a term, of a template or not, is the share of the documents with
headers that have it in one, counted as if they were as many as the templates, plus that of the templates. So
weights do not depend on the size of the corpus, and a word that no other header has weighs the same in any. A block takes the template of the largest cosine, if that reaches ``LEAST``.
A document's own licence is that of its best block. A document whose whole text is near a template, that is little else than
its headers (``FILE_SHARE`` of its words), or is named like one, is a *licence file*: its licence holds for its directory. A document
without one of its own inherits from the nearest directory above it that has a licence file.

Equal blocks are scored once; only tables bounded by the templates are broadcast (their terms), the weights of other
terms are joined; the inheritance is an equi-join of directories with their ancestors, over distinct directories.

Ties: larger cosine, then licence name; in a directory also the smaller path. Null text has no header; a null
path has no directory, so it inherits nothing. Repeated rows get equal results. Columns of ``docs`` besides doc_id, text and the path's play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import templates
from quern.storage import scratch, stored

#: Licence names and the notices that stand for them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "ISC": "Released under the ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: All templates: the notices, the line that names the licence by its SPDX identifier, and longer notices and whole texts.
NOTICES = [*TEMPLATES.items(), *((name, f"SPDX-License-Identifier: {name}") for name in {**TEMPLATES, **dict(templates.TEXTS)}), *templates.TEXTS]
HEADER = r"(?i)licen[sc]e|copyright|spdx|public domain|released under"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|copyright)[^/]*$"
LEAST, FILE_SHARE = 0.6, 0.5


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def _headers(docs: DataFrame) -> DataFrame:
    """docs (rid, path, text, ...) with a header or such a name: rid, the distinct headers, the distinct blocks with whether they are the whole text, and the headers' share of all words."""
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: x.rlike(HEADER))
    paragraphs = F.filter(F.split("text", r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)"), lambda x: x.rlike(HEADER))
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    with_header = docs.filter(F.col("text").isNotNull() & (F.col("text").rlike(HEADER) | named)).withColumn("lines", F.transform(lines, lambda x: F.trim(x))).withColumn("whole", F.trim("text"))
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    words = F.aggregate("lines", F.lit(0), lambda a, x: a + count(x))
    blocks = F.array_distinct(F.concat("lines", F.transform(paragraphs, lambda x: F.trim(x)), F.array("whole")))
    blocks = F.transform(blocks, lambda x: F.struct(x.alias("block"), (x == F.col("whole")).alias("whole")))
    return with_header.select("rid", F.array_distinct("lines").alias("lines"), blocks.alias("blocks"), (words / F.greatest(count(F.col("text")), F.lit(1))).alias("share"))


def _match(headers: DataFrame) -> DataFrame:
    """(block, licence, score) of each distinct block that reaches a template; ``block`` is its hash and length."""
    spark = headers.sparkSession
    notices = spark.createDataFrame(NOTICES, "licence string, notice string").withColumn("terms", terms(F.col("notice")))
    vocabulary = notices.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("own"))
    docs = headers.count()
    words = headers.select(F.explode(F.array_distinct(F.flatten(F.transform("lines", lambda x: F.array_distinct(terms(x)))))).alias("term"))
    df = words.groupBy("term").agg(F.count("*").alias("found"))
    size = float(len(NOTICES))
    share = F.coalesce("found", F.lit(0)) / F.lit(max(docs, 1))
    idf = F.log(F.lit(2 * size + 1) / (F.coalesce("own", F.lit(0)) + share * size + 1)) + 1
    weights = stored(df.join(vocabulary, "term", "full").select("term", idf.alias("idf"), F.col("own").isNotNull().alias("known")), "idf")
    few, others = weights.filter("known").select("term", "idf"), weights.filter("not known").select("term", "idf")  # few: as many rows as the templates have terms
    own = notices.select("licence", "notice", F.explode("terms").alias("term")).groupBy("licence", "notice", "term").agg(F.count("*").alias("tf")).join(F.broadcast(few), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = own.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    own = own.join(F.broadcast(norms), "notice").select("licence", F.xxhash64("notice").alias("notice"), "term", (F.col("w") / F.col("norm")).alias("tw"))
    blocks = headers.select(F.explode("blocks.block").alias("text")).select(identity(F.col("text")).alias("block"), "text").dropDuplicates(["block"])
    tf = stored(blocks.select("block", F.explode(terms(F.col("text"))).alias("term")).groupBy("block", "term").agg(F.count("*").alias("tf")).join(F.broadcast(few), "term", "left"), "terms")
    weigh = lambda rows: rows.select("block", "term", (F.col("tf") * F.col("idf")).alias("w"))
    known = weigh(tf.filter("idf is not null"))
    none = F.lit(math.log(2 * size + 1) + 1)  # a word that stands in no header line
    unknown = weigh(tf.filter("idf is null").drop("idf").join(others, "term", "left").withColumn("idf", F.coalesce("idf", none)))
    length = known.union(unknown).groupBy("block").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dot = known.join(F.broadcast(own), "term").groupBy("block", "licence", "notice").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dot.join(length, "block").withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).filter(F.col("score") >= LEAST)
    best = scored.groupBy("block").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("b"))
    return best.select("block", F.col("b.licence").alias("licence"), (-F.col("b.less")).alias("score"))


def identity(text: Column) -> Column:
    """What tells blocks apart, without their text."""
    return F.struct(F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


@scratch()
def scan(docs: DataFrame, path: Column) -> DataFrame:
    """(doc_id, path, licence, score, origin, inherited_from) for every row of ``docs`` (doc_id, text); origin: header, inherited or null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "path", "text"))
    headers = stored(_headers(rows), "headers").dropDuplicates(["rid"])
    blocks = headers.select("rid", "share", F.explode("blocks").alias("b")).select("rid", "share", identity(F.col("b.block")).alias("block"), "b.whole").join(_match(headers), "block")
    best = blocks.groupBy("rid").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("b"), F.first("share").alias("share"), F.max("whole").alias("whole"))
    best = best.select("rid", F.col("b.licence").alias("licence"), (-F.col("b.less")).alias("score"), "share", "whole")
    own = stored(rows.select("doc_id", "path", "rid", directory(F.col("path")).alias("dir")).join(best, "rid", "left"), "own", outlive=True)
    files = own.filter("licence is not null and dir is not null").filter(F.col("whole") | (F.col("share") >= FILE_SHARE) | F.col("path").rlike(FILE_NAME))
    chosen = files.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence", "path")).alias("b"))
    chosen = chosen.select(F.col("dir").alias("above"), F.col("b.licence").alias("dir_licence"), (-F.col("b.less")).alias("dir_score"))
    # every distinct directory with itself and all above it
    dirs = own.filter("licence is null and dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    reach = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above")).join(chosen, "above")
    nearest = reach.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "dir_licence", "dir_score")).alias("b")).select("dir", "b.above", "b.dir_licence", "b.dir_score")
    out = own.filter("licence is null").join(nearest, "dir", "left").select(
        "doc_id", "path", F.col("dir_licence").alias("licence"), F.col("dir_score").alias("score"), F.when(F.col("dir_licence").isNotNull(), F.lit("inherited")).alias("origin"), F.col("above").alias("inherited_from")
    )
    kept = own.filter("licence is not null").select("doc_id", "path", "licence", "score", F.lit("header").alias("origin"), F.lit(None).cast("string").alias("inherited_from"))
    return kept.union(out)
