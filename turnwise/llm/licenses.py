"""Licence scans (DataFrame operations only): TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Runs of consecutive lines (one, and as many as the longest notice wraps to; lines without a term don't count) are compared as headers
with the notices, and the whole text as a licence file with the notices and with the full licence texts: vectors are sparse and hold
term frequency times the inverse document frequency among the templates; a term that no template has weighs as much as the rarest.
Full texts are compared without their most common words, in vectors of their own, with the whole text and with each of its comments:
runs of lines that begin with a comment mark, and what stands between a comment's or a docstring's marks.
A run can only reach the threshold for a template if it holds one of that template's key terms, chosen so that what is left without
them is too short.  So texts without any such term, and runs around no such line, are left out before words are counted; and runs in
which terms that no notice has weigh too much, by their lines' sums.  Neither changes the result.

A text whose whole is a full licence text is its directory's licence file; one that has a full text as a comment above its code, or that
is a notice, or little more, has that licence itself but gives it to nobody else, since a short file of code with a header looks the same.  Texts without a licence of their own take that of the nearest
directory above them that has one, found by joining the distinct directories' ancestors with the directories of licence files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import skew_join, table

THRESHOLD = 0.8
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"

#: Customary short notices, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file in the project root for license information."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)

#: Words of the templates that any text has; they serve as key terms last.
COMMON = frozenset(("that", "this", "with", "from", "under", "the", "of", "is", "be", "in", "to", "by", "and", "or", "it", "any", "can", "you", "not", "may", "use", "for"))

#: What full licence texts are compared without, as they are long and mostly of these.
STOP = COMMON | frozenset(("a", "an", "are", "as", "at", "all", "if", "for", "its", "no", "on", "other", "such", "that", "which", "will", "your"))
#: A wrapped notice is looked for in as many lines as it has at so many columns.
COLUMNS = 20


def file_templates() -> tuple[tuple[str, str], ...]:
    """Full licence texts by SPDX identifier: a fixed list, read by the driver.  AGPL-3.0 is GPL-3.0 under its other name."""
    texts = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    agpl = [("AGPL-3.0", re.sub(r"(GNU) (General Public License)", r"\1 Affero \2", t, flags=re.IGNORECASE)) for n, t in texts if n == "GPL-3.0"]
    return (*texts, *agpl)


def fold(c: Column) -> Column:
    """A-Z to a-z, and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.translate({c: c + 32 for c in range(65, 91)}))


class Vectors:
    """weights: (template number, licence, term, weight) rows; norms by template; rare: weight of other terms; key: of each template,
    terms without which nothing reaches the threshold.  Terms in stop count nowhere.  Key terms are long ones, or few that weigh much."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD, stop: frozenset[str] = frozenset(), few: bool = False):
        bags = [Counter(x for x in terms(t) if x not in stop) for _, t in templates]
        df = Counter(t for b in bags for t in b)
        n = len(templates)
        idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
        self.stop = sorted(stop)
        self.idf, self.rare = {t: round(x, 12) for t, x in sorted(idf.items())}, round(math.log(1 + n) + 1, 12)
        weights = [[(t, c * self.idf[t]) for t, c in sorted(b.items())] for b in bags]
        self.rows = [(k, templates[k][0], t, w) for k, ws in enumerate(weights) for t, w in ws]
        self.norms = [math.sqrt(sum(w * w for _, w in ws)) for ws in weights]
        self.key: set[str] = set()
        for k, ws in enumerate(weights):
            rest = sum(w * w for _, w in ws)
            limit = (threshold * self.norms[k]) ** 2 * (1 - 1e-5)  # a cosine that is rounded up to the threshold reaches it
            for w, t in sorted(((w, t) for t, w in ws), key=lambda x: (x[1] in COMMON, 0 if few else -len(x[1]), -x[0], x[1])):  # long terms are rare in texts
                if rest < limit:
                    break
                self.key.add(t)
                rest -= w * w

    def key_pattern(self) -> str:
        """A cheap test that every line with a key term passes."""
        return "(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in sorted(self.key)) + ")(?![a-z0-9])"


def default_path() -> Column:
    """Where a row without a path lies: <source>/<each digit of doc_id but the last>/<doc_id>, so that 125 is src/1/2/125."""
    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    inner = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 1), "(.)", "$1/")
    return F.concat(F.coalesce(F.col("source"), F.lit("none")), F.lit("/"), inner, digits)


def _bags(spark: SparkSession, units: DataFrame, v: Vectors) -> DataFrame:
    """(rid, unit, term, tf, idf, w) of units (rid, unit, body); idf is null for terms that no template has."""
    words = units.select("rid", "unit", F.explode(F.regexp_extract_all("body", F.lit(TERM), F.lit(0))).alias("term"))
    words = words.where(~F.col("term").isin(v.stop)) if v.stop else words
    words = words.groupBy("rid", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.broadcast(spark.createDataFrame(list(v.idf.items()), "term string, idf double"))  # the templates' terms: a fixed number
    return words.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(v.rare)))


def _cosines(spark: SparkSession, units: DataFrame, v: Vectors) -> DataFrame:
    """(rid, unit, template, license, cosine) of units (rid, unit, body) that share a term with a template."""
    words = _bags(spark, units, v)
    norms = words.groupBy("rid", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rows = F.broadcast(spark.createDataFrame([(k, i, t, w / v.norms[k]) for k, i, t, w in v.rows], "template int, license string, term string, share double"))
    dots = words.join(rows, "term").groupBy("rid", "unit", "template", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    return dots.join(norms, ["rid", "unit"]).select("rid", "unit", "template", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))


def most_lines(templates=TEMPLATES) -> int:
    """The lines that the longest notice wraps to at COLUMNS columns."""
    return max(math.ceil(len(t) / COLUMNS) for _, t in templates)


def _runs(spark: SparkSession, lined: DataFrame, v: Vectors, most: int, threshold: float) -> DataFrame:
    """(rid, unit, body): the runs of at most most lines of lined (rid, lines) that may reach the threshold.

    Norms of lines add up to no less than the norm of their run, and their squares to no more.  So a run is out if the share of
    terms that some notice has is too small even with the sum of their norms against the sum of the other terms' squares.
    """
    keyed = lined.withColumn("flags", F.transform("lines", lambda x: x.rlike(v.key_pattern()))).where(F.array_contains("flags", True))
    keyed = keyed.withColumn("key", F.filter(F.transform("flags", lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
    square, known = F.col("w") * F.col("w"), F.col("idf").isNotNull()
    sums = _bags(spark, keyed.select("rid", F.posexplode("lines").alias("unit", "body")), v).groupBy("rid", "unit")
    sums = sums.agg(F.sqrt(F.sum(F.when(known, square).otherwise(0.0))).alias("a"), F.sum(F.when(known, 0.0).otherwise(square)).alias("b"))
    sums = sums.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("unit", "a", "b"))).alias("sums"))  # of each of a text's lines
    starts = F.array_distinct(F.flatten(F.transform("key", lambda i: F.sequence(F.greatest(i - (most - 1), F.lit(0)), i))))
    line = F.transform("lines", lambda x, i: F.struct(x.alias("body"), F.get("flags", i).alias("key"), F.get("sums", i)["a"].alias("a"), F.get("sums", i)["b"].alias("b")))
    runs = keyed.join(sums, "rid").select("rid", starts.alias("starts"), line.alias("line"))
    runs = runs.select("rid", F.explode(F.transform("starts", lambda s: F.struct(s.alias("s"), F.slice("line", s + 1, most).alias("line")))).alias("r")).select("rid", "r.s", "r.line")
    total = lambda x, k: F.aggregate(x, F.lit(0.0), lambda a, y: a + y[k])
    share = threshold**2 * (1 - 1e-5)
    may = lambda x: F.exists(x, lambda y: y["key"]) & (total(x, "a") * total(x, "a") * (1 - share) >= total(x, "b") * share)
    runs = runs.select("rid", "s", "line", F.explode(F.filter(F.sequence(F.lit(1), F.size("line")), lambda n: may(F.slice("line", F.lit(1), n)))).alias("n"))
    return runs.select("rid", (F.col("s") * most + F.col("n") - 1).alias("unit"), F.array_join(F.slice("line", F.lit(1), F.col("n"))["body"], "\n").alias("body"))


#: What a comment line begins with; marks that a comment or a docstring stands between; characters of a comment that is compared.
COMMENT_LINE, LEAST_COMMENT = r"^[ \t]*(?:#|//|\*|/\*|--|;|%|<!--|rem )", 300
BETWEEN = "(?s)" + "|".join((r"/\*.*?\*/", '"{3}.*?"{3}', "'{3}.*?'{3}"))


def _comments(body: Column) -> Column:
    """The longer comments of a text."""

    def runs(m: Column) -> Column:
        inside = lambda i: (i >= 0) & F.coalesce(F.get(m, i)["c"], F.lit(False))
        at = lambda edge: F.filter(F.transform(m, lambda x, i: F.when(x["c"] & ~inside(i + edge), i)), lambda i: i.isNotNull())
        cut = lambda r: F.array_join(F.transform(F.slice(m, r["a"] + 1, r["b"] - r["a"] + 1), lambda x: x["x"]), "\n")
        return F.transform(F.arrays_zip(at(-1).alias("a"), at(1).alias("b")), cut)

    marked = F.transform(F.split(body, "\n"), lambda x: F.struct(x.alias("x"), x.rlike(COMMENT_LINE).alias("c")))
    found = F.concat(F.get(F.transform(F.array(marked), runs), F.lit(0)), F.regexp_extract_all(body, F.lit(BETWEEN), F.lit(0)))
    return F.filter(found, lambda x: F.length(x) >= LEAST_COMMENT)


def scan(docs: DataFrame, path: Column | None = None, templates=TEMPLATES, threshold: float = THRESHOLD, files=None) -> DataFrame:
    """(doc_id, path, own_license, own_score, is_license_file, license, license_from) for each row of docs.

    own_license: of the file if the whole text is one of files (default: the full licence texts), else of a comment that is, else of the
    best run of lines, else of the whole text (ties: the first template); is_license_file: the whole text is one of files; license_from: 'own', 'ancestor' (then of the directory in license_dir)
    or null.  Directories with several licence files take the highest score, then the smallest path.  Null texts count as empty; rows
    that repeat are judged alike; rows without doc_id or source lie in folders named none.
    """
    spark, v = docs.sparkSession, Vectors(templates, threshold)
    texts = file_templates() if files is None else files
    t = Vectors(texts, threshold, STOP, few=True)
    body = fold(F.coalesce("text", F.lit("")))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (default_path() if path is None else path).alias("path"), body.alias("body"))
    base = base.withColumn("notice", F.col("body").rlike(v.key_pattern())).withColumn("whole", F.col("body").rlike(t.key_pattern()))
    base = base.withColumn("body", F.when(F.col("notice") | F.col("whole"), F.col("body")))
    base = table(base.withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")), "license-lines")
    lined = base.where("notice").select("rid", F.filter(F.split("body", "\n"), lambda x: x.rlike("[a-z0-9]")).alias("lines"))
    runs = table(_runs(spark, lined, v, most_lines(templates), threshold), "license-runs")
    units = runs.unionByName(base.where("notice").select("rid", F.lit(-1).alias("unit"), "body"))
    found = _cosines(spark, units, v)
    whole = base.where("whole")
    comments = whole.select("rid", F.posexplode(_comments(F.col("body"))).alias("unit", "body")).where(F.col("body").rlike(t.key_pattern()))
    full = _cosines(spark, whole.select("rid", F.lit(-1).alias("unit"), "body").unionByName(comments.withColumn("unit", -2 - F.col("unit"))), t)
    found = found.unionByName(full.withColumn("template", F.col("template") + len(templates))).where(F.col("cosine") >= threshold)
    best = lambda when: F.max(F.when(when, F.struct("cosine", (-F.col("template")).alias("t"), "license")))
    long = F.col("template") >= len(templates)
    own = table(found.groupBy("rid").agg(best(F.col("unit") >= 0).alias("line"), best(~long & (F.col("unit") < 0)).alias("file"), best(long & (F.col("unit") == -1)).alias("full"), best(long & (F.col("unit") < -1)).alias("header")), "own-licenses")
    rows = base.select("rid", "doc_id", "path", "dir").join(own, "rid", "left")
    rows = rows.select("doc_id", "path", "dir", F.coalesce("full.license", "header.license", "line.license", "file.license").alias("own_license"), F.coalesce("full.cosine", "header.cosine", "line.cosine", "file.cosine").alias("own_score"), F.col("full").isNotNull().alias("is_license_file"), F.col("full.license").alias("file_license"), F.col("full.cosine").alias("file_score"))
    rows = table(rows, "licensed")
    files = rows.where("is_license_file").groupBy(F.col("dir").alias("license_dir")).agg(F.min(F.struct((-F.col("file_score")).alias("s"), "path", "file_license")).alias("f"))
    files = files.select("license_dir", F.col("f.file_license").alias("dir_license"))
    dirs = table(rows.where("own_license is null").groupBy("dir").agg(F.count(F.lit(1)).alias("n")), "directories")
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("license_dir"))
    nearest = above.join(files, "license_dir").groupBy("dir").agg(F.max(F.struct(F.length("license_dir").alias("depth"), "license_dir", "dir_license")).alias("a"))
    nearest = table(dirs.join(nearest, "dir", "left").select("dir", "n", "a.license_dir", "a.dir_license"), "nearest")
    out = skew_join(rows.select("doc_id", "path", "dir", "own_license", "own_score", "is_license_file"), nearest, ["dir"], "n")
    inherited = F.col("own_license").isNull() & F.col("dir_license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        "is_license_file",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(inherited, "ancestor").alias("license_from"),
        F.when(inherited, F.col("license_dir")).alias("license_dir"),
    )
