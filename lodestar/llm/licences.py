"""Licence scans: sparse TF-IDF cosines of lines, runs of terms and whole files to templates, then directory inheritance.

DataFrame operations only. Document frequencies of the templates' terms are counted over all files. A line, a file
as a whole, and a run of neighbouring terms as long as a template, whatever lines it crosses or lies in, are sparse
vectors; their cosines to all templates are computed within the row, so only vectors at or over the threshold leave
the scan. A template may need terms (a version, ``lesser``) and bar others, which tell licences apart that share
nearly all their words. What holds no telling term cannot reach the threshold, since
what its other terms can add up to stays below it for every template; so only files and lines with a telling term are
taken apart, and runs are those that line a telling term up with its places in the templates. A directory whose files
include a licence file passes its licence on: each file without one of its own joins its ancestor directories by path
and takes the nearest.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import let

from .shared import cut

#: Cosine from which a line is held to state a template's licence.
THRESHOLD = 0.6
#: Cosine from which a run of terms is: its bounds are chosen to fit a template, so two common words around a telling
#: one ("the rights of") come near it by chance.
RUN_THRESHOLD = 0.8
#: A file is a licence file if it is named so or this share of its distinct lines state a licence.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice)\b"
TERM = "[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*"

_GNU = ("lesser", "library", "affero")
#: Short notices and headings by which public licences are commonly stated, each with the terms that it
#: needs and those that contradict it.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache", "2.0"), ()),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", ("apache", "2.0"), ()),
    ("MIT", "Released under the MIT License", ("mit",), ()),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("granted", "charge"), ()),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu", "3"), (*_GNU, "2", "2.1")),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", ("gnu", "3"), (*_GNU, "2", "2.1")),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", ("gnu", "3"), (*_GNU, "2", "2.1")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu", "2"), (*_GNU, "3", "2.1")),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991", ("gnu", "2"), (*_GNU, "3", "2.1")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version", ("gnu", "2"), (*_GNU, "3", "2.1")),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3", ("lesser", "3"), ("2.1", "affero")),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", ("lesser", "3"), ("2.1", "affero")),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version", ("lesser", "2.1"), ("3", "affero")),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", ("lesser", "2.1"), ("3", "affero")),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", ("affero", "3"), ("lesser",)),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", ("affero", "3"), ("lesser",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla", "2.0"), ()),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", ("bsd-style",), ()),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse", "derived"), ()),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "binary"), ()),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("fee", "distribute", "granted"), ()),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ("cc", "by", "4.0"), ()),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("cc", "by-sa", "4.0"), ()),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("cc", "by-nc", "4.0"), ()),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work", ("waived", "copyright"), ()),
    ("All-Rights-Reserved", "All rights reserved", ("rights", "reserved"), ()),
    *((name, f"SPDX-License-Identifier: {name}", ("spdx-license-identifier", name.lower()), ()) for name in ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "CC-BY-4.0", "CC0-1.0")),
)


def terms(text):
    """The lower-cased terms of a text column, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def template_terms(templates) -> list[tuple[str, int, dict[str, int]]]:
    """(licence, number, term counts) of each template."""
    out = []
    for n, (name, text, *_) in enumerate(templates):
        counts: dict[str, int] = {}
        for t in re.findall(TERM, text):
            counts[t.lower()] = counts.get(t.lower(), 0) + 1
        out.append((name, n, counts))
    return out


def places(templates, telling: list[str]) -> list[tuple[str, int, int]]:
    """(telling term, its place, number of terms) of each place of a telling term in a template."""
    told = [[t.lower() for t in re.findall(TERM, text)] for _, text, *_ in templates]
    return sorted({(t, i, len(row)) for row in told for i, t in enumerate(row) if t in telling})


def runs(texts: DataFrame, templates, telling: list[str]) -> DataFrame:
    """path, terms of the runs of ``texts`` (path, terms) that put a telling term where a template has it."""
    aligned = places(templates, telling)
    most = max(n for _, _, n in aligned)
    marks = F.filter(F.transform("terms", lambda x, i: F.struct(x.alias("term"), i.alias("at"))), lambda s: F.array_contains(F.lit(telling), s["term"]))
    # each telling term with what can belong to a run through it
    near = F.transform(marks, lambda s: F.struct(s["term"].alias("term"), F.least(s["at"], F.lit(most - 1)).alias("at"), F.slice("terms", F.greatest(F.lit(1), s["at"] - (most - 2)), 2 * most - 1).alias("near")))
    spots = texts.select("path", F.explode(near).alias("s")).select("path", "s.*")
    rows = spots.join(F.broadcast(texts.sparkSession.createDataFrame(aligned, "term string, place int, n int")), "term")  # bounded by the templates
    first = F.col("at") - F.col("place")
    return rows.select("path", F.slice("near", F.greatest(F.lit(1), first + 1), F.col("n") + F.least(F.lit(0), first)).alias("terms"))


def cosines(own: Column, idf: dict[str, float], weights: list[dict[str, float]], templates, unseen: float, least: float) -> Column:
    """Array of (s, license), s the negative cosine, of the templates that the vector of the terms ``own`` reaches
    ``least`` with, has the needed terms of and none of the barred.

    Terms of no template weigh ``unseen`` each; their counts come off the sorted array, so a long line costs its sort.
    """
    vocabulary = sorted(idf)
    idf_of = F.create_map(*(x for t in vocabulary for x in (F.lit(t), F.lit(idf[t]))))
    rows_of = F.create_map(*(x for t in vocabulary for x in (F.lit(t), F.array(*(F.lit(idf[t] * w.get(t, 0.0)) for w in weights)))))
    texts = F.array().cast("array<string>")
    told = F.array(*(F.struct(F.lit(name).alias("license"), (F.lit(list(rest[0])) if rest and rest[0] else texts).alias("needs"), (F.lit(list(rest[1])) if rest and rest[1] else texts).alias("bars")) for name, _, *rest in templates))

    def of(v: Column) -> Column:
        known = F.filter(v, lambda x: x.isin(vocabulary))
        return let(F.struct(known.alias("all"), F.array_distinct(known).alias("some"), F.array_sort(F.filter(v, lambda x: ~x.isin(vocabulary))).alias("rest")), scored)

    def scored(k: Column) -> Column:
        counts = F.transform(k["some"], lambda t: F.struct(t.alias("t"), F.size(F.filter(k["all"], lambda x: x == t)).cast("double").alias("n")))

        def step(a: Column, x: Column) -> Column:
            """The k-th of equal terms adds 2k - 1 to the sum of their squared count."""
            n = F.when(a["last"] == x, a["n"] + 1).otherwise(F.lit(1))
            return F.struct(x.alias("last"), n.alias("n"), (a["sum"] + 2 * n - 1).alias("sum"))

        strange = F.aggregate(k["rest"], F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("sum")), step)["sum"]
        return let(F.struct(counts.alias("counts"), (strange * F.lit(unseen * unseen)).alias("strange"), k["some"].alias("some")), reached)

    def reached(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c["counts"], c["strange"], lambda a, x: a + F.pow(x["n"] * idf_of[x["t"]], F.lit(2.0))))
        zero = F.array(*(F.lit(0.0) for _ in weights))
        dots = F.aggregate(c["counts"], zero, lambda a, x: F.zip_with(a, rows_of[x["t"]], lambda p, q: p + x["n"] * q))
        found = let(norm, lambda m: F.transform(dots, lambda d, i: F.struct((-F.round(d / m, 6)).alias("s"), F.get(told, i).alias("of"))))
        fits = lambda x: (x["s"] <= -least) & F.forall(x["of"]["needs"], lambda t: F.array_contains(c["some"], t)) & ~F.arrays_overlap(x["of"]["bars"], c["some"])
        return F.transform(F.filter(found, fits), lambda x: F.struct(x["s"].alias("s"), x["of"]["license"].alias("license")))

    return let(own, of)


def telling_terms(vectors: list[dict[str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """The corpus's rarest terms without which no line reaches the threshold with any template.

    By Cauchy-Schwarz a line that shares only the terms R with a template has a cosine of at most the share of R in
    the template's length; terms are taken as telling until that is below the threshold for every template.
    """
    rest = {t for v in vectors for t in v}
    chosen = []
    for t in sorted(rest, key=lambda t: (-idf[t], t)):
        worst = max(math.sqrt(sum(w * w for x, w in v.items() if x in rest) / sum(w * w for w in v.values())) for v in vectors)
        if worst < threshold:
            break
        chosen.append(t)
        rest.discard(t)
    return chosen


def licence_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, run_threshold: float = RUN_THRESHOLD) -> DataFrame:
    """One row per file: its path, license, score, origin (``own``, ``inherited``, ``none``) and from_dir.

    ``own`` is the licence of the best-scoring line, run of terms or whole file (ties: the first name); ``inherited``
    that of the nearest ancestor directory, its own included, with a licence file, where the best score, then the first
    name counts; from_dir is that directory ('' is the root). A licence file is named so, or states it in its lines
    (``FILE_SHARE``), or says it better as a whole than in any line. ``run_threshold`` is at least ``threshold``. Null paths read as '', a file of the root; null texts as empty. Rows that share a path
    are one file and get one answer each. A template is (licence, text) or (licence, text, needed terms, barred terms).
    A file's score is 0 where it has no licence of its own or by inheritance.
    """
    spark = files.sparkSession
    parsed = template_terms(templates)
    vocabulary = sorted({t for _, _, c in parsed for t in c})
    files = files.select(F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = F.array_intersect(terms(F.col("text")), F.lit(vocabulary)).alias("known")
    # one row over all files for each term of the templates
    counted = files.select(known).select(F.explode(F.concat("known", F.array(F.lit("")))).alias("t")).groupBy("t").count().collect()
    df = {r["t"]: r["count"] for r in counted}
    n = df.get("", 0)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    unseen = math.log(1 + n) + 1  # of terms of no template
    vectors = [{t: c * idf[t] for t, c in counts.items()} for _, _, counts in parsed]
    telling = telling_terms(vectors, idf, threshold)
    weights = [{t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for v in vectors]

    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != ""))
    told = files.where(F.arrays_overlap(known, F.lit(telling)))
    apart = told.select("path", lines.alias("lines")).select("path", F.size("lines").alias("n_lines"), F.explode("lines").alias("line"))
    apart = apart.withColumn("terms", terms(F.col("line"))).where(F.arrays_overlap("terms", F.lit(telling)))
    apart = apart.select("path", F.lit("line").alias("kind"), F.sha2("line", 256).alias("key"), "terms", "n_lines")
    texts = told.select("path", terms(F.col("text")).alias("terms"), known)
    # a file reaches the threshold as a whole only if the part of its vector on the templates' terms has that share of its length
    weight = F.create_map(*(F.lit(x) for pair in idf.items() for x in pair))
    inside = F.aggregate("known", F.lit(0.0), lambda a, t: a + F.pow(F.size(F.filter("terms", lambda x: x == t)) * weight[t], F.lit(2.0)))
    outside = (F.size(F.array_distinct("terms")) - F.size("known")) * unseen ** 2
    small = texts.where(outside <= inside * (1 / max(threshold - 1e-5, 1e-5) ** 2 - 1))
    for kind, rows in (("run", runs(texts, templates, telling)), ("file", small)):
        apart = apart.unionByName(rows.select("path", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("key"), "terms", F.lit(0).alias("n_lines")))
    # of vectors that reach a template only the best licence and the score leave the scan
    fitting = apart.where("kind <> 'run'").withColumn("c", cosines(F.col("terms"), idf, weights, templates, unseen, threshold))
    fitting = fitting.unionByName(apart.where("kind = 'run'").withColumn("c", cosines(F.col("terms"), idf, weights, templates, unseen, run_threshold)))
    fitting = cut(fitting.where(F.size("c") > 0).select("path", "kind", "key", "n_lines", F.array_min("c").alias("b")))
    best = F.min("b")
    score = lambda kind: F.max(F.when(F.col("kind") == kind, -F.col("b.s")))
    stated = fitting.groupBy("path").agg(best.alias("b"), F.count_distinct("key").alias("n_stated"), F.max("n_lines").alias("n_lines"), score("line").alias("of_line"), score("file").alias("of_file"))
    stated = cut(stated.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "n_stated", "n_lines", (F.col("of_file") > F.coalesce("of_line", F.lit(0.0))).alias("whole")))

    parts = F.split("path", "/")
    folder = lambda depth: F.array_join(F.slice(parts, 1, depth), "/")
    by_lines = (F.col("n_stated") > 0) & (F.col("n_stated") >= FILE_SHARE * F.col("n_lines"))
    is_file = F.element_at(parts, -1).rlike(FILE_NAME) | by_lines | F.coalesce("whole", F.lit(False))
    folders = stated.where(is_file).groupBy(folder(F.size(parts) - 1).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("dir", F.col("b.license").alias("d_license"), (-F.col("b.s")).alias("d_score"))
    bare = files.select("path").distinct().join(stated.select("path"), "path", "left_anti")
    up = bare.select("path", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth")).withColumn("dir", F.when(F.col("depth") == 0, "").otherwise(folder(F.col("depth"))))
    nearest = up.join(folders, "dir").groupBy("path").agg(F.max(F.struct("depth", "dir", "d_license", "d_score")).alias("n"))
    answer = stated.select("path", "license", "score", F.lit("own").alias("origin"), F.lit(None).cast("string").alias("from_dir")).unionByName(
        nearest.select("path", F.col("n.d_license").alias("license"), F.col("n.d_score").alias("score"), F.lit("inherited").alias("origin"), F.col("n.dir").alias("from_dir")))
    return files.select("path").join(answer, "path", "left").select("path", "license", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("origin", F.lit("none")).alias("origin"), "from_dir")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source / language / hundred of ids / id."""
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(hundred, F.lit("-")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(".txt")))
    return docs.select(path.alias("path"), "text")
