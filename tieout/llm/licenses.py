"""License scans, in DataFrame functions only.

Texts become words (lowered, runs of ASCII letters and digits) and hashed five-word
shingles. Overlapping windows of WINDOW shingles, one word apart, are sketched by
MinHash; every band is one minimum, and bands come in pairs of a permutation and its
reverse. Windows whose band value a template window has retrieve that template, and the
exact share of the template's shingles around the hit decides.

Why bands miss nothing that verification could keep: with two shingles to a window, a
text that holds two neighbouring shingles of a template has a window equal to one of the
template's, which agrees in every band. A template of a single shingle is the least or
the greatest of any window that holds it, hence the minimum under the permutation or its
reverse.

Texts are never shuffled: retrieval and verification happen in the document's row or in
a slice of its shingles, and the templates are a short fixed list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, WINDOW, CONTAINED = 5, 2, 0.8
#: Permutations: hash XOR constant. Each is used as it is and reversed.
SEEDS = [0x1C69B3F74AC4AE35, -0x2B5F3D87A1E0C9D3]

# Wording of public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    """Split first: of the regular expressions, this form is by far the fastest in the JVM."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingles(words: Column) -> Column:
    """Hash of the five words from each word on; none for shorter texts."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SHINGLE)]))


def permutations() -> list[int]:
    return [c for s in SEEDS for c in (s, ~s)]


def band(h: Column, seed: int) -> Column:
    """Minimum under one permutation of each window of WINDOW shingles; the last windows are shorter."""
    c = F.lit(seed).cast("bigint")
    return F.transform(h, lambda x, i: F.least(x.bitwiseXOR(c), *[F.get(h, i + k).bitwiseXOR(c) for k in range(1, WINDOW)]))


def _shingled(df: DataFrame, *keep: str) -> DataFrame:
    """Shingles as a column of their own."""
    return _once(_once(df, [*keep], words(F.coalesce("text", F.lit(""))), "w"), [*keep], shingles(F.col("w")), "h")


def _once(df: DataFrame, keep: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``value`` so that it is evaluated once per row.

    A plain projection could be merged into later filters and lambdas, which would then
    evaluate it once per element; a generator of one row cannot.
    """
    return df.select(*keep, F.explode_outer(F.array(value)).alias(name))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """license, h (distinct shingles in order), width (shingles of slack on either side included)."""
    t = _shingled(spark.createDataFrame(list(templates.items()), "license string, text string"), "license")
    return t.select("license", F.array_distinct("h").alias("t")).where(F.size("t") > 0)


def _places(values: Column, of: Column) -> Column:
    """Places of the elements that are in ``of``."""
    return F.filter(F.transform(values, lambda v, i: F.when(F.array_contains(of, v), i)), lambda i: i.isNotNull())


def _tagged(values: Column, number: int) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(number).alias("band"), v.alias("value")))


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, first_word, places): licences that the whole text contains to at least CONTAINED.

    ``containment`` is the share of the template's shingles found where it fits best,
    ``first_word`` the first such place (word number), ``places`` how many alignments fit.
    Documents without a licence have no row; null and short texts have none. Rows of one
    doc_id count as one document. Templates of fewer than five words are not allowed.
    """
    spark, templates = docs.sparkSession, templates or TEMPLATES
    known = template_table(spark, templates)
    fixed = known.collect()  # the short list of templates
    if len(fixed) < len(templates):
        raise ValueError(f"a template needs {SHINGLE} words")
    longest = max(len(r.t) for r in fixed)
    reach = 2 * (longest + math.ceil(longest / 4)) + 1
    values = [sorted({min(x ^ c for x in r.t[i : i + WINDOW]) for r in fixed for i in range(max(1, len(r.t) - WINDOW + 1))}) for c in permutations()]

    base = _shingled(docs, "doc_id")
    bands = base.select("doc_id", "h", F.inline_outer(F.array(F.struct(*[band(F.col("h"), c).alias(f"b{k}") for k, c in enumerate(permutations())]))))
    literal = [F.array(*[F.lit(v).cast("bigint") for v in vs]) for vs in values]
    hit = F.lit(False)
    for k, vs in enumerate(literal):
        hit = hit | F.arrays_overlap(f"b{k}", vs)
    near = bands.where(hit)
    # the few documents with a hit: places of the colliding windows, with the shingles around
    places = F.array_distinct(F.concat(*[_places(F.col(f"b{k}"), vs) for k, vs in enumerate(literal)]))
    # outer: a plain explode infers a filter on the places, which would be evaluated for every document
    hits = near.select("doc_id", "h", F.explode_outer(places).alias("i")).where("i is not null")
    start = F.greatest(F.col("i") - reach, F.lit(0))
    around = hits.select("doc_id", "i", start.alias("start"), F.slice("h", start + 1, F.lit(2 * reach)).alias("r"))
    # retrieval: templates with the colliding window's value in the same band
    own = F.array(*[F.struct(F.lit(k).alias("band"), F.least(*[F.get("r", F.col("i") - F.col("start") + j).bitwiseXOR(F.lit(c).cast("bigint")) for j in range(WINDOW)]).alias("value")) for k, c in enumerate(permutations())])
    full = F.greatest(F.size("t") - WINDOW + 1, F.lit(1))
    of = F.flatten(F.array(*[_tagged(F.slice(band(F.col("t"), c), F.lit(1), full), k) for k, c in enumerate(permutations())]))
    index = known.select("license", F.inline(F.array_distinct(of))).distinct()
    retrieved = around.select("doc_id", "start", "r", F.inline(own)).join(F.broadcast(index), ["band", "value"]).join(F.broadcast(known), "license")
    # verification: every alignment of a shared shingle, by exact shingle sets
    shifts = F.array_distinct(F.filter(F.transform("r", lambda x, p: F.when(F.array_position("t", x) > 0, p - F.array_position("t", x).cast("int") + 1)), lambda a: a.isNotNull()))
    aligned = retrieved.select("doc_id", "license", "start", "r", "t", F.explode(shifts).alias("shift"))
    slack = F.ceil(F.size("t") / 4).cast("int")
    low = F.greatest(F.col("shift") - slack, F.lit(0))
    region = F.slice("r", low + 1, F.col("shift") + F.size("t") + slack - low)
    share = F.size(F.array_intersect("t", region)) / F.size("t")
    verified = aligned.select("doc_id", "license", (F.col("start") + F.col("shift")).alias("at"), share.alias("containment"))
    verified = verified.groupBy("doc_id", "license", "at").agg(F.max("containment").alias("containment")).where(F.col("containment") >= CONTAINED)
    best = verified.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min(F.struct(-F.col("containment"), "at")).alias("_m"), F.count(F.lit(1)).alias("places"))
    return best.select("doc_id", "license", "containment", F.col("_m.at").cast("bigint").alias("first_word"), "places")
