"""License scan by MinHash bands over overlapping text windows, with DataFrame functions only.

Words are runs of letters and digits, lower-cased; a shingle is five consecutive ones. Each template belongs to the
smallest window class in which it fits wherever it lies: windows of W shingles that begin every W/2 shingles hold a
whole template of up to W/2+1 shingles. Inside its window a whole template makes up more than W/4 of W shingles, so
their Jaccard similarity is over 0.25 whatever surrounds it, and over 0.2 if a fifth of the template is missing.
With ``BANDS`` bands of one row each, a band agrees with probability J, so a window of similarity 0.2 is retrieved with
probability 1 - 0.8^64 > 0.999999.

A window and a template agree in a band only if the window holds the very shingle that is the template's minimum there.
So windows without any of the templates' minima cannot be retrieved, and their bands are not computed.

A retrieved window, widened by the template's length on either side, is then verified: the share of the template's
distinct shingles that it holds, exactly counted, must reach 0.8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 64
LEAST = 0.8
#: License notices to look for: (name, text).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def shingles(tokens: str) -> Column:
    """Hash of each shingle of a column of words; one of all words where there are fewer."""
    n = F.size(tokens)
    at = lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(SHINGLE)))
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), at)).otherwise(F.array().cast("array<bigint>"))


def minima(own: Column) -> Column:
    """(band, hash of the least shingle under the band's permutation, that shingle) of an array of shingle hashes."""
    least = lambda j: F.array_min(F.transform(own, lambda h: F.struct(F.xxhash64(h, j).alias("order"), h.alias("shingle"))))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.struct(j.alias("band"), least(j).alias("least")))


def templates(spark: SparkSession, given: tuple = TEMPLATES) -> list:
    """Of each template: name, distinct shingles, window class and minima; a list as long as ``given``."""
    quoted = lambda x: x.replace("\\", "\\\\").replace("'", "\\'")
    if not given:
        return []
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{quoted(n)}', '{quoted(t)}')" for n, t in given) + " AS t(name, text)")
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("all", shingles("w")).withColumn("own", F.array_distinct("all"))
    made = rows.select("name", "own", F.size("all").alias("n"), minima(F.col("own")).alias("minima")).orderBy("name").collect()
    if short := [t.name for t in made if not t.n]:
        raise ValueError(f"templates of under {SHINGLE} words: {', '.join(short)}")
    return made


def window_class(n: int) -> int:
    """Shingles of the windows for a template of n shingles: the least power of two W of at least 2 with n <= W/2 + 1."""
    w = 2
    while n > w // 2 + 1:
        w *= 2
    return w


def _windows(wide: int) -> Column:
    """The windows of a class that hold a place of ``at``: (wide, start, begin, region), the region being the window with as many shingles
    on either side as a template of the class can have, and ``begin`` where it begins. So a row carries its window's
    surroundings and not the text."""
    step, side = wide // 2, wide // 2 + 1
    near = F.flatten(F.transform("at", lambda i: F.array(F.floor(i / step).cast("int") - 1, F.floor(i / step).cast("int"))))
    starts = F.array_distinct(F.filter(near, lambda k: k >= 0))
    begin = lambda k: F.greatest(F.lit(0), k * step - side)
    return F.transform(starts, lambda k: F.struct(F.lit(wide).alias("wide"), (k * step).alias("start"), begin(k).alias("begin"), F.slice("h", begin(k) + 1, k * step - begin(k) + wide + side).alias("region")))


def scan(docs: DataFrame, carried: list[str], text_col: str = "text", given: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row for each row of ``docs`` and template in it: the ``carried`` columns, license, containment (share of the template's
    shingles), n_windows (verified windows) and first_word (where the first of its shingles in them begins).

    Texts of fewer than five words, null ones among them, have no shingles and hold no template. Repeated rows are reported
    each, as is each of several templates in a place. Without templates, and in an empty table, nothing is found; a template of under
    five words has no shingle and is refused. Long texts are scanned whole: a row carries a window, never the text. Other
    columns than ``carried`` and the text are not read, whatever their names.
    """
    spark = docs.sparkSession
    known = templates(spark, given)
    if not known:
        return docs.where("false").select(*carried, F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).alias("first_word"))
    sought = sorted({m.least.shingle for t in known for m in t.minima})
    lists = ", ".join(f"({i}, '{t.name}', {window_class(t.n)}, {t.n}, array({', '.join(f'{h}L' if h != -(1 << 63) else 'bigint(-9223372036854775808)' for h in t.own)}))" for i, t in enumerate(known))
    catalog = spark.sql(f"SELECT * FROM VALUES {lists} AS t(t, license, wide, n, own)")
    keys = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, {window_class(t.n)}, {m.band}, {m.least.order}L)" for i, t in enumerate(known) for m in t.minima) + " AS t(t, wide, band, least)")
    row = F.struct(F.monotonically_increasing_id().alias("__row"), *carried)
    hashed = docs.select(row.alias("row"), words(F.col(text_col)).alias("w")).select("row", shingles("w").alias("h"))
    held = hashed.withColumn("at", F.filter(F.transform("h", lambda h, i: F.when(h.isin(sought), i)), lambda i: i.isNotNull()))
    held = held.where("size(at) > 0")
    # windows that hold a sought shingle: of each class, the two that overlap it
    out = [_windows(wide) for wide in sorted({window_class(t.n) for t in known})]
    windows = held.select("row", F.explode(F.concat(*out)).alias("window"))
    own = F.slice("window.region", F.col("window.start") - F.col("window.begin") + 1, F.col("window.wide"))
    # a band agrees only where its least shingle is a template's, so no other band becomes a row
    agreeing = F.filter(minima(own), lambda m: m["least"]["shingle"].isin(sought))
    banded = windows.select("row", "window", F.explode(agreeing).alias("m")).select("row", "window", F.col("window.wide").alias("wide"), F.col("m.band").alias("band"), F.col("m.least.order").alias("least"))
    met = banded.join(F.broadcast(keys), ["wide", "band", "least"]).drop("wide", "band", "least")  # as many keys as templates and bands
    met = met.join(F.broadcast(catalog), "t")
    begin = F.greatest(F.lit(0), F.col("window.start") - F.col("n"))
    region = F.slice("window.region", begin - F.col("window.begin") + 1, F.col("window.start") - begin + F.col("window.wide") + F.col("n"))
    share = F.size(F.array_intersect("own", region)) / F.size("own")
    first = begin + F.array_min(F.filter(F.transform("own", lambda h: F.array_position(region, h)), lambda i: i > 0)).cast("int") - 1
    met = met.select("row", "license", "window.wide", "window.start", share.alias("share"), first.alias("first")).where(F.col("share") >= least)
    found = met.groupBy("row", "license").agg(F.max("share").alias("containment"), F.count_distinct("wide", "start").alias("n_windows"), F.min("first").alias("first_word"))
    return found.select(*(F.col(f"row.{c}").alias(c) for c in carried), "license", F.round("containment", 6).alias("containment"), "n_windows", "first_word")
