"""License scan with DataFrame functions alone: MinHash bands over text windows retrieve templates, shingle containment verifies.

A template of n five-word shingles (of one shingle of all its words, if it has fewer) is looked for in windows of n + s shingles that begin every s = max(1, n // 4)
shingles, so some window holds any occurrence whole. A window with 3/4 of the template's shingles has a Jaccard
similarity of at least 0.75 n / (1.25 n + s) >= 0.4 with it (0.5 for n of four and more), so a band of ROWS = 2 values
agrees with a chance of 0.16 at least and one of BANDS = 48 with a chance over 0.9997. Only windows that can match are
built: each template has key words such that, without any of them, too few of its shingles are left.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5
ROWS, BANDS = 2, 48
CONTAINMENT = 0.75

# Notices and opening paragraphs of common licenses, (name, SPDX identifier, text).
TEMPLATES = (
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "This project is licensed under the MIT License."),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl3-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-notice", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "mit-permission", "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "apache-header", "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "gpl-header", "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (  # opens the licenses of two, three and four clauses alike
        "bsd-opening", "LicenseRef-BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    (
        "bsd-endorsement", "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ),
    ("unlicense-opening", "Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "isc-permission", "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-header", "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
)

#: Notices of fewer words than a shingle has; their shingles, and those of the windows for them, have as many words as they.
SHORT_TEMPLATES = (("rights-reserved", "LicenseRef-All-Rights-Reserved", "All rights reserved."),)


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def key_words(words: list[str], containment: float = CONTAINMENT) -> set[str]:
    """Words, long ones first, so many that the shingles without any of them are too few for a match."""
    shingles = {tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}
    need = math.ceil(containment * len(shingles) - 1e-9)
    chosen: set[str] = set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(not chosen.intersection(s) for s in shingles) < need:
            break
        chosen.add(w)
    return chosen


def _shingles(words: Column, width: int = WORDS) -> Column:
    """Hash of the shingle of width words at each word; of the whole sequence if it is shorter than a shingle."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (width - 1)))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(width)), " ")))
    )


def _of_width(widths: list[int], fn) -> Column:
    """fn of the row's width, which is one of widths."""
    return F.coalesce(*[F.when(F.col("width") == w, fn(w)) for w in widths])


def _split(text: Column) -> Column:
    """Words are runs of ASCII letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _bands(shingles: Column) -> Column:
    """array<struct<band, key>>: each key hashes the least of the shingles under ROWS permutations (exclusive or with a constant)."""
    least = lambda k: F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(F.xxhash64(F.lit(k)))))
    return F.array(
        *[
            F.struct(F.lit(b).alias("band"), F.xxhash64(*[least(b * ROWS + r) for r in range(ROWS)]).alias("key"))
            for b in range(BANDS)
        ]
    )


def license_matches(
    df: DataFrame,
    templates: tuple[tuple[str, str, str], ...] = TEMPLATES + SHORT_TEMPLATES,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each document and template it contains: id, template, spdx, containment (best window's), start_word (its first), n_windows.

    Containment is the share of the template's distinct shingles that stand in one window. A template of fewer than
    WORDS words is one shingle of all its words, so it is found unchanged or not at all. Null, empty and other texts
    without a match have no rows; repeated rows with the same id count as one document. Templates of no words are left
    out; they are few and sent to every task. Other columns are left out.
    """
    spark = df.sparkSession
    known = [(name, spdx, w) for name, spdx, text in templates if (w := words_of(text))]
    sizes = {name: (min(WORDS, len(w)), max(1, len(w) - WORDS + 1)) for name, _, w in known}  # (width, n)
    keys = {s: sorted(set().union(*(key_words(w, containment) for m, _, w in known if sizes[m] == s))) for s in sorted(set(sizes.values()))}
    widths = sorted({width for width, _ in keys})
    if not known:
        return df.select(id_col).where("false").selectExpr(
            id_col, "'' template", "'' spdx", "0D containment", "0 start_word", "0L n_windows"
        )
    rows = ",".join(
        "named_struct('template', '{}', 'spdx', '{}', 'width', {}, 'n', {}, 'words', array({}))".format(name, spdx, *sizes[name], ",".join(f"'{x}'" for x in w))
        for name, spdx, w in known
    )
    table = spark.range(1).select(F.inline(F.expr(f"array({rows})")))
    table = table.select("template", "spdx", "width", "n", F.array_distinct(_of_width(widths, lambda w: _shingles(F.col("words"), w))).alias("known"))
    table = table.select("*", F.explode(_bands(F.col("known"))).alias("b")).select("template", "spdx", "width", "n", "known", "b.band", "b.key")

    every = sorted(set().union(*keys.values()))
    able = df.where(F.lower(text_col).rlike("(?<![a-z0-9])(?:" + "|".join(every) + ")(?![a-z0-9])"))
    docs = able.select(F.col(id_col).alias("id"), _split(F.col(text_col)).alias("words"))
    docs = docs.select("id", "words", *[_shingles(F.col("words"), w).alias(f"shingles_{w}") for w in widths])

    def starts(width: int, n: int) -> Column:
        """First shingles (from 0) of the windows for n shingles of width words that hold a key word."""
        step = max(1, n // 4)
        reach = n + step + width - 1  # words in a window
        spot = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(F.array(*map(F.lit, keys[width, n])), F.get("words", i)))
        near = lambda i: F.sequence(
            F.greatest(F.lit(0), F.ceil((i - reach + 1) / step).cast("int")), F.floor(i / step).cast("int")
        )
        last = F.floor((F.size(f"shingles_{width}") - 1) / step).cast("int")
        begun = F.array_distinct(F.flatten(F.transform(spot, near)))
        window = lambda k: F.struct(F.lit(width).alias("width"), F.lit(n).alias("n"), (k * step).alias("start"), F.lit(n + step).alias("len"))
        return F.transform(F.filter(begun, lambda k: k <= last), window)

    windows = docs.select("*", F.explode(F.concat(*[starts(*s) for s in keys])).alias("w")).select("*", "w.*")
    cut = _of_width(widths, lambda w: F.slice(f"shingles_{w}", F.col("start") + 1, F.col("len")))
    windows = windows.select("id", "width", "n", "start", cut.alias("window"))
    banded = windows.select("*", F.explode(_bands(F.col("window"))).alias("b"))
    banded = banded.select("id", "width", "n", "start", "window", F.col("b.band").alias("band"), F.col("b.key").alias("key"))
    met = banded.join(F.broadcast(table), ["width", "n", "band", "key"])  # BANDS rows for each template
    share = F.size(F.array_intersect("window", "known")) / F.size("known")
    sure = met.withColumn("containment", share).where(F.col("containment") >= containment)
    one = sure.groupBy("id", "template", "spdx", "start").agg(F.max("containment").alias("containment"))
    best = F.max(F.struct("containment", (-F.col("start")).alias("start")))
    out = one.groupBy("id", "template", "spdx").agg(best.alias("best"), F.count(F.lit(1)).alias("n_windows"))
    return out.select(
        F.col("id").alias(id_col), "template", "spdx", "best.containment", (-F.col("best.start")).alias("start_word"), "n_windows"
    )
