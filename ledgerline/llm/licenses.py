"""License scans: Dice coefficient over word bigrams between normalised text and licence templates.

Each line of a document is compared, and the document as a whole where it has several lines. Bags of a and b bigrams
reach a coefficient of t only where a lies between b * t / (2 - t) and b * (2 - t) / t, so every template stands in a
table under each size that can reach it, and stretches of text join that table on their size, which is their number of
words less one. Of those, only stretches with a word that a match must hold have their bigrams made and compared.

A notice that is wrapped over lines or stands inside a longer one is a passage: a window of as many words as the
template has, anywhere in the text. Bigrams of texts that hold a word a match must hold meet the templates' bigrams; only
a window that begins with such a bigram can be a best one, and it must hold enough of them before it is compared.
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, UPPER, ascii_lower, staged

THRESHOLD = 0.75
#: Licence, notice or text as licensors publish it.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def padded_words(text: Column) -> Column:
    """Words (runs of letters, digits and characters beyond ASCII) between two empty strings."""
    return F.split(F.concat(F.lit(" "), text, F.lit(" ")), SEPARATORS, -1)


def bigrams(padded: Column) -> Column:
    """Pairs of neighbouring words of :func:`padded_words`, repeats included."""
    n = F.greatest(F.size(padded) - 3, F.lit(0))
    return F.zip_with(F.slice(padded, F.lit(2), n), F.slice(padded, F.lit(3), n), lambda a, b: F.concat_ws(" ", a, b))


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` computed once a row, however often it is named later: a generator of one element, which
    the optimizer does not merge into the expressions that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def template_sizes(spark: SparkSession, threshold: float, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """size, anchors, templates: for each number of bigrams that can reach ``threshold`` the templates it can reach it
    with, and words of which such a stretch must hold one.

    A coefficient of t with a template of b bigrams needs r = b * t / (2 - t) of them, so of any b - r + 1 bigrams
    one must be there. Those with the longest words are taken, as long words are rare; the longer word of each is its anchor.
    """
    known = spark.createDataFrame(list(templates), "license string, body string").select(
        "license", bigrams(padded_words(ascii_lower(F.col("body")))).alias("pairs")).where(F.size("pairs") > 0)
    n = F.size("pairs")
    low, high = F.ceil(n * threshold / (2 - threshold) - 1e-9), F.floor(n * (2 - threshold) / threshold + 1e-9)
    first, second = (lambda p: F.split_part(p, F.lit(" "), F.lit(1))), (lambda p: F.split_part(p, F.lit(" "), F.lit(2)))
    longer = F.transform("pairs", lambda p: F.when(F.char_length(first(p)) >= F.char_length(second(p)), first(p)).otherwise(second(p)))
    ranked = F.sort_array(F.transform(longer, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))), asc=False)
    anchors = F.transform(F.slice(ranked, F.lit(1), (n - low + 1).cast("int")), lambda x: x["w"])
    sized = known.select(F.struct("license", "pairs").alias("t"), anchors.alias("a"),
                         F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"))
    return sized.groupBy("size").agg(F.collect_list("t").alias("templates"), F.array_distinct(F.flatten(F.collect_list("a"))).alias("anchors"))


def _shared(own: Column, pairs: Column) -> Column:
    """How many bigrams two bags share."""
    return F.aggregate(F.array_distinct(pairs), F.lit(0), lambda n, b: n + F.least(
        F.size(F.filter(own, lambda x: x == b)), F.size(F.filter(pairs, lambda x: x == b))))


def _stretch_matches(docs: DataFrame, threshold: float, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, digest (of the text), place, license, dice: see :func:`license_matches`."""
    sizes = template_sizes(docs.sparkSession, threshold, templates)
    lines = F.split("text", "\n", -1)
    stretches = F.transform(lines, lambda line, at: F.struct(at.alias("place"), line.alias("line")))
    whole = F.array(F.struct(F.lit(-1).alias("place"), F.col("text").alias("line")))
    every = F.when(F.contains("text", F.lit("\n")), F.concat(stretches, whole)).otherwise(stretches)
    cut = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.explode(every).alias("s")).select("doc_id", "digest", "s.place", "s.line")
    words = _bound(cut, "words", padded_words(ascii_lower(F.col("line")))).select("doc_id", "digest", "place", "words")
    sized = _bound(words, "size", F.size("words") - 3)
    near = sized.join(F.broadcast(sizes), "size").where(F.arrays_overlap("words", "anchors"))
    paired = _bound(near, "own", bigrams(F.col("words")))
    able = paired.select("doc_id", "digest", "place", "size", "own", F.explode("templates").alias("t"))
    able = able.select("doc_id", "digest", "place", "size", "own", "t.license", "t.pairs")
    shared = _shared(F.col("own"), F.col("pairs"))
    return (
        able.where(F.arrays_overlap("own", "pairs"))
        .select("doc_id", "digest", "place", "license", (F.lit(2.0) * shared / (F.col("size") + F.size("pairs"))).alias("dice"))
        .where(F.col("dice") >= threshold)
    )


def license_matches(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, place (line number from 0, -1 for the whole document), license, dice: one row for each stretch of text
    and template with a coefficient of ``threshold`` or more. A bigram that both have several times is shared as often
    as the rarer side has it.

    Null and empty texts and stretches of fewer than two words match nothing. Repeated rows match each for itself,
    null ids stay. Other columns are not read. The table of templates is a short list in the plan, so it is broadcast.
    """
    return _stretch_matches(docs, threshold, templates).drop("digest")


def _passage_templates(threshold: float, templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str], int, list[str]]]:
    """(license, bigrams, how many of them a window of the template's size needs, anchors as in :func:`template_sizes`)."""
    out = []
    for license_name, body in templates:
        words = [w for w in re.split(SEPARATORS, body.translate(str.maketrans(UPPER, LOWER))) if w]
        pairs = [f"{a} {b}" for a, b in pairwise(words)]
        need = max(1, math.ceil(len(pairs) * threshold - 1e-9))
        longest = sorted((max(p.split(" "), key=len) for p in pairs), key=len, reverse=True)
        if pairs:
            out.append((license_name, pairs, need, longest[:len(pairs) - need + 1]))
    return out


def passages(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, digest (of the text), start (word from 0), line, last (its first and last line), license, dice: windows
    of a template's number of words with a coefficient of ``threshold`` or more, whatever the line breaks. Of windows
    that overlap the best stays (then the longest, then the first). Repeated rows count once."""
    known = _passage_templates(threshold, templates)
    bodies = docs.sparkSession.createDataFrame(
        [(t, *k[:3]) for t, k in enumerate(known)], "t int, license string, pairs array<string>, need int")
    by_pair = bodies.select(F.explode(F.array_distinct("pairs")).alias("pair"), "t").groupBy("pair").agg(F.collect_list("t").alias("ts"))
    anchors = F.array(*[F.lit(w) for w in sorted({w for k in known for w in k[3]})]).cast("array<string>")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    held = rows.where(F.arrays_overlap(padded_words(ascii_lower(F.col("text"))), anchors))
    words = F.flatten(F.transform(F.split("text", "\n", -1), lambda line, at: F.transform(
        F.filter(padded_words(ascii_lower(line)), lambda w: w != ""), lambda w: F.struct(at.alias("line"), w.alias("word")))))
    held = _bound(held, "words", words).select("doc_id", "digest", "row", "words")
    n = F.greatest(F.size("words") - 1, F.lit(0))
    steps = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.struct(
        F.concat_ws(" ", a["word"], b["word"]).alias("pair"), a["line"].alias("line"), b["line"].alias("next")))
    hits = held.select("doc_id", "digest", "row", n.alias("n"), F.posexplode(steps).alias("at", "s")).select(
        "doc_id", "digest", "row", "n", "at", "s.*").join(F.broadcast(by_pair), "pair")
    hit = F.sort_array(F.collect_list(F.struct("at", "pair", "line", "next"))).alias("hits")
    grouped = hits.select("doc_id", "digest", "row", "n", "at", "line", "next", "pair", F.explode("ts").alias("t")).groupBy(
        "row", "doc_id", "digest", "n", "t").agg(hit).join(F.broadcast(bodies), "t")
    size = F.size("pairs")
    grouped = grouped.where((F.size("hits") >= F.col("need")) & (F.col("n") >= size))
    starts = F.filter(F.sequence(F.lit(0), F.size("hits") - F.col("need")), lambda i: F.get("hits", i + F.col("need") - 1)["at"] < F.get("hits", i)["at"] + size)
    cut = F.transform(starts, lambda i: F.slice("hits", i + 1, size))
    windows = grouped.select("row", "doc_id", "digest", "license", "pairs", F.explode(cut).alias("w"))
    windows = _bound(windows, "own", F.filter("w", lambda x: x["at"] < F.get("w", F.lit(0))["at"] + size))
    first, last = F.get("own", F.lit(0)), F.element_at("own", -1)
    dice = _shared(F.transform("own", lambda x: x["pair"]), F.col("pairs")) / size.cast("double")
    found = windows.select(
        "row", "doc_id", "digest", "license", first["at"].alias("start"), (last["at"] + 1).alias("stop"),
        first["line"].alias("line"), last["next"].alias("last"), dice.alias("dice"), size.alias("size")).where(F.col("dice") >= threshold)
    # Windows that overlap, one by another, are a cluster; the best ones are picked inside it.
    order = Window.partitionBy("row").orderBy("start", "stop", "license", "size")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("open", F.when(F.col("start") <= reach, 0).otherwise(1))
    cluster = opened.withColumn("cluster", F.sum("open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kind = "struct<lack:double,short:int,start:int,stop:int,line:int,last:int,license:string>"
    each = F.struct((-F.col("dice")).alias("lack"), (-F.col("size")).alias("short"), "start", "stop", "line", "last", "license").cast(kind)
    picked = F.aggregate("all", F.array().cast(f"array<{kind}>"), lambda kept, x: F.when(
        F.exists(kept, lambda y: (y["start"] <= x["stop"]) & (x["start"] <= y["stop"])), kept).otherwise(F.concat(kept, F.array(x))))
    best = cluster.groupBy("row", "doc_id", "digest", "cluster").agg(F.sort_array(F.collect_set(each)).alias("all"))
    best = best.select("doc_id", "digest", F.explode(picked).alias("p"))
    return best.select("doc_id", "digest", "p.start", "p.line", "p.last", "p.license", (-F.col("p.lack")).alias("dice")).distinct()


def license_notices(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, place, start, license, dice: the rows of :func:`license_matches` (``start`` is null), and every passage
    (``place`` is its first line, ``start`` its first word) that those do not tell already: none of its lines, nor the
    whole document, matches the same licence, and no stretch that holds all of it matches another one as well as it does."""
    lines = staged(_stretch_matches(docs, threshold, templates))
    wrapped = staged(passages(docs, threshold, templates))
    own = F.array_union(F.sequence("line", "last"), F.array(F.lit(-1)))
    told = lines.distinct().select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("place").alias("_place"),
                                   F.col("license").alias("_license"), F.col("dice").alias("_dice"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    inside = (F.col("line") == F.col("last")) | (F.col("_place") == -1)
    known = wrapped.withColumn("_at", F.explode(own)).join(
        told, same & (F.col("_at") == F.col("_place")) & ((F.col("license") == F.col("_license")) | (inside & (F.col("_dice") >= F.col("dice"))))
    ).select(F.col("_id"), F.col("_digest"), F.col("start").alias("_start")).distinct()
    new = wrapped.join(known, same & (F.col("start") == F.col("_start")), "left_anti")
    return lines.select("doc_id", "place", F.lit(None).cast("int").alias("start"), "license", "dice").unionAll(
        new.select("doc_id", F.col("line").alias("place"), "start", "license", "dice"))
