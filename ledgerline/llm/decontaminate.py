"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

Every window of an item (``window`` consecutive words, or the whole item where it is shorter) must occur word by word.
Its words are ordered by rarity in the corpus; as containment is exact, the necessary prefix is one word, the rarest.
Words of documents join the windows on that word only; the place of the word in the window gives the one place the
window could have (positional bound), which must lie inside the text (length bound); the words there are then
compared. Documents never leave their scan task: what is shuffled is a row per document and per real occurrence.

The windows are broadcast in blocks of at most ``BLOCK_BYTES`` by their measured size; a larger benchmark takes more
passes over the documents, not a larger broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 32 << 20


def padded_words(text: Column) -> Column:
    """Words of the lower-cased text between two empty strings, so word k is at index k and the last index is n + 1."""
    return F.split(F.concat(F.lit(" "), F.coalesce(ascii_lower(text), F.lit("")), F.lit(" ")), SEPARATORS, -1)


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """words, items: each distinct window with the sorted ids of the items that hold it. Items without words have none."""
    words = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.filter(padded_words(F.col("text")), lambda w: w != "").alias("w")
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        words.select("item", "w", F.explode(starts).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.lit(window)).alias("words"))
        .groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _blocks(windows: DataFrame) -> int:
    size = F.sum(F.lit(64) + F.octet_length(F.concat_ws(" ", "words")) * 2 + F.octet_length(F.concat_ws(" ", "items")))
    return max(1, math.ceil((windows.select(size).first()[0] or 0) / BLOCK_BYTES))


def corpus_counts(docs: DataFrame, windows: DataFrame, blocks: int) -> DataFrame:
    """word, n: how often each word of the windows stands in all documents (absent words are not listed)."""
    own = windows.select(F.explode("words").alias("word")).distinct()
    parts = [
        docs.select(F.explode(padded_words(F.col("text"))).alias("word"))
        .join(F.broadcast(own.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b)), "word")
        for b in range(blocks)
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    return every.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its rarest word (``word``; ties: the first in the window) and that word's place (``place``)."""
    placed = windows.select("words", "items", F.posexplode("words").alias("place", "word"))
    rarest = F.min_by(F.struct("place", "word"), F.struct(F.coalesce("n", F.lit(0)), "place"))
    return (
        placed.join(counts, "word", "left").groupBy("words").agg(rarest.alias("a"), F.first("items").alias("items"))
        .select("words", "items", "a.place", "a.word")
    )


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, digest (of the text), end (index after the last word, on two rows for each input row, else null),
    start, span, items (null on those two rows): every occurrence of every window."""
    windows = item_windows(benchmark, window).cache()
    blocks = _blocks(windows)
    index = anchored(windows, corpus_counts(docs, windows, blocks))
    frame = docs.sparkSession.range(1).select(  # one row that meets the empty strings around the words
        F.lit("").alias("word"), F.lit(0).alias("place"), F.lit(None).cast("array<string>").alias("words"),
        F.lit(None).cast("array<string>").alias("items"))
    words = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), padded_words(F.col("text")).alias("w"))
    found = None
    for b in range(blocks):
        side = index.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).select("word", "place", "words", "items")
        side = side.unionAll(frame) if b == 0 else side
        start = F.col("at") - F.col("place")
        fits = (start >= 1) & (start + F.size("words") <= F.size("w"))
        same = F.when(fits, F.slice("w", F.when(fits, start + 1).otherwise(1), F.size("words")) == F.col("words"))
        part = (
            words.select("doc_id", "digest", "w", F.posexplode("w").alias("at", "word"))
            .join(F.broadcast(side), "word").where(F.col("words").isNull() | same)
            .select("doc_id", "digest", F.when(F.col("words").isNull(), F.col("at")).alias("end"),
                    F.when(F.col("words").isNotNull(), start).alias("start"), F.size("words").alias("span"), "items")
        )
        found = part if found is None else found.unionAll(part)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings): a row for each input row.

    A null or empty text has no words and no hits. Rows are told apart by id and text: repeated rows each get the
    same answer, rows that share an id but not the text get their own. Null ids are kept. Other columns are not read.
    An empty benchmark hits nothing; items without words are ignored, repeated items count once.
    """
    hits = F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "span"))))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["upto"], h["start"] + h["span"]).alias("upto"),
            (a["n"] + F.greatest(h["start"] + h["span"] - F.greatest(a["upto"], h["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"])
    per_text = occurrences(docs, benchmark, window).groupBy("doc_id", "digest").agg(
        F.max("end").alias("end"), F.count(F.when(F.col("end") == 0, 1)).alias("copies"), hits.alias("hits"),
        F.collect_set("items").alias("items"))
    return per_text.select(
        "doc_id", (F.col("end") - 1).cast("long").alias("n_words"), covered.alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows in whose text a window occurs; all columns and all other rows stay as they are."""
    bad = occurrences(docs, benchmark, window).where("start IS NOT NULL").select(
        F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest")).distinct()
    mine = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (mine == bad["_bad_digest"]), "left_anti")
