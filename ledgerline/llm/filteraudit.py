"""Filter interaction audit: what every filter removes at every place of every order of the filters.

A document is reduced to the set of filters it fails, a bit mask; documents of one part (language) with one mask are a
cell, so all that follows works on at most ``2 ** filters`` cells a part. A recursive common table expression extends
prefixes of the filter order by the letters not used yet, meets the cells of its part and carries the bits applied so
far; each level of the recursion gives the figures of its step. Orders are read off the prefixes afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import UPPER, staged

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
LETTERS = "ABCDE"
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_failures(text: Column) -> list[Column]:
    """Whether the text is short (A), repeats its words (B), shouts (C) or holds symbols (D); null texts are empty."""
    text = F.coalesce(text, F.lit(""))
    padded = F.split(F.concat(F.lit(" "), text, F.lit(" ")), WHITE, -1)  # an empty string before and after the words
    words, distinct = F.size(padded) - 2, F.size(F.array_distinct(padded)) - 1
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return [
        words < MIN_WORDS, distinct * 100 < words * MIN_DISTINCT_PERCENT,
        upper.cast("long") * 100 > F.char_length(text).cast("long") * MAX_UPPER_PERCENT, text.rlike(SYMBOLS)]


def document_masks(docs: DataFrame) -> DataFrame:
    """part, doc_id, mask, n: documents by the filters they fail (A is bit 1, E bit 16); n counts repeated rows.

    E fails where a smaller id has the same text, compared by digest. Rows with the smallest id of a text pass it, rows
    without id pass it too: they are neither smaller nor larger than others. A null lang is the part "".
    """
    bits = [F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(text_failures(F.col("text")))]
    rows = staged(
        docs.select(F.coalesce("lang", F.lit("")).alias("part"), "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
                    sum(bits[1:], bits[0]).alias("mask"))
        .groupBy("part", "doc_id", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("_first")).withColumnRenamed("digest", "_digest")
    # Joined by digest and id, so that a text with very many copies meets its first row alone, not all of them.
    copy = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first")), "left").select(
        "part", "doc_id", (F.col("mask") + F.when(copy, F.lit(16)).otherwise(0)).alias("mask"), "n")


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and those labelled good and toxic. Of repeated labels the highest counts;
    labels without a document and documents without a label add nothing."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return masks.join(marks, F.col("doc_id") == F.col("_id"), "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def _over(cells: str, what: str, where: str) -> str:
    return f"aggregate(filter({cells}, x -> {where}), 0L, (a, x) -> a + x.{what})"


def _recursion(letters: str) -> str:
    bits = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(letters))
    removed, fails = "x.mask & s.applied = 0 AND x.mask & l.bit <> 0", "x.mask & l.bit <> 0"
    figures = ", ".join([
        _over("c.cells", "n", "x.mask & (s.applied | l.bit) = 0"), _over("c.cells", "n", removed),
        _over("c.cells", "n", f"{fails} AND x.mask & s.applied <> 0"), _over("c.cells", "n", "x.mask = l.bit"),
        _over("c.cells", "good", removed), _over("c.cells", "toxic", removed)])
    return f"""
WITH RECURSIVE letters AS (SELECT * FROM VALUES {bits} AS t(letter, bit)),
steps(part, prefix, letter, applied, step, {', '.join(FIGURES)}) AS (
  SELECT part, '', '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{parts}}
  UNION ALL
  SELECT s.part, s.prefix || l.letter, l.letter, s.applied | l.bit, s.step + 1, {figures}
  FROM steps AS s JOIN {{parts}} AS c ON s.part = c.part JOIN letters AS l ON s.applied & l.bit = 0
  WHERE s.step < {len(letters)})
SELECT * FROM steps WHERE step > 0"""


def prefix_steps(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, prefix, letter (its last), step (its length) and the figures of that step, for every prefix of every order."""
    spark = cells.sparkSession
    packed = staged(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # the rows are the prefixes times the parts, however many parts there are
    try:
        return staged(spark.sql(_recursion(letters), parts=packed).drop("applied"))
    finally:
        spark.conf.set(ROW_LIMIT, before)


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the figures of that step and shapley (what the step's filter removes, summed over all
    orders): a row for every part, order and step, zeros included.

    Null and empty texts are empty texts: they fail A alone, and E where a smaller id is empty too. A part is a value
    of lang, null and "" being one part; an empty table has none. Repeated rows count each; ``document_masks`` and
    ``mask_cells`` tell of ids and labels. Columns other than doc_id, lang and text are not read.
    """
    steps = prefix_steps(mask_cells(document_masks(docs), labels))
    n = len(LETTERS)
    orders = steps.where(F.col("step") == n).select(
        F.col("part").alias("_part"), F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_step"))
    mine = (F.col("part") == F.col("_part")) & (F.col("prefix") == F.expr("left(filter_order, _step)"))
    rows = orders.join(steps, mine).drop("_part", "_step", "prefix")
    shares = rows.groupBy(F.col("part").alias("_part"), F.col("letter").alias("_letter")).agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, (F.col("part") == F.col("_part")) & (F.col("letter") == F.col("_letter"))).select(
        "part", "filter_order", "step", *FIGURES, "shapley")
