"""Line deduplication by distinct-site spread: boilerplate is a line that stands on many sites.

A HyperLogLog sketch of the sites of each line, merged by aggregation, tells on how many sites it stands. A line whose
estimate lies within ``BAND`` of the threshold is counted exactly before anything is removed. Lines are known
by 128 bits of hash; what is shuffled for counting is a short row per line and task, whatever the text.

Of a boilerplate line the first occurrence (smallest id, then smallest place) may stay, so that no content is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import staged

SITES, LG_K, BAND, SALTS = 10, 8, 0.5, 16


def _lines(text: str = "text") -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame, site: Column) -> DataFrame:
    """doc_id, digest (of the text), place, site, h1, h2: a row for each line that is not blank; null texts have none."""
    text = docs.select("doc_id", site.cast("string").alias("site"), "text", F.xxhash64("text").alias("digest"))
    line = F.col("line")
    return (
        text.select("doc_id", "site", "digest", F.posexplode(_lines()).alias("place", "line")).where(F.trim(line) != "")
        .select("doc_id", "digest", "place", "site", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))
    )


def _of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` of the lines in ``keys`` (one row a line, which it adds). A line that stands in very many places is
    dealt over ``SALTS`` tasks."""
    dealt = keys.withColumnsRenamed({"h1": "_h1", "h2": "_h2"}).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int")
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (salt == F.col("_salt"))
    return rows.join(dealt, same).drop("_h1", "_h2", "_salt")


def spread(rows: DataFrame, sites: int = SITES) -> DataFrame:
    """h1, h2, first (doc_id, digest, place): the lines that stand on at least ``sites`` distinct sites.

    Rows with a null site count for no site. The estimate decides alone where it is further than ``BAND`` times
    ``sites`` from the threshold; with ``2 ** LG_K`` registers that is over seven standard errors away.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "place")
    # A line on one site at most, which is nearly every line, needs no sketch.
    several = rows.groupBy("h1", "h2").agg(
        F.min("site").alias("low"), F.max("site").alias("high"), F.min(place).alias("first")).where(
        F.col("low").isNotNull() if sites <= 1 else F.col("low") < F.col("high")).select("h1", "h2", "first")
    several = staged(several)
    candidates = _of_keys(rows, several.select("h1", "h2")).where("site IS NOT NULL")
    sketched = staged(candidates.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select(
        "h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - BAND)))
    near = sketched.where(F.col("estimate") < sites * (1 + BAND)).select("h1", "h2")
    exact = _of_keys(candidates, near).select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= sites).select("h1", "h2")
    sure = sketched.where(F.col("estimate") >= sites * (1 + BAND)).select("h1", "h2")
    return several.join(sure.unionAll(exact), ["h1", "h2"], "left_semi")


def removals(docs: DataFrame, site: Column, sites: int = SITES, keep_first: bool = True) -> DataFrame:
    """doc_id, digest, places (sorted): the lines to remove, for the rows that lose any."""
    rows = staged(line_rows(docs, site))
    hit = _of_keys(rows, spread(rows, sites))
    if keep_first:
        hit = hit.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
                          & (F.col("place") == F.col("first.place"))))
    return hit.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("place")).alias("places"))


def remove_lines(docs: DataFrame, site: Column, sites: int = SITES, keep_first: bool = True) -> DataFrame:
    """``docs`` with ``_llm_removed`` (lines removed) and ``text`` without its boilerplate lines.

    Every row stays, also one that loses all its lines. Null texts stay null; blank lines are never removed; a
    missing site spreads nothing. Lines are compared as they are, ended by a line feed. Rows that share id and text
    are treated alike, so a repeated row keeps the same first occurrence. Other columns stay as they are.
    """
    gone = removals(docs, site, sites, keep_first).select(
        F.xxhash64("doc_id", "digest").alias("_llm_k1"), F.xxhash64(F.lit(1), "doc_id", "digest").alias("_llm_k2"),
        F.col("places").alias("_llm_places"))
    digest = F.xxhash64("text")
    keyed = docs.withColumns({"_llm_k1": F.xxhash64("doc_id", digest), "_llm_k2": F.xxhash64(F.lit(1), "doc_id", digest)})
    left = F.filter(F.transform(_lines(), lambda line, at: F.struct(line.alias("line"), at.alias("at"))),
                    lambda x: ~F.array_contains("_llm_places", x["at"]))
    cut = F.array_join(F.transform(left, lambda x: x["line"]), "\n")
    return (
        keyed.join(gone, ["_llm_k1", "_llm_k2"], "left")
        .withColumn("text", F.when(F.col("_llm_places").isNull(), F.col("text")).otherwise(cut))
        .withColumn("_llm_removed", F.coalesce(F.size("_llm_places"), F.lit(0)))
        .select(*docs.columns, "_llm_removed")
    )
