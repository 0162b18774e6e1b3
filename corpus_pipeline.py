"""Corpus preparation: toxic documents go, boilerplate lines go, one of each near-duplicate group stays, documents with
benchmark passages go, and what is left is encoded.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all rows it is given and returns
the next stage's documents, the last one the encoded documents. ``run`` applies them to the table ``documents``,
writing every stage to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontaminate, linededup, simhash, toxicity
from ledgerline.llm.common import staged, table
from ledgerline.llm.queries import vocabulary_path

#: SQL can express neither the trained model nor the fingerprints; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier scores 0.5 or more. Labels teach on the texts of the documents given,
    at most ``toxicity.MAX_ROWS`` of each class."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources go except for their first occurrence; every document stays, ``n_chars`` follows the text
    of those that lost lines."""
    cut = linededup.remove_lines(docs, F.col("source"))
    count = F.when(F.col("_llm_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", count).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=4, distance=4)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which ten consecutive words, or all words of a shorter item, of the benchmark stand."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, the digest of the decoded text, and whether encoding that text gives the same ids."""
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs)
    return docs
