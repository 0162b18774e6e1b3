"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_ROWS, BATCH_ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII takes the faster built-in, which then does the same."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own only where none is set, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there, so a lost executor costs
    a re-read. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python batches of ``TEXT_ROWS`` rows at most from now on: texts are long, and an executor
    holds a batch several times over. A lower setting of the session stays; results do not depend on it."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_ROWS)) <= TEXT_ROWS:
        conf.set(BATCH_ROWS, str(TEXT_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_text(rows: DataFrame) -> DataFrame:
    """doc_id, text, label: of the rows of each id one with the text that hashes lowest; combined before the shuffle."""
    order = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), order).alias("_one")).select("doc_id", "_one.text", "_one.label")
