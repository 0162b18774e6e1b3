"""Source-row ordinals without a shuffle of the rows and without a single-task pass over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.constants import FIRST_SOURCE_ROW
from ledgerline.functions.text import field

# monotonically_increasing_id keeps the task number above bit 33 and the position below.
POSITION_BITS = 33
TASK_BLOCK = 4096


def running_starts(counts: DataFrame) -> DataFrame:
    """(_task, _start): rows in all tasks before each, summed inside blocks of tasks and then over the blocks."""
    before = Window.unboundedPreceding, -1
    blocked = counts.withColumn("_block", F.floor(F.col("_task") / TASK_BLOCK))
    inside = Window.partitionBy("_block").orderBy("_task").rowsBetween(*before)
    over = Window.orderBy("_block").rowsBetween(*before)  # one row for each 4096 scan tasks
    blocks = blocked.groupBy("_block").agg(F.sum("_rows").alias("_sum")).select(
        F.col("_block").alias("_of"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    return (
        blocked.withColumn("_inside", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .join(F.broadcast(blocks), F.col("_block") == F.col("_of"))
        .select("_task", (F.col("_base") + F.col("_inside")).alias("_start"))
    )


def with_row_numbers(df: DataFrame, name: str = "__row", first: int = FIRST_SOURCE_ROW) -> DataFrame:
    """Add a gap-free ordinal that follows the scan order of ``df``.

    Each task numbers its own rows; one count per task is summed up and broadcast back, so
    the rows themselves are never exchanged. The broadcast has one short row per scan task:
    20 MB for 100 TB in splits of 128 MB. ``df`` must be a scan or a projection or filter of
    one, so that both readings see the same splits.
    """
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    task = F.shiftrightunsigned("_id", POSITION_BITS)
    position = F.col("_id").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    per_task = numbered.select(task.alias("_task")).groupBy("_task").agg(F.count("*").alias("_rows"))
    return (
        numbered.withColumn("_at", task)
        .join(F.broadcast(running_starts(per_task)), F.col("_at") == F.col("_task"))
        .withColumn(name, F.col("_start") + position + F.lit(first))
        .select(*[field(c) for c in df.columns], field(name))
    )


def file_pieces(scan: DataFrame) -> DataFrame:
    """A file scan with the place of each row: ``__file``, ``_offset`` of its split, ``_id`` within the task."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_id"),
    )


def numbered_pieces(
    pieces: DataFrame, name: str = "__row", first: int = FIRST_SOURCE_ROW, per_file: bool = False
) -> DataFrame:
    """Replace the place of each row (:func:`file_pieces`, also of several scans) by its ordinal.

    The files count on in path order, so the ordinal identifies a row of the whole dataset;
    ``per_file`` starts again in each file. A piece (file, offset) is read in order by one
    task. One count per piece is summed within its file and one per file over the files; the
    sums, bounded by the scan tasks, are broadcast back.
    """
    before = Window.unboundedPreceding, -1
    per_piece = pieces.groupBy("__file", "_offset").agg(
        F.count("*").alias("_rows"), F.min("_id").alias("_first_id"))
    inside = Window.partitionBy("__file").orderBy("_offset").rowsBetween(*before)
    starts = per_piece.withColumn("_start", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    if not per_file:
        over = Window.orderBy("_of").rowsBetween(*before)  # one row for each file
        files = per_piece.groupBy(F.col("__file").alias("_of")).agg(F.sum("_rows").alias("_sum")).select(
            "_of", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
        starts = starts.join(F.broadcast(files), F.col("__file") == F.col("_of")).withColumn(
            "_start", F.col("_start") + F.col("_base"))
    places = starts.select(
        F.col("__file").alias("_piece_file"), F.col("_offset").alias("_piece_offset"), "_start", "_first_id")
    kept = [c for c in pieces.columns if c not in ("__file", "_offset", "_id")]
    same = (F.col("__file") == F.col("_piece_file")) & (F.col("_offset") == F.col("_piece_offset"))
    return (
        pieces.join(F.broadcast(places), same)
        .withColumn(name, F.col("_start") + F.col("_id") - F.col("_first_id") + F.lit(first))
        .select(*[field(c) for c in kept], "__file", field(name))
    )


def with_file_row_numbers(
    df: DataFrame, name: str = "__row", first: int = FIRST_SOURCE_ROW, per_file: bool = False
) -> DataFrame:
    """Ordinal in file order of a multi-file text scan, plus ``__file``."""
    return numbered_pieces(file_pieces(df), name, first, per_file)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than the cluster has cores one partition per core.

    For row-wise work (parsing) on few or unsplittable files; a large scan is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
