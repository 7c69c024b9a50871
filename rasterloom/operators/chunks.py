"""Cutting rasters into chunks that compress independently, and pairing chunks with what they need of their predecessors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spec import WINDOW


def ranges(images: DataFrame) -> DataFrame:
    """image_id, chunk_id, start_row, end_row, is_start, is_end from (image_id, height, rows_per_chunk)."""
    total = ((F.col("height") + F.col("rows_per_chunk") - 1 - F.pmod(F.col("height") - 1, F.col("rows_per_chunk"))) / F.col("rows_per_chunk")).cast("long")
    each = images.withColumn("total", total).select("*", F.explode(F.expr("sequence(0L, total - 1)")).alias("chunk_id"))
    return each.select(
        "image_id",
        "chunk_id",
        (F.col("chunk_id") * F.col("rows_per_chunk")).alias("start_row"),
        F.least((F.col("chunk_id") + 1) * F.col("rows_per_chunk"), "height").alias("end_row"),
        (F.col("chunk_id") == 0).alias("is_start"),
        (F.col("chunk_id") == F.col("total") - 1).alias("is_end"),
    )


def with_halo(rows: DataFrame, rows_per_chunk: Column, halo: Column, chunks: Column) -> DataFrame:
    """Adds chunk_id and own. A row goes to its own chunk, and as halo to every later chunk that starts within halo rows after it,
    so that chunk can be filtered and compressed from its group alone: its own rows, the rows that rebuild the predecessor's last
    32 KiB, and the row above those. The numbers may differ from image to image."""
    own = F.floor(F.col("y") / rows_per_chunk)
    last = F.least(F.floor((F.col("y") + halo) / rows_per_chunk), chunks - 1)
    sent = rows.select("*", F.explode(F.sequence(own, F.greatest(own, last))).alias("chunk_id"))
    return sent.withColumn("own", F.floor(F.col("y") / rows_per_chunk) == F.col("chunk_id"))


def prior_pairs(chunks: DataFrame) -> DataFrame:
    """Adds prev_chunk_id, null for the first chunk. One row for each chunk, so the window's partitions are small."""
    return chunks.withColumn("prev_chunk_id", F.lag("chunk_id").over(W.partitionBy("image_id").orderBy("chunk_id")))


def filtered_chunks(filtered: DataFrame, rows_per_chunk: int) -> DataFrame:
    """image_id, chunk_id, values: the filtered bytes of each chunk in order, from filter_rows()."""
    chunk = F.floor(F.col("y") / rows_per_chunk).alias("chunk_id")
    grouped = filtered.groupBy("image_id", chunk).agg(F.array_sort(F.collect_list(F.struct("y", "data"))).alias("parts"))
    return grouped.select("image_id", "chunk_id", F.flatten(F.col("parts.data")).alias("values"))


def trailers(chunks: DataFrame) -> DataFrame:
    """image_id, chunk_id, tail: the last 32 KiB of the filtered bytes of the chunk before, which prime the compressor."""
    before = F.lag(F.slice("values", F.greatest(F.lit(1), F.size("values") - WINDOW + 1), F.least(F.lit(WINDOW), F.size("values")))).over(W.partitionBy("image_id").orderBy("chunk_id"))
    return chunks.select("image_id", "chunk_id", before.alias("tail"))
