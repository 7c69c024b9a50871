"""Rasters as tables of rows: (image_id, y, src), src an array<int> of byte values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quantised(vectors: DataFrame, key: str = "vec_id", values: str = "embedding", length: int = 64) -> DataFrame:
    """One row of bytes for each vector: floor((e + 1) * 128), held to 0..255, of its first elements."""
    level = F.transform(F.slice(F.col(values), 1, length), lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1) * 128))).cast("int"))
    return vectors.select(F.lit(0).cast("long").alias("image_id"), F.col(key).cast("long").alias("y"), level.alias("src"))


def stacked(rows: DataFrame, times: int) -> DataFrame:
    """The raster several times over in y. Needs its height, one number."""
    height = rows.agg((F.max("y") + 1).alias("h")).first()["h"] or 0
    return rows.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("k"), "y", "src").select("image_id", (F.col("y") + F.col("k") * F.lit(height)).alias("y"), "src")


def synthetic(spark: SparkSession, width: int, height: int, pattern: str = "gradient") -> DataFrame:
    """RGB test images. gradient: ((x + y), (2x + y), (x + 2y)) mod 256; ramp: byte i is i mod 255 in every row."""
    i = F.sequence(F.lit(0), F.lit(3 * width - 1))
    if pattern == "ramp":
        src = F.transform(i, lambda k: k % 255)
    else:
        y = F.col("id").cast("int")

        def sample(k: Column) -> Column:
            x, c = F.floor(k / 3).cast("int"), k % 3
            return F.when(c == 0, x + y).when(c == 1, 2 * x + y).otherwise(x + 2 * y) % 256

        src = F.transform(i, sample)
    return spark.range(height).select(F.lit(0).cast("long").alias("image_id"), F.col("id").alias("y"), src.cast("array<int>").alias("src"))


def from_buffer(buffers: DataFrame, stride: int) -> DataFrame:
    """(image_id, y, row BINARY) from (image_id, first_y, data), data being whole rows on end; anything else is an error."""
    whole = F.when(F.octet_length("data") % stride != 0, F.raise_error(F.lit("a buffer holds whole rows only"))).otherwise(F.expr(f"octet_length(data) div {stride}"))
    rows = buffers.withColumn("n", whole).where("n > 0").select("image_id", "first_y", "data", F.explode(F.expr("sequence(0L, n - 1)")).alias("k"))
    return rows.select("image_id", (F.col("first_y") + F.col("k")).alias("y"), F.expr(f"substring(data, int(k * {stride} + 1), {stride})").alias("row"))


def pixels(rows: DataFrame, column: str = "src") -> DataFrame:
    """Long form (image_id, y, x, v): a row for each byte. For inspection and oracles; a wide raster stays in arrays."""
    return rows.select("image_id", "y", F.posexplode(column).alias("x", "v"))


