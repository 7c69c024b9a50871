"""PNG framing: the frames of each image, in order, in either layout, and their bytes on end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import adler32_combine, be32, frame, u8
from ..functions.spec import SIGNATURE, ColorType, RasterSpec, header_problem, side_problem

MOST_DATA = (1 << 32) - 1
_SIDE = "array<struct<position:bigint,tag:string,data:binary>>"


def header_bytes(width: Column, height: Column, depth: Column, color_type: Column) -> Column:
    """Signature and header frame; the three method bytes are 0."""
    body = F.concat(be32(width), be32(height), u8(depth), u8(color_type), F.unhex(F.lit("000000")))
    return F.concat(F.unhex(F.lit(SIGNATURE.hex())), frame(F.lit(b"IHDR"), body))


def combined_adler(chunks: DataFrame, *more: Column) -> DataFrame:
    """image_id, adler, n_chunks, and what else is aggregated: the chunks' checksums folded in order. A few numbers for each chunk reach one group."""
    parts = F.collect_list(F.struct("chunk_id", F.col("n_bytes").alias("n"), "adler"))
    return chunks.groupBy("image_id").agg(adler32_combine(parts).alias("adler"), F.count(F.lit(1)).alias("n_chunks"), *more)


def side_of(images: DataFrame) -> DataFrame:
    """image_id, position, tag, data of the palette and transparency columns of a table of images, where they are."""
    parts = [F.struct(F.lit(k).cast("long").alias("position"), F.lit(tag).alias("tag"), F.col(name).alias("data")) for k, (tag, name) in enumerate((("PLTE", "palette"), ("tRNS", "transparency"))) if name in images.columns]
    one = F.explode(F.filter(F.array(*parts) if parts else F.array().cast(_SIDE), lambda s: s["data"].isNotNull()))
    return images.select("image_id", one.alias("s")).select("image_id", "s.*")


def _frame(ordinal: Column, tag: Column, data: Column) -> Column:
    return F.struct(ordinal.cast("long").alias("ordinal"), tag.alias("tag"), data.alias("frame"))


def _sides(side: DataFrame) -> DataFrame:
    """image_id, side: an image's side data in order."""
    return side.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("position").cast("long").alias("position"), "tag", "data"))).alias("side"))


def headed(header: RasterSpec | DataFrame, totals: DataFrame, side: DataFrame | None) -> DataFrame:
    """totals with header columns, side data in order and n_side. header: one for all images, or a table with a row for each. What is wrong
    with either is an error, and so are two headers for one image."""
    names = ("width", "height", "depth", "color_type")
    if isinstance(header, RasterSpec):
        told, problems = totals.select("*", *(F.lit(int(getattr(header, n))).cast("long").alias(n) for n in names)), []
    else:
        told = header.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_headers"), *(F.first(n).alias(n) for n in names)).join(totals, "image_id", "left")
        problems = [F.when(F.col("n_headers") > 1, "an image has one header"), header_problem(*map(F.col, names))]
    if side is None:
        told = told.withColumn("side", F.array().cast(_SIDE))
    else:
        told = told.join(_sides(side), "image_id", "left").withColumn("side", F.coalesce("side", F.array().cast(_SIDE)))
    if side is not None:
        problems.append(side_problem(F.col("color_type"), F.col("side")))
    else:
        problems.append(F.when(F.col("color_type") == int(ColorType.INDEXED), "indexed rows need a palette"))
    problem = F.coalesce(*problems, F.when(F.coalesce(F.col("n_rows"), F.lit(0)) != F.col("height"), "an image lacks rows or has some twice"))
    return told.withColumn("n_side", F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.size("side")))


def _around(told: DataFrame, streaming: bool, side: bool) -> DataFrame:
    """image_id and parts: the frames of headed() images in order but for the data frames of single chunks, as (ordinal, tag, frame)."""
    header = header_bytes(F.col("width"), F.col("height"), F.col("depth"), F.col("color_type"))
    sides = F.transform("side", lambda s, i: _frame(i + 1, s["tag"], frame(s["tag"].cast("binary"), s["data"]))) if side else None
    ending = F.when(F.col("n_chunks") > 1, be32(F.col("adler"))).otherwise(F.lit(b""))
    data, after = (ending, F.col("n_chunks")) if streaming else (F.concat("joined", ending), F.lit(0))
    at = F.col("n_side") + 1 + after
    rest = F.array(_frame(at, F.lit("IDAT"), frame(F.lit(b"IDAT"), data)), _frame(at + 1, F.lit("IEND"), frame(F.lit(b"IEND"), F.lit(b""))))
    head = F.array(_frame(F.lit(0), F.lit("IHDR"), header))
    return told.select("image_id", F.concat(head, sides, rest).alias("parts") if side else F.concat(head, rest).alias("parts"))


def _totals(chunks: DataFrame, streaming: bool) -> DataFrame:
    more = [F.sum(F.col("end_row") - F.col("start_row")).alias("n_rows")]
    if not streaming:
        more.append(F.expr("listagg(deflated, X'') WITHIN GROUP (ORDER BY chunk_id)").alias("joined"))
    return combined_adler(chunks, *more)


def frames(header: RasterSpec | DataFrame, chunks: DataFrame, streaming: bool, side: DataFrame | None = None) -> DataFrame:
    """image_id, ordinal, tag, frame. header: what all images share, or image_id, width, height, depth, color_type of each. side: image_id,
    position, tag, data.

    Buffered: one data frame for the image, the checksum at its end if there were several chunks (a lone chunk ends with its own). Chunks
    are read once, by one aggregation.
    Streaming: one for each chunk, then one with the checksum, empty after a lone chunk. Chunks are read for their numbers and for their
    bytes, so they should be a written table; a chunk's frame is made where the chunk is, and its place follows from its number.
    """
    around = _around(headed(header, _totals(chunks, streaming), side), streaming, side is not None).select("image_id", F.explode("parts").alias("p")).select("image_id", "p.*")
    if not streaming:
        return around
    if side is None:
        placed = chunks.withColumn("n_side", F.lit(0))
    else:
        placed = chunks.join(side.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_side")), "image_id", "left").withColumn("n_side", F.coalesce("n_side", F.lit(0)))
    each = placed.select("image_id", (F.col("n_side") + 1 + F.col("chunk_id")).cast("long").alias("ordinal"), F.lit("IDAT").alias("tag"), frame(F.lit(b"IDAT"), F.col("deflated")).alias("frame"))
    return around.unionByName(each)


def files(framed: DataFrame) -> DataFrame:
    """image_id, png: the frames on end. An image is one value here, of 2 GiB at most; larger ones are written frame by frame."""
    return framed.groupBy("image_id").agg(F.expr("listagg(frame, X'') WITHIN GROUP (ORDER BY ordinal)").alias("png"))


def buffered_files(header: RasterSpec | DataFrame, chunks: DataFrame, side: DataFrame | None = None) -> DataFrame:
    """image_id, png in the buffered layout: one aggregation makes the file, so its bytes are moved once."""
    parts = _around(headed(header, _totals(chunks, False), side), False, side is not None)
    return parts.select("image_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["frame"])).alias("png"))
