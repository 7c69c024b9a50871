"""Compressing chunks side by side: each is primed with the filtered bytes before it, so their outputs on end are one stream."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spec as S
from ..functions.spec import WINDOW, EncodeOptions, RasterSpec
from ..session import ship_package
from .chunks import with_halo
from .vectors import filter_chunk

HEADER = ("width", "height", "depth", "color_type")
SCHEMA = "image_id long, chunk_id long, start_row long, end_row long, is_start boolean, is_end boolean, n_bytes long, deflated binary, adler long, dictionary binary"
_CHUNK = pa.schema([(n, pa.int64()) for n in ("image_id", "chunk_id", "start_row", "end_row")] + [(n, pa.bool_()) for n in ("is_start", "is_end")] + [("n_bytes", pa.int64()), ("deflated", pa.binary()), ("adler", pa.int64()), ("dictionary", pa.binary())])


def deflate(data: bytes, dictionary: bytes, is_start: bool, is_end: bool, level: int, strategy: int) -> bytes:
    """The first chunk opens the stream; a later one is raw, with the dictionary in place of what precedes it. All but the last end at
    a byte boundary without closing the stream."""
    how = (level, zlib.DEFLATED, 15 if is_start else -15, 8, strategy)
    job = zlib.compressobj(*how) if is_start or not dictionary else zlib.compressobj(*how, dictionary)
    return job.compress(data) + job.flush(zlib.Z_FINISH if is_end else zlib.Z_SYNC_FLUSH)


def _matrix(column: pa.ChunkedArray, stride: int, image_id: int) -> np.ndarray:
    """The rows' bytes as they lie in the Arrow buffer."""
    parts = []
    for c in column.chunks:
        ends = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset)
        if c.null_count or (np.diff(ends) != stride).any():
            raise ValueError(f"image {image_id}: a row isn't {stride} bytes long")
        parts.append(np.frombuffer(c.buffers()[2], np.uint8, len(c) * stride, int(ends[0])).reshape(-1, stride))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode_group(spec: RasterSpec | None, options: EncodeOptions, keep_dictionary: bool, key: tuple, table: pa.Table) -> pa.Table:
    """One chunk from its own rows and its halo. spec: None if the rows carry their image's."""
    image_id, chunk_id = (k.as_py() for k in key)
    spec = spec or RasterSpec(**{n: table[n][0].as_py() for n in HEADER})
    y = table["y"].to_numpy()
    order = np.argsort(y, kind="stable")
    rows = _matrix(table["row"], spec.stride, image_id)[order]
    rpc = spec.rows_per_chunk(options.chunk_size)
    start, end = chunk_id * rpc, min((chunk_id + 1) * rpc, spec.height)
    first = max(0, start - spec.halo())
    if not np.array_equal(y[order], np.arange(first, end)):
        raise ValueError(f"image {image_id}: chunk {chunk_id} lacks rows or has some twice")
    above = np.concatenate((np.zeros((1, spec.stride), np.uint8), rows[:-1]))
    done = filter_chunk(rows, above, spec.bpp, options.filter_for(spec))
    # the first halo row only serves as a predecessor, unless it is the image's first
    before = done[0 if first == 0 else 1 : start - first].tobytes()[-WINDOW:]
    data = done[start - first :].tobytes()
    packed = deflate(data, before, start == 0, end == spec.height, options.zlib_level, int(options.strategy_for(spec)))
    values = (image_id, chunk_id, start, end, start == 0, end == spec.height, len(data), packed, zlib.adler32(data), before if keep_dictionary else None)
    return pa.table([[v] for v in values], schema=_CHUNK)


def deflate_chunks(rows: DataFrame, header: RasterSpec | DataFrame, options: EncodeOptions, first: int = 0, upto: int | None = None, keep_dictionary: bool = False) -> DataFrame:
    """A row for each chunk, from (image_id, y, row BINARY). One shuffle, by chunk: a group holds one chunk and its halo, however large its
    image. header: what all images share, or a table (image_id, width, height, depth, color_type) with a row for each; an image without
    one is an error.

    first: chunks before it aren't wanted. upto: rows from there on aren't there yet, so neither are their chunks. keep_dictionary: with
    what primed each chunk, for inflate_chunks().
    """
    ship_package(rows.sparkSession)
    if isinstance(header, RasterSpec):
        lit = lambda n: F.lit(n).cast("long")
        rpc = lit(header.rows_per_chunk(options.chunk_size))
        sent = with_halo(rows.select("image_id", "y", "row"), rpc, lit(header.halo()), lit(header.chunks(options.chunk_size)))
        if first or upto is not None:
            sent = sent.where((F.col("chunk_id") >= first) & (F.col("chunk_id") * rpc < (header.height if upto is None else upto)))
        task = partial(encode_group, header, options, keep_dictionary)
    else:
        told = rows.select("image_id", "y", "row").join(header.select("image_id", *HEADER), "image_id", "left")
        stride = S.stride(F.col("color_type"), F.col("depth"), F.col("width"))
        problem = F.coalesce(F.when(F.col("width").isNull(), "rows without a header"), S.header_problem(*map(F.col, HEADER)))
        told = told.withColumn("stride", F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(stride))
        rpc = S.rows_per_chunk(F.lit(options.chunk_size), F.col("stride"))
        sent = with_halo(told, rpc, S.halo(F.col("stride")), S.chunks_total(F.col("height"), rpc)).drop("stride")
        task = partial(encode_group, None, options, keep_dictionary)
    return sent.drop("own").groupBy("image_id", "chunk_id").applyInArrow(_typed(task), SCHEMA)


def _typed(task):
    def group(key: tuple, table: pa.Table) -> pa.Table:
        return task(key, table)

    return group


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            job = zlib.decompressobj(15) if row["is_start"] else zlib.decompressobj(-15, zdict=row["dictionary"])
            data = job.decompress(row["deflated"])
            if len(data) != row["n_bytes"]:
                raise ValueError(f"image {row['image_id']}: {len(data)} bytes came out of chunk {row['chunk_id']}, which had {row['n_bytes']}")
            out.append({"image_id": row["image_id"], "chunk_id": row["chunk_id"], "inflated_len": len(data), "inflated_adler": zlib.adler32(data)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, pa.int64()) for n in ("image_id", "chunk_id", "inflated_len", "inflated_adler")]))


def inflate_chunks(chunks: DataFrame) -> DataFrame:
    """image_id, chunk_id, inflated_len, inflated_adler of chunks with their dictionaries: each by itself, however many its image has."""
    ship_package(chunks.sparkSession)
    return chunks.select("image_id", "chunk_id", "is_start", "n_bytes", "deflated", "dictionary").mapInArrow(_inflated, "image_id long, chunk_id long, inflated_len long, inflated_adler long")


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from ..sources.png import decode

    for frame in batches:
        for image_id, png in zip(frame["image_id"], frame["png"], strict=True):
            rows = decode(bytes(png))[3]
            yield pd.DataFrame({"image_id": image_id, "y": np.arange(len(rows)), "row": [r.tobytes() for r in rows]})


def decode_files(files: DataFrame) -> DataFrame:
    """image_id, y, row of (image_id, png)."""
    ship_package(files.sparkSession)
    return files.select("image_id", "png").mapInPandas(_decoded, "image_id long, y long, row binary")
