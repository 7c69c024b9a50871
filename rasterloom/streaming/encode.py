"""Encoding while rows arrive: state for each image, a data frame as soon as a chunk is full."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.spec import SIGNATURE, WINDOW, EncodeOptions, RasterSpec
from ..operators.deflate import deflate
from ..operators.vectors import filter_chunk
from ..session import ship_package

OUTPUT = "image_id long, ordinal long, tag string, frame binary"
STATE = "next_chunk long, above binary, tail binary, adler long, n_chunks long, pending binary"


def framed(tag: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))


def combine(a: int, b: int, n: int) -> int:
    """Adler-32 of two byte strings on end; n is the length of the second."""
    low = ((a & 65535) + (b & 65535) - 1) % 65521
    high = ((a >> 16) + (b >> 16) + n % 65521 * ((a & 65535) - 1)) % 65521
    return high << 16 | low


def step(spec: RasterSpec, options: EncodeOptions, forget: bool, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows may come in any order within and across batches; a chunk goes out once all its rows and all earlier chunks are there. What
    waits is held as rows, so the state is bounded by how far rows run ahead. A row that comes twice counts once. Of a
    finished image a few numbers stay, or nothing with forget."""
    image_id = key[0]
    next_chunk, above, tail, adler, n_chunks, pending = state.get if state.exists else (0, bytes(spec.stride), b"", 1, 0, b"")
    record = np.dtype([("y", "<i8"), ("row", f"V{spec.stride}")])
    held = {int(r["y"]): r["row"].tobytes() for r in np.frombuffer(bytes(pending), record)}
    rpc, total = spec.rows_per_chunk(options.chunk_size), spec.chunks(options.chunk_size)
    for frame in batches:
        for y, row in zip(frame["y"], frame["row"], strict=True):
            if not 0 <= y < spec.height or len(row) != spec.stride:
                raise ValueError(f"image {image_id}: row {y} doesn't fit the header")
            if y >= next_chunk * rpc:
                held[int(y)] = bytes(row)
    out: list[tuple[int, str, bytes]] = []
    while next_chunk < total and all(y in held for y in range(next_chunk * rpc, min(spec.height, (next_chunk + 1) * rpc))):
        start, end = next_chunk * rpc, min(spec.height, (next_chunk + 1) * rpc)
        rows = np.frombuffer(b"".join(held.pop(y) for y in range(start, end)), np.uint8).reshape(-1, spec.stride)
        over = np.concatenate((np.frombuffer(bytes(above), np.uint8)[None], rows[:-1]))
        data = filter_chunk(rows, over, spec.bpp, options.filter_for(spec)).tobytes()
        last = next_chunk == total - 1
        if next_chunk == 0:
            head = struct.pack(">IIBBBBB", spec.width, spec.height, spec.depth, int(spec.color_type), 0, 0, 0)
            out.append((0, "IHDR", SIGNATURE + framed(b"IHDR", head)))
        packed = deflate(data, bytes(tail), next_chunk == 0, last, options.zlib_level, int(options.strategy_for(spec)))
        out.append((next_chunk + 1, "IDAT", framed(b"IDAT", packed)))
        adler, tail, above = combine(adler, zlib.adler32(data), len(data)), data[-WINDOW:], rows[-1].tobytes()
        next_chunk, n_chunks = next_chunk + 1, n_chunks + 1
        if last:
            out.append((total + 1, "IDAT", framed(b"IDAT", struct.pack(">I", adler) if total > 1 else b"")))
            out.append((total + 2, "IEND", framed(b"IEND", b"")))
    if next_chunk == total and out:
        tail = above = b""
    rest = np.array([(y, np.void(r)) for y, r in sorted(held.items())], record).tobytes() if held else b""
    if forget and next_chunk == total:
        if state.exists:
            state.remove()
    else:
        state.update((next_chunk, bytes(above), bytes(tail), adler, n_chunks, rest))
    yield pd.DataFrame([{"image_id": image_id, "ordinal": k, "tag": t, "frame": f} for k, t, f in out], columns=["image_id", "ordinal", "tag", "frame"])


def encode_stream(rows: DataFrame, spec: RasterSpec, options: EncodeOptions | None = None, forget: bool = False) -> DataFrame:
    """A stream of image_id, ordinal, tag, frame from a stream of (image_id, y, row BINARY). Frames of an image come out in order.

    forget: drop a finished image's state, for sources that send no row twice and many images: then state is bounded by the images under
    way, but a row that comes for a finished image starts it anew. (A timeout would keep runs until all data is read from ending.)"""
    ship_package(rows.sparkSession)
    return rows.select("image_id", "y", "row").groupBy("image_id").applyInPandasWithState(partial(step, spec, options or EncodeOptions(streaming=True), forget), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
