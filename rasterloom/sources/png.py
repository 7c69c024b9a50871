"""PNG files as a data source: reading gives rows, writing takes the files of encode().

    spark.dataSource.register(PngDataSource)
    spark.read.format("png_rows").load("/folder/*.png")      # path, header columns, y, row
    png.write.format("png_rows").mode("append").save("/folder")  # one file for each image_id
"""

from __future__ import annotations

import fnmatch
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.spec import SIGNATURE, InvalidInput, RasterSpec
from ..operators.vectors import unfilter

SCHEMA = "path string, width long, height long, depth int, color_type int, palette binary, transparency binary, y long, row binary"


def split_frames(data: bytes) -> list[tuple[bytes, bytes]]:
    """(tag, data) of every frame; lengths and CRCs are checked."""
    if data[:8] != SIGNATURE:
        raise InvalidInput("not a PNG file")
    out, at = [], 8
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        body = data[at + 4 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body):
            raise InvalidInput("a frame's CRC doesn't fit its data")
        out.append((body[:4], body[4:]))
        at += 12 + n
    return out


def decode(data: bytes) -> tuple[RasterSpec, bytes | None, bytes | None, np.ndarray]:
    """Spec, palette, transparency and rows; samples stay as they are packed."""
    parts = split_frames(data)
    if not parts or parts[0][0] != b"IHDR" or parts[-1][0] != b"IEND":
        raise InvalidInput("header or end is missing")
    w, h, depth, color, compression, filters, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    spec = RasterSpec(w, h, color, depth, compression, filters, interlace)
    raw = np.frombuffer(zlib.decompress(b"".join(d for t, d in parts if t == b"IDAT")), np.uint8)
    rows = unfilter(raw.reshape(h, spec.stride + 1), spec.bpp)
    side = {t: d for t, d in parts if t in (b"PLTE", b"tRNS")}
    return spec, side.get(b"PLTE"), side.get(b"tRNS"), rows


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, name = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        if store.get_file_info(name).type == fs.FileType.File:
            return [_File(self.path)]
        folder, pattern = (name, "*.png") if not any(c in name for c in "*?[") else name.rsplit("/", 1)
        prefix = self.path[: len(self.path) - len(name)] if "://" in self.path else ""
        found = store.get_file_info(fs.FileSelector(folder))
        return [_File(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]

    def read(self, partition: _File) -> Iterator[tuple]:
        store, name = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with store.open_input_file(name) as f:
            spec, palette, transparency, rows = decode(f.read())
        for y in range(spec.height):
            yield partition.path, spec.width, spec.height, spec.depth, int(spec.color_type), palette, transparency, y, rows[y].tobytes()


@dataclass
class _Wrote(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """Tasks write whole files into a folder of the job, which the commit moves to their places; a failed job leaves the target as it was.
    Names that are there already are an error in append mode; overwriting replaces all images of the target."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = f".job-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator) -> _Wrote:
        store, folder = self._store()
        own = f"{folder}/{self.job}/{uuid.uuid4().hex}"  # of this attempt: only a committed one is in the messages
        out = []
        for row in iterator:
            if not out:
                store.create_dir(own, recursive=True)
            name = f"image-{row['image_id']:010d}.png"
            with store.open_output_stream(f"{own}/{name}") as f:
                f.write(bytes(row["png"]))
            out.append(f"{own}/{name}")
        return _Wrote(out)

    def commit(self, messages) -> None:
        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        written = [p for m in messages if m for p in m.names]
        finals = [f"{folder}/{p.rpartition('/')[2]}" for p in written]
        there = {f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and f.base_name.startswith("image-")}
        if twice := {p for p in finals if finals.count(p) > 1} if len(set(finals)) < len(finals) else set() if self.overwrite else there & set(finals):
            self.abort(messages)
            raise InvalidInput(f"{sorted(twice)[0]} would be written twice")
        for own, final in zip(written, finals, strict=True):
            store.move(own, final)
        for path in there - set(finals) if self.overwrite else ():
            store.delete_file(path)
        self.abort(messages)
        with store.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        store, folder = self._store()
        if store.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.job}")


class PngDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)
