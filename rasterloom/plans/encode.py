"""From rows to PNG: the plan as one call, and as a session that is fed step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import ColorType, EncodeOptions, IncompleteImage, InvalidInput, RasterSpec
from ..operators.deflate import deflate_chunks
from ..operators.framing import MOST_DATA, buffered_files, files, frames, side_of
from ..session import cut
from ..sources.rasters import from_buffer


def check_rows(rows: DataFrame, spec: RasterSpec) -> DataFrame:
    """image_id, n_rows and complete: whether y runs from 0 to height - 1 without gaps or repeats and every row has its length."""
    told = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("y").alias("n_y"), F.min("y").alias("low"), F.max("y").alias("high"), F.min(F.octet_length("row") == spec.stride).alias("sized"))
    return told.select("image_id", "n_rows", ((F.col("n_rows") == spec.height) & (F.col("n_y") == spec.height) & (F.col("low") == 0) & (F.col("high") == spec.height - 1) & F.col("sized")).alias("complete"))


def _plan(rows: DataFrame, header: RasterSpec | DataFrame, options: EncodeOptions, side: DataFrame | None) -> tuple[RasterSpec | DataFrame, DataFrame, DataFrame | None]:
    """Headers, chunks and side data. A table of images may hold palettes and transparencies, which come before what side holds."""
    if isinstance(header, RasterSpec):
        return header, deflate_chunks(rows, header, options), side
    own = side_of(header) if {"palette", "transparency"} & set(header.columns) else None
    if own is not None and side is not None:
        side = side.select("image_id", (F.col("position") + 2).alias("position"), "tag", "data")
    both = own if side is None else side if own is None else own.unionByName(side)
    return header, deflate_chunks(rows, header, options), both


def encode_frames(rows: DataFrame, header: RasterSpec | DataFrame, options: EncodeOptions | None = None, side: DataFrame | None = None) -> DataFrame:
    """image_id, ordinal, tag, frame of (image_id, y, row BINARY).

    header: what all images share, or a table with a row for each image (image_id, width, height, depth, color_type and, if there are
    such, palette and transparency). side: image_id, position, tag, data of frames before the image data. Headers, side data and rows
    that a decoder couldn't read are an error. In streaming layout the chunks are written to the shared folder first: they are
    compressed once and read for their checksums and for their bytes.
    """
    options = options or EncodeOptions()
    images, chunks, side = _plan(rows, header, options, side)
    return frames(images, cut(chunks, "chunks") if options.streaming else chunks, options.streaming, side)


def encode(rows: DataFrame, header: RasterSpec | DataFrame, options: EncodeOptions | None = None, side: DataFrame | None = None) -> DataFrame:
    """image_id, png; see encode_frames()."""
    options = options or EncodeOptions()
    if options.streaming:
        return files(encode_frames(rows, header, options, side))
    return buffered_files(*_plan(rows, header, options, side))


def progress(chunks: DataFrame, spec: RasterSpec, options: EncodeOptions) -> DataFrame:
    """image_id, chunks_output, chunks_total, fraction of chunks that came out of deflate_chunks()."""
    total = spec.chunks(options.chunk_size)
    return chunks.groupBy("image_id").agg(F.count(F.lit(1)).alias("chunks_output")).select("image_id", "chunks_output", F.lit(total).cast("long").alias("chunks_total"), (F.col("chunks_output") / total).alias("fraction"))


class EncodeSession:
    """One image, fed step by step; steps out of order are refused. Rows are compressed at flush() and finish(), each chunk once: what is
    done is a written table."""

    def __init__(self, spark: SparkSession, options: EncodeOptions | None = None, image_id: int = 0):
        self.spark, self.options, self.image_id = spark, options or EncodeOptions(), image_id
        self.spec: RasterSpec | None = None
        self.palette: bytes | None = None
        self.transparency: bytes | None = None
        self._side: list[tuple[str, bytes]] = []
        self._rows: list[tuple[int, int, DataFrame]] = []  # first row and the one after the last
        self._fed = 0
        self._chunks: list[DataFrame] = []
        self._done = 0  # chunks in them

    def _need_header(self) -> RasterSpec:
        if self.spec is None:
            raise InvalidInput("the header comes first")
        return self.spec

    def write_header(self, spec: RasterSpec) -> None:
        if self.spec is not None:
            raise InvalidInput("an image has one header")
        self.spec = spec

    def write_palette(self, data: bytes) -> None:
        self._need_header()
        if self.palette is not None or self.transparency is not None or self._fed:
            raise InvalidInput("one palette, before transparency and rows")
        if len(data) < 3 or len(data) % 3:
            raise InvalidInput("a palette holds whole entries of three bytes")
        self.palette = data
        self._side.append(("PLTE", data))

    def write_transparency(self, data: bytes) -> None:
        spec = self._need_header()
        if self._fed:
            raise InvalidInput("transparency comes before rows")
        if spec.color_type in (ColorType.GREYSCALE_ALPHA, ColorType.TRUECOLOR_ALPHA):
            raise InvalidInput("a color type with alpha has no transparency of its own")
        if spec.color_type == ColorType.INDEXED:
            if self.palette is None or not data or len(data) > len(self.palette) // 3:
                raise InvalidInput("transparency has an entry for palette entries only")
        elif len(data) != (2 if spec.color_type == ColorType.GREYSCALE else 6):
            raise InvalidInput("transparency is one sample for each channel, of two bytes")
        self.transparency = data
        self._side.append(("tRNS", data))

    def write_chunk(self, tag: bytes, data: bytes) -> None:
        if len(tag) != 4:
            raise InvalidInput("a tag has four bytes")
        if len(data) > MOST_DATA:
            raise InvalidInput("data is too long for a frame")
        self._side.append((tag.decode("latin-1"), data))

    def write_image_rows(self, data: bytes | DataFrame) -> None:
        """Bytes of whole rows, which follow those before, or a table (y, row) of the rows that come next; a table is counted at once."""
        spec = self._need_header()
        if spec.color_type == ColorType.INDEXED and self.palette is None:
            raise InvalidInput("indexed rows need a palette first")
        if isinstance(data, DataFrame):
            count = data.count()
            rows = data.select(F.lit(self.image_id).cast("long").alias("image_id"), F.col("y").cast("long").alias("y"), "row")
        else:
            if len(data) % spec.stride:
                raise InvalidInput("a buffer holds whole rows only")
            count = len(data) // spec.stride
            if not count:
                return
            rows = from_buffer(self.spark.createDataFrame([(self.image_id, self._fed, bytearray(data))], "image_id long, first_y long, data binary"), spec.stride)
        if self._fed + count > spec.height:
            raise IncompleteImage("more rows than the image is high")
        self._rows.append((self._fed, self._fed + count, rows))
        self._fed += count

    def _compress(self, upto: int) -> DataFrame:
        """All chunks of the rows before upto; those that aren't there yet are made from the rows fed for them and their halo."""
        spec, rpc = self._need_header(), self.spec.rows_per_chunk(self.options.chunk_size)
        if upto > self._done * rpc:
            least = max(0, self._done * rpc - spec.halo())
            some = [rows.where((F.col("y") >= least) & (F.col("y") < upto)) for a, b, rows in self._rows if b > least and a < upto]
            rows = some[0]
            for more in some[1:]:
                rows = rows.unionByName(more)
            # halo goes forward only, so complete chunks need no row of those that follow
            self._chunks.append(cut(deflate_chunks(rows, spec, self.options, self._done, upto), "chunks"))
            self._done = -(-upto // rpc)
        out = self._chunks[0]
        for more in self._chunks[1:]:
            out = out.unionByName(more)
        return out

    def progress(self) -> float:
        """Share of the chunks whose rows have all been fed."""
        if self.spec is None:
            return 0.0
        rpc = self.spec.rows_per_chunk(self.options.chunk_size)
        done = self.spec.chunks(self.options.chunk_size) if self._fed == self.spec.height else self._fed // rpc
        return done / self.spec.chunks(self.options.chunk_size)

    def is_finished(self) -> bool:
        return self.spec is not None and self._fed == self.spec.height

    def flush(self) -> DataFrame:
        """The chunks that are complete so far; a chunk that lacks rows isn't forced. Those of earlier flushes aren't made again."""
        spec = self._need_header()
        rpc = spec.rows_per_chunk(self.options.chunk_size)
        whole = self._fed if self._fed == spec.height else self._fed // rpc * rpc
        if not whole:
            raise IncompleteImage("no chunk is complete yet")
        return self._compress(whole)

    def finish(self) -> DataFrame:
        """image_id, ordinal, tag, frame."""
        if not self.is_finished():
            raise IncompleteImage("rows are missing")
        side = self.spark.createDataFrame([(self.image_id, k, t, bytearray(d)) for k, (t, d) in enumerate(self._side)], "image_id long, position long, tag string, data binary")
        return frames(self.spec, self._compress(self.spec.height), self.options.streaming, side)
