"""Queries over what users touch: sources, sinks, sessions, headers of many images, and what is refused; with SQL for the same results."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import spec as S
from ..operators.deflate import decode_files
from ..operators.filters import BIG_ROW, MOST_COST, limited
from ..session import scratch
from ..sources.png import PngDataSource, decode
from ..sources.rasters import from_buffer, quantised, synthetic
from .catalog import _CRC_OF, _CRC_TABLE, SMALL, _px, binary, grey, long, raster, table, values
from .encode import EncodeSession, check_rows, encode, encode_frames

BUFFER = 7
TILE = 50
FORMATS = tuple((k, int(c), d) for k, (c, d) in enumerate((c, d) for c in S.ColorType for d in S.DEPTHS[c]))
#: Widths that fill 64 bytes but for one sample, so that strides round up where samples are less than a byte.
WIDTHS = {k: 64 * 8 // (S.CHANNELS[c] * d) - 1 for k, c, d in FORMATS}
STRIDES = {k: S.RasterSpec(WIDTHS[k], 1, c, d).stride for k, c, d in FORMATS}
PALETTE = bytes(v for i in range(256) for v in (i, 255 - i, i // 2))
SIDE = (("PLTE", PALETTE), ("tRNS", bytes(range(40))), ("teXt", b"Title\0rows"))


def _adlers(rows: DataFrame, *keys: str) -> DataFrame:
    return long(rows.select(*keys, B.adler32("row").alias("row_adler")), *keys, "row_adler")


def push_source(spark, sf_dir):
    """Rows pushed as buffers of several on end."""
    some = binary(raster(spark, sf_dir)).groupBy("image_id", F.floor(F.col("y") / BUFFER).alias("k")).agg(F.expr("listagg(row, X'') WITHIN GROUP (ORDER BY y)").alias("data"))
    return _adlers(from_buffer(some.select("image_id", (F.col("k") * BUFFER).alias("first_y"), "data"), 64), "y")


def synthetic_raster(spark, sf_dir):
    rows = synthetic(spark, 1024, 768).select("y", F.size("src").cast("long").alias("n"), B.to_bytes(F.col("src")).alias("row"))
    return _adlers(rows, "y", "n")


def synthetic_ramp(spark, sf_dir):
    return long(synthetic(spark, 1920, 1080, "ramp").select("y", F.posexplode("src").alias("x", "v")).where("y IN (0, 540, 1079)"), "y", "x", "v")


def _tiles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The raster as images of TILE rows, the last one lower, and their headers."""
    rows = binary(raster(spark, sf_dir)).select(F.floor(F.col("y") / TILE).alias("image_id"), F.pmod("y", F.lit(TILE)).cast("long").alias("y"), "row")
    return rows, rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("height")).select("image_id", F.lit(64).cast("long").alias("width"), "height", F.lit(8).alias("depth"), F.lit(0).alias("color_type"))


def png_source_sink(spark, sf_dir):
    """Images written as files and read again, with their headers."""
    spark.dataSource.register(PngDataSource)
    folder = scratch(spark, "files")
    encode(*_tiles(spark, sf_dir)).write.format("png_rows").mode("append").save(folder)
    got = spark.read.format("png_rows").load(folder)
    return _adlers(got.withColumn("image_id", F.regexp_extract("path", r"image-(\d+)\.png", 1).cast("long")), "image_id", "width", "height", "depth", "color_type", "y")


def callback_sink(spark, sf_dir):
    """Frames handed to a function, which here appends them to a file for each image."""
    from ..sources.callback import deliver

    folder = scratch(spark, "sunk")

    def open_sink(image_id: int):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(folder)
        store.create_dir(name, recursive=True)
        out = store.open_output_stream(f"{name}/{image_id}.png")
        return type("Sink", (), {"write": staticmethod(out.write), "flush": staticmethod(lambda: out.close() or True)})

    rows, images = _tiles(spark, sf_dir)
    deliver(encode_frames(rows, images, S.EncodeOptions(S.WINDOW, streaming=True)), open_sink)
    files = spark.read.format("binaryFile").load(f"{folder}/*.png").select(F.regexp_extract("path", r"(\d+)\.png", 1).cast("long").alias("image_id"), F.col("content").alias("png"))
    return _adlers(decode_files(files), "image_id", "y")


def command_line(spark, sf_dir):
    """A file encoded anew by the command."""
    from ..cli import main

    with tempfile.TemporaryDirectory(prefix="rasterloom-") as folder:
        source, target = os.path.join(folder, "in.png"), os.path.join(folder, "out.png")
        with open(source, "wb") as f:
            f.write(bytes(encode(binary(raster(spark, sf_dir)), grey(spark, sf_dir)).first()["png"]))
        if main(["--chunk-size", str(S.WINDOW), "--filter", "paeth", "--level", "9", "--strategy", "filtered", "--streaming", "yes", source, target]):
            raise RuntimeError("the command failed")
        with open(target, "rb") as f:
            rows = decode(f.read())[3]
    return _adlers(spark.createDataFrame([(y, bytearray(r.tobytes())) for y, r in enumerate(rows)], "y long, row binary"), "y")


def encode_formats(spark, sf_dir):
    """Images of all formats in one table, each with its own header, decoded again."""
    height = table(spark, sf_dir, "embeddings").count()
    header = [(k, WIDTHS[k], height, d, c, bytearray(PALETTE[: 3 << min(d, 8)]) if c == S.ColorType.INDEXED else None) for k, c, d in FORMATS]
    images = spark.createDataFrame(header, "image_id long, width long, height long, depth int, color_type int, palette binary")
    strides = F.create_map(*(F.lit(x).cast("long") for kv in STRIDES.items() for x in kv))
    rows = binary(raster(spark, sf_dir)).select(F.explode(F.expr(f"sequence(0L, {len(FORMATS) - 1}L)")).alias("image_id"), "y", "row").withColumn("row", F.substring("row", F.lit(1), strides[F.col("image_id")].cast("int")))
    return _adlers(decode_files(encode(rows, images, S.EncodeOptions(S.WINDOW))), "image_id", "y")


def side_frames(spark, sf_dir):
    """Palette, transparency and a frame of the user's own, on the wire."""
    spec = S.RasterSpec(64, table(spark, sf_dir, "embeddings").count(), S.ColorType.INDEXED, 8)
    side = spark.createDataFrame([(0, k, t, bytearray(d)) for k, (t, d) in enumerate(SIDE)], "image_id long, position long, tag string, data binary")
    framed = encode_frames(binary(raster(spark, sf_dir)), spec, S.EncodeOptions(S.WINDOW), side)
    return framed.where(F.col("ordinal").between(1, len(SIDE))).select("ordinal", "tag", F.lower(F.hex("frame")).alias("frame_hex"))


def stream_rows(spark, sf_dir):
    """What a stream of rows was encoded to, decoded."""
    from ..operators.framing import files
    from ..streaming.encode import encode_stream

    base = scratch(spark, "stream")
    vectors = spark.readStream.schema(table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embeddings.parque[t]")
    out = encode_stream(binary(quantised(vectors)), grey(spark, sf_dir), S.EncodeOptions(S.WINDOW, streaming=True), forget=True)
    out.writeStream.format("parquet").option("path", f"{base}/frames").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return _adlers(decode_files(files(spark.read.parquet(f"{base}/frames"))), "y")


def rows_complete(spark, sf_dir):
    """Which of four images is whole: as it is, without a row, with one twice, with a short one."""
    rows = binary(raster(spark, sf_dir)).select(F.explode(F.expr("sequence(0L, 3L)")).alias("image_id"), "y", "row")
    rows = rows.where("NOT (image_id = 1 AND y = 3)").withColumn("row", F.expr("if(image_id = 3 AND y = 5, substring(row, 1, 63), row)"))
    rows = rows.unionByName(rows.where("image_id = 2 AND y = 7"))
    return check_rows(rows, grey(spark, sf_dir))


def complexity_limit(spark, sf_dir):
    one = values(spark, "(0L, 0L), (100L, 12800L), (16777215L, 4294967295L), (16777216L, 4294967039L), (16777216L, 4294967040L), (20000000L, 99999999999L), (20000000L, 5L)", "size, total")
    return one.select("size", "total", limited(F.col("total"), F.col("size")).alias("cost"))


CODES = range(-1, 11)
KINDS = {"color_type": (S.ColorType, (0, 2, 3, 4, 6)), "filter": (S.Filter, (0, 1, 2, 3, 4)), "strategy": (S.Strategy, (0, 1, 2, 3, 4)), "level": (S.Level, (1, 6, 9))}


def code_parse(spark, sf_dir):
    def valid(kind, code: int) -> bool:
        try:
            return S.parse(kind, code) == code
        except S.InvalidInput:
            return False

    return spark.createDataFrame([(name, code, valid(kind, code)) for name, (kind, _) in KINDS.items() for code in CODES], "kind string, code long, valid boolean")


def option_defaults(spark, sf_dir):
    shown = lambda v: "adaptive" if v is None else str(v).lower() if isinstance(v, bool) else str(int(v))
    options, header = S.EncodeOptions(), S.RasterSpec(1, 1)
    rows = [(f.name, shown(getattr(options, f.name))) for f in fields(options)] + [(f.name, shown(getattr(header, f.name))) for f in fields(header) if f.name not in ("width", "height")]
    return spark.createDataFrame(rows, "option string, value string")


STEPS, HEIGHT = 5, 1200


def session_progress(spark, sf_dir):
    """An image fed in steps: progress, whether it is finished, and how many chunks a flush gives after each."""
    session, out = EncodeSession(spark, SMALL), []
    session.write_header(S.RasterSpec(64, HEIGHT, S.ColorType.GREYSCALE, 8))
    out.append((0, session.progress(), session.is_finished(), 0))
    for k in range(1, STEPS + 1):
        session.write_image_rows(bytes(i % 251 for i in range(64)) * (HEIGHT // STEPS))
        try:
            flushed = session.flush().count()
        except S.IncompleteImage:
            flushed = 0
        out.append((k * HEIGHT // STEPS, session.progress(), session.is_finished(), flushed))
    return spark.createDataFrame(out, "fed long, progress double, finished boolean, flushed long")


def _cases() -> dict[str, tuple[Callable[[SparkSession], object], str]]:
    """What is done, and what comes of it: ok, or which error."""

    def after(*steps, color: int = 2, depth: int = 8, width: int = 2, height: int = 2):
        def run(spark: SparkSession) -> None:
            s = EncodeSession(spark, SMALL)
            s.write_header(S.RasterSpec(width, height, color, depth))
            for step in steps:
                step(s)

        return run

    def before(step):
        return lambda spark: step(EncodeSession(spark, SMALL))

    rows = lambda n: lambda s: s.write_image_rows(bytes(n))
    palette = lambda n: lambda s: s.write_palette(bytes(n))
    trns = lambda n: lambda s: s.write_transparency(bytes(n))
    own = lambda tag: lambda s: s.write_chunk(tag, b"x")
    header = lambda s: s.write_header(S.RasterSpec(2, 2))
    finish = lambda s: s.finish()
    ok, bad, lacking = "ok", "InvalidInput", "IncompleteImage"
    return {
        "width 0": (lambda _: S.RasterSpec(0, 1), bad), "height 0": (lambda _: S.RasterSpec(1, 0), bad), "width 2**32": (lambda _: S.RasterSpec(1 << 32, 1), bad), "largest size": (lambda _: S.RasterSpec((1 << 32) - 1, (1 << 32) - 1), ok),
        "depth 4 of truecolor": (lambda _: S.RasterSpec(1, 1, 2, 4), bad), "depth 16 of indexed": (lambda _: S.RasterSpec(1, 1, 3, 16), bad), "depth 1 of greyscale": (lambda _: S.RasterSpec(1, 1, 0, 1), ok), "depth 3": (lambda _: S.RasterSpec(1, 1, 0, 3), bad),
        "color type 1": (lambda _: S.RasterSpec(1, 1, 1), bad), "color type 5": (lambda _: S.RasterSpec(1, 1, 5), bad), "interlaced": (lambda _: S.RasterSpec(1, 1, 2, 8, 0, 0, 1), bad), "compression method 1": (lambda _: S.RasterSpec(1, 1, 2, 8, 1), bad), "filter method 1": (lambda _: S.RasterSpec(1, 1, 2, 8, 0, 1), bad),
        "chunk size 32767": (lambda _: S.EncodeOptions(32767), bad), "chunk size 32768": (lambda _: S.EncodeOptions(32768), ok), "filter 5": (lambda _: S.EncodeOptions(filter=5), bad), "filter -1": (lambda _: S.EncodeOptions(filter=-1), ok), "strategy 5": (lambda _: S.EncodeOptions(strategy=5), bad), "level 2": (lambda _: S.EncodeOptions(level=2), bad),
        "header twice": (after(header), bad), "palette before header": (before(palette(3)), bad), "transparency before header": (before(trns(2)), bad), "rows before header": (before(rows(12)), bad), "flush before header": (before(lambda s: s.flush()), bad),
        "palette": (after(palette(3)), ok), "palette of 0": (after(palette(0)), bad), "palette of 2": (after(palette(2)), bad), "palette of 4": (after(palette(4)), bad), "palette twice": (after(palette(3), palette(3)), bad), "palette after transparency": (after(trns(6), palette(3)), bad), "palette after rows": (after(rows(6), palette(3)), bad),
        "transparency of greyscale": (after(trns(2), color=0), ok), "transparency of 6 of greyscale": (after(trns(6), color=0), bad), "transparency of truecolor": (after(trns(6)), ok), "transparency of 2 of truecolor": (after(trns(2)), bad), "transparency with alpha": (after(trns(2), color=4), bad), "transparency with color and alpha": (after(trns(6), color=6), bad),
        "transparency without palette": (after(trns(1), color=3), bad), "transparency of palette": (after(palette(6), trns(2), color=3), ok), "transparency of more than the palette": (after(palette(6), trns(3), color=3), bad), "empty transparency of palette": (after(palette(6), trns(0), color=3), bad), "transparency after rows": (after(rows(6), trns(6)), bad),
        "indexed rows before palette": (after(rows(2), color=3), bad), "indexed rows": (after(palette(6), rows(2), color=3), ok), "half a row": (after(rows(3)), bad), "a row and a half": (after(rows(9)), bad), "no rows": (after(rows(0)), ok), "all rows": (after(rows(12), finish), ok), "rows in two calls": (after(rows(6), rows(6), finish), ok),
        "too many rows": (after(rows(18)), lacking), "a row too many": (after(rows(12), rows(6)), lacking), "a row missing": (after(rows(6), finish), lacking), "finish without rows": (after(finish), lacking), "flush without a chunk": (after(rows(6), lambda s: s.flush()), lacking),
        "own frame": (after(own(b"teXt")), ok), "tag of three bytes": (after(own(b"teX")), bad), "tag of five bytes": (after(own(b"teXts")), bad), "own frame before header": (before(own(b"teXt")), ok),
    }


def validation_outcomes(spark, sf_dir):
    def outcome(run) -> str:
        try:
            run(spark)
        except (S.InvalidInput, S.IncompleteImage) as problem:
            return type(problem).__name__
        return "ok"

    return spark.createDataFrame([(name, outcome(run)) for name, (run, _) in _cases().items()], "step string, outcome string")


def side_validation(spark, sf_dir):
    """The same rules inside a plan, over a table of images' side data."""
    rows = [(k, c, [(i, t, bytearray(n)) for i, (t, n) in enumerate(side)]) for k, (c, side, _) in enumerate(SIDE_CASES)]
    one = spark.createDataFrame(rows, "id long, color_type int, side array<struct<position:long,tag:string,data:binary>>")
    return one.select("id", F.coalesce(S.side_problem(F.col("color_type"), F.col("side")), F.lit("ok")).alias("outcome"))


#: Color type, (tag, length) in order, outcome.
SIDE_CASES = (
    (2, (), "ok"), (2, (("PLTE", 3),), "ok"), (2, (("PLTE", 4),), "a palette holds whole entries of three bytes"), (2, (("PLTE", 0),), "a palette holds whole entries of three bytes"), (2, (("PLTE", 3), ("PLTE", 3)), "an image has one palette"),
    (2, (("tRNS", 6), ("PLTE", 3)), "a palette comes before transparency"), (3, (), "indexed rows need a palette"), (3, (("PLTE", 6), ("tRNS", 2)), "ok"), (3, (("PLTE", 6), ("tRNS", 3)), "transparency doesn't fit the color type or palette"), (3, (("PLTE", 6), ("tRNS", 0)), "transparency doesn't fit the color type or palette"),
    (0, (("tRNS", 2),), "ok"), (0, (("tRNS", 1),), "transparency doesn't fit the color type or palette"), (4, (("tRNS", 2),), "transparency doesn't fit the color type or palette"), (6, (("tRNS", 6),), "transparency doesn't fit the color type or palette"), (6, (("teXt", 0), ("a", 1)), "a tag has four bytes"),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (push_source, synthetic_raster, synthetic_ramp, png_source_sink, callback_sink, command_line, encode_formats, side_frames, stream_rows, rows_complete, complexity_limit, code_parse, option_defaults, session_progress, validation_outcomes, side_validation)
}

# --- the same results in SQL -------------------------------------------------------------------------------------------------


def _row_adlers(keys: str = "y", width: int = 64, source: str = "px", by: str = "y") -> str:
    return f"SELECT {keys}, ((n + w) % 65521 * 65536 + (1 + a) % 65521)::BIGINT AS row_adler FROM (SELECT {by}, count(*) AS n, sum(v) AS a, sum(({width} - x) * v) AS w FROM {source} GROUP BY {by})"


_TILED = f"(y // {TILE})::BIGINT AS image_id"
_FORMATS_SQL = ", ".join(f"({k}, {s})" for k, s in STRIDES.items())


def _texts(rows) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def _frame_sql() -> str:
    one = []
    for k, (tag, data) in enumerate(SIDE):
        body = tag.encode() + data
        one.append(f"SELECT {k + 1}::BIGINT AS ordinal, '{tag}' AS tag, {len(data)} AS n, '{body.hex()}' AS body, {list(body)}::BIGINT[] AS d")
    return f"WITH s AS ({' UNION ALL '.join(one)}), q AS (SELECT *, {_CRC_TABLE} AS tbl FROM s) SELECT ordinal, tag, printf('%08x', n) || body || printf('%08x', {_CRC_OF.format(d='d')}::BIGINT) AS frame_hex FROM q"


_H = "(SELECT count(*) FROM embeddings)"
_PER = -(-S.WINDOW // 65)
_TOTAL = -(-HEIGHT // _PER)

ORACLES: dict[str, str] = {
    "push_source": f"WITH {_px()} {_row_adlers()}",
    "synthetic_raster": f"""WITH px AS (SELECT y, k AS x, (CASE k % 3 WHEN 0 THEN k // 3 + y WHEN 1 THEN 2 * (k // 3) + y ELSE k // 3 + 2 * y END % 256)::BIGINT AS v FROM range(768) a(y), range(3072) b(k))
      {_row_adlers("y::BIGINT AS y, n::BIGINT AS n", 3072)}""",
    "synthetic_ramp": "SELECT y::BIGINT AS y, k::BIGINT AS x, (k % 255)::BIGINT AS v FROM (VALUES (0), (540), (1079)) a(y), range(5760) b(k)",
    "png_source_sink": f"""WITH {_px()} {_row_adlers(f"{_TILED}, 64::BIGINT AS width, least({TILE}, {_H} - y // {TILE} * {TILE})::BIGINT AS height, 8::BIGINT AS depth, 0::BIGINT AS color_type, (y % {TILE})::BIGINT AS y")}""",
    "callback_sink": f"""WITH {_px()} {_row_adlers(f"{_TILED}, (y % {TILE})::BIGINT AS y")}""",
    "command_line": f"WITH {_px()} {_row_adlers()}",
    "encode_formats": f"WITH {_px()}, f AS (SELECT image_id::BIGINT AS image_id, stride, y, x, v FROM px, (VALUES {_FORMATS_SQL}) t(image_id, stride) WHERE x < stride) {_row_adlers('image_id, y', 'max(stride)', 'f', 'image_id, y').replace('sum((max(stride) - x) * v)', 'sum((stride - x) * v)')}",
    "side_frames": _frame_sql(),
    "stream_rows": f"WITH {_px()} {_row_adlers()}",
    "rows_complete": f"SELECT image_id::BIGINT AS image_id, ({_H} + extra)::BIGINT AS n_rows, complete FROM (VALUES (0, 0, true), (1, -1, false), (2, 1, false), (3, 0, false)) t(image_id, extra, complete)",
    "complexity_limit": f"""SELECT size, total, CASE WHEN size >= {BIG_ROW} THEN least(total, {MOST_COST}) ELSE total END::BIGINT AS cost
      FROM (VALUES (0::BIGINT, 0::BIGINT), (100, 12800), (16777215, 4294967295), (16777216, 4294967039), (16777216, 4294967040), (20000000, 99999999999), (20000000, 5)) t(size, total)""",
    "code_parse": " UNION ALL ".join(f"SELECT '{name}' AS kind, c::BIGINT AS code, c IN {good} AS valid FROM range(-1, 11) t(c)" for name, (_, good) in KINDS.items()),
    "option_defaults": "SELECT * FROM (VALUES ('chunk_size', '262144'), ('level', '6'), ('strategy', 'adaptive'), ('filter', 'adaptive'), ('streaming', 'false'), ('color_type', '2'), ('depth', '8'), ('compression', '0'), ('filter_method', '0'), ('interlace', '0')) t(option, value)",
    "session_progress": f"""SELECT fed::BIGINT AS fed, CASE WHEN fed = {HEIGHT} THEN 1.0 ELSE (fed // {_PER})::DOUBLE / {_TOTAL} END AS progress, fed = {HEIGHT} AS finished,
      CASE WHEN fed = {HEIGHT} THEN {_TOTAL} ELSE fed // {_PER} END::BIGINT AS flushed FROM (SELECT k * {HEIGHT // STEPS} AS fed FROM range({STEPS + 1}) t(k))""",
    "validation_outcomes": f"SELECT * FROM (VALUES {_texts((name, told) for name, (_, told) in _cases().items())}) t(step, outcome)",
    "side_validation": f"SELECT id::BIGINT AS id, outcome FROM (VALUES {_texts((k, told) for k, (_, _, told) in enumerate(SIDE_CASES))}) t(id, outcome)",
}
