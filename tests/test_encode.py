import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import bytes as B
from rasterloom.functions.spec import DEPTHS, ColorType, EncodeOptions, Filter, IncompleteImage, InvalidInput, RasterSpec
from rasterloom.operators.deflate import deflate_chunks, inflate_chunks
from rasterloom.plans.encode import EncodeSession, check_rows, encode, encode_frames, progress
from rasterloom.sources.png import PngDataSource, decode, split_frames
from rasterloom.sources.rasters import from_buffer, synthetic


SIDE = "image_id long, position long, tag string, data binary"


def rows_of(spec, seed=0):
    r = np.random.default_rng(seed)
    return [bytes((r.integers(0, 256, spec.stride) * (y % 3) // 2 % 256).astype(np.uint8)) for y in range(spec.height)]


def table(spark, images):
    data = [(k, y, bytearray(row)) for k, rows in images.items() for y, row in enumerate(rows)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "image_id long, y long, row binary")


def test_frames(spark):
    cases = [b"", b"01234567890123456789", bytes.fromhex("089963606060000000040001")]
    got = [bytes(r[0]) for r in spark.createDataFrame([(bytearray(c),) for c in cases], "d binary").select(B.frame(F.lit(b"IDAT"), F.col("d"))).collect()]
    assert [len(g) for g in got] == [12, 32, 24]
    assert got[2][:4].hex() == "0000000c" and got[2][-4:].hex() == "a30a15e3"


def test_checksums(spark):
    data = [b"", b"a", bytes(range(256)) * 20, b"\xff" * 70000]
    df = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)], "k int, d binary")
    assert [r[0] for r in df.orderBy("k").select(B.adler32("d")).collect()] == [zlib.adler32(d) for d in data]
    small = df.where("k < 3").orderBy("k").select(B.adler32_of_ints(B.to_ints(F.col("d"))), B.to_bytes(B.to_ints(F.col("d")))).collect()
    assert [(r[0], bytes(r[1])) for r in small] == [(zlib.adler32(d), d) for d in data[:3]]
    parts = [(2, 3, zlib.adler32(b"xyz")), (0, 70000, zlib.adler32(data[3])), (1, 0, 1)]
    one = spark.createDataFrame([(parts,)], "p array<struct<k:long,n:long,adler:long>>").select(B.adler32_combine(F.col("p"))).first()[0]
    assert one == zlib.adler32(data[3] + b"xyz")


@pytest.mark.parametrize("color,depth", [(c, d) for c in ColorType for d in DEPTHS[c]])
def test_every_format_decodes_to_its_rows(spark, color, depth):
    spec = RasterSpec(13, 7, color, depth)
    images = {k: rows_of(spec, k) for k in range(2)}
    side = spark.createDataFrame([(k, 0, "PLTE", bytearray(b"abcdef")) for k in images], SIDE) if color == ColorType.INDEXED else None
    for streaming in (False, True):
        for r in encode(table(spark, images), spec, EncodeOptions(streaming=streaming), side).collect():
            got, _, _, rows = decode(bytes(r["png"]))
            assert got == spec and [x.tobytes() for x in rows] == images[r["image_id"]]


@pytest.mark.parametrize("filter_", [None, *Filter])
def test_chunk_edges(spark, filter_):
    """Heights around a chunk's, one row, several chunks; both layouts."""
    rpc = RasterSpec(400, 1).rows_per_chunk(32768)
    for height in (1, rpc - 1, rpc, rpc + 1, 3 * rpc + 2):
        spec = RasterSpec(400, height)
        images = {5: rows_of(spec, height)}
        for streaming in (False, True):
            options = EncodeOptions(32768, filter=filter_, streaming=streaming)
            frames = encode_frames(table(spark, images), spec, options).orderBy("ordinal").collect()
            n = spec.chunks(32768)
            assert [f["tag"] for f in frames] == ["IHDR", *["IDAT"] * (n + 1 if streaming else 1), "IEND"]
            _, _, _, rows = decode(b"".join(bytes(f["frame"]) for f in frames))
            assert [x.tobytes() for x in rows] == images[5]
            if streaming and n == 1:
                assert len(frames[2]["frame"]) == 12


def test_rows_wider_than_a_chunk(spark):
    spec = RasterSpec(20000, 5)
    assert spec.rows_per_chunk(32768) == 1 and spec.halo() == 2
    images = {0: rows_of(spec)}
    _, _, _, rows = decode(bytes(encode(table(spark, images), spec, EncodeOptions(32768)).first()["png"]))
    assert [x.tobytes() for x in rows] == images[0]


@pytest.mark.parametrize("level", [1, 6, 9])
@pytest.mark.parametrize("strategy", [None, 0, 1, 2, 3, 4])
def test_levels_and_strategies(spark, level, strategy):
    spec = RasterSpec(300, 150)
    images = {0: rows_of(spec)}
    chunks = deflate_chunks(table(spark, images), spec, EncodeOptions(32768, level, strategy), keep_dictionary=True)
    told = chunks.join(inflate_chunks(chunks), ["image_id", "chunk_id"]).collect()
    assert len(told) == spec.chunks(32768) > 1
    assert all(r["n_bytes"] == r["inflated_len"] and r["adler"] == r["inflated_adler"] for r in told)


def test_missing_rows_are_an_error(spark):
    spec = RasterSpec(10, 4)
    rows = table(spark, {0: rows_of(spec), 1: rows_of(spec)}).where("NOT (image_id = 1 AND y = 2)")
    assert {r["image_id"]: r["complete"] for r in check_rows(rows, spec).collect()} == {0: True, 1: False}
    with pytest.raises(Exception, match="lacks rows"):
        encode(rows, spec).collect()


IMAGES = "image_id long, width long, height long, depth int, color_type int, palette binary, transparency binary"


def test_images_of_every_format_in_one_table(spark):
    specs = {k: RasterSpec(9 + 31 * k, 3 + 17 * k, c, d) for k, (c, d) in enumerate((c, d) for c in ColorType for d in DEPTHS[c])}
    images = {k: rows_of(s, k) for k, s in specs.items()}
    header = spark.createDataFrame([(k, s.width, s.height, s.depth, int(s.color_type), bytearray(b"abcdef") if s.color_type == ColorType.INDEXED else None, bytearray(b"ab") if s.color_type in (0, 3) else None) for k, s in specs.items()], IMAGES)
    for streaming in (False, True):
        got = encode(table(spark, images), header, EncodeOptions(32768, streaming=streaming)).collect()
        assert len(got) == len(specs) == 15
        for r in got:
            spec, palette, transparency, rows = decode(bytes(r["png"]))
            assert spec == specs[r["image_id"]] and [x.tobytes() for x in rows] == images[r["image_id"]]
            assert (palette is not None) == (spec.color_type == ColorType.INDEXED) and (transparency == b"ab") == (spec.color_type in (0, 3))


@pytest.mark.parametrize("side,problem", [
    ([("PLTE", b"abcd")], "whole entries"), ([("PLTE", b"")], "whole entries"), ([("PLTE", b"abc"), ("PLTE", b"abc")], "one palette"), ([("tRNS", b"abcdef"), ("PLTE", b"abc")], "before transparency"),
    ([("tRNS", b"abc")], "doesn't fit"), ([("abc", b"")], "four bytes"), ([("PLTE", b"abc"), ("tRNS", b"abcdef"), ("teXt", b"")], None),
])
@pytest.mark.parametrize("streaming", [False, True])
def test_side_data_of_tables_is_checked(spark, side, problem, streaming):
    spec = RasterSpec(2, 2)
    frame = spark.createDataFrame([(0, k, t, bytearray(d)) for k, (t, d) in enumerate(side)], SIDE)
    job = encode(table(spark, {0: rows_of(spec)}), spec, EncodeOptions(streaming=streaming), frame)
    if problem is None:
        assert [t for t, _ in split_frames(bytes(job.first()["png"]))][:4] == [b"IHDR", b"PLTE", b"tRNS", b"teXt"]
    else:
        with pytest.raises(Exception, match=problem):
            job.collect()


@pytest.mark.parametrize("images,problem", [
    ([(0, 2, 2, 8, 3, None, None)], "need a palette"), ([(0, 2, 2, 8, 3, b"abc", b"ab")], "doesn't fit"), ([(0, 1, 2, 8, 4, None, b"ab")], "doesn't fit"), ([(0, 0, 2, 8, 0, None, None)], "width and height"),
    ([(0, 2, 2, 4, 2, None, None)], "hasn't this depth"), ([(0, 2, 2, 8, 5, None, None)], "hasn't this depth"), ([(1, 2, 2, 8, 0, None, None)], "without a header"), ([(0, 2, 2, 8, 0, None, None)] * 2, "one header|twice"), ([(0, 2, 3, 8, 0, None, None)], "lacks rows"),
    ([(0, 2, 2, 8, 0, None, None), (1, 2, 2, 8, 0, None, None)], "lacks rows"), ([(0, 2, 1, 8, 0, None, None)], "lacks rows|twice"),
])
def test_headers_of_tables_are_checked(spark, images, problem):
    header = spark.createDataFrame([(*i[:5], *(None if x is None else bytearray(x) for x in i[5:])) for i in images], IMAGES)
    with pytest.raises(Exception, match=problem):
        encode(spark.createDataFrame([(0, y, bytearray(b"ab")) for y in range(2)], "image_id long, y long, row binary"), header).collect()


def test_a_flush_makes_no_chunk_again(spark, monkeypatch):
    from rasterloom.plans import encode as E

    spec, asked = RasterSpec(400, 150), []
    real = E.deflate_chunks
    monkeypatch.setattr(E, "deflate_chunks", lambda rows, *a: asked.append((rows.count(), a[2], a[3])) or real(rows, *a))
    s = EncodeSession(spark, EncodeOptions(32768))
    s.write_header(spec)
    rows, rpc = rows_of(spec), spec.rows_per_chunk(32768)
    for at in range(0, 150, 30):
        s.write_image_rows(b"".join(rows[at : at + 30]))
        assert sorted(r["chunk_id"] for r in s.flush().collect()) == list(range(-(-150 // rpc) if at == 120 else (at + 30) // rpc))
    png = b"".join(bytes(r["frame"]) for r in s.finish().orderBy("ordinal").collect())
    assert [x.tobytes() for x in decode(png)[3]] == rows
    assert [first for _, first, _ in asked] == sorted({first for _, first, _ in asked}) and sum(n for n, _, _ in asked) <= 150 + len(asked) * spec.halo()


def test_callback_sink(spark, tmp_path):
    from rasterloom.sources.callback import deliver

    spec = RasterSpec(200, 200)
    images = {k: rows_of(spec, k) for k in range(4)}
    folder = str(tmp_path)

    def open_sink(image_id):
        f = open(f"{folder}/{image_id}", "wb")
        return type("Sink", (), {"write": staticmethod(f.write), "flush": staticmethod(lambda: f.close() or True)})

    deliver(encode_frames(table(spark, images), spec, EncodeOptions(32768, streaming=True)), open_sink)
    assert {k: [x.tobytes() for x in decode((tmp_path / str(k)).read_bytes())[3]] for k in images} == images
    for sink, problem in ((("write", lambda data: len(data) - 1), "took"), (("flush", lambda: False), "flushed")):
        bad = lambda image_id, s=sink: type("Sink", (), {"write": staticmethod(len), "flush": staticmethod(lambda: True), s[0]: staticmethod(s[1])})
        with pytest.raises(Exception, match=problem):
            deliver(encode_frames(table(spark, {0: images[0]}), spec), bad)


def test_a_failed_or_repeated_write_leaves_the_folder_as_it_was(spark, tmp_path):
    spark.dataSource.register(PngDataSource)
    spec, folder = RasterSpec(4, 2), str(tmp_path / "out")
    png = encode(table(spark, {k: rows_of(spec, k) for k in range(3)}), spec)
    png.where("image_id < 2").write.format("png_rows").mode("append").save(folder)
    before = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    with pytest.raises(Exception, match="twice"):
        png.write.format("png_rows").mode("append").save(folder)
    failing = png.withColumn("png", F.expr("if(image_id = 2, raise_error('no'), png)"))
    with pytest.raises(Exception):
        failing.write.format("png_rows").mode("overwrite").save(folder)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == before
    png.where("image_id = 2").write.format("png_rows").mode("overwrite").save(folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", "image-0000000002.png"]


@pytest.mark.parametrize("bpp", [1, 2, 3, 4, 6, 8])
def test_unfiltering_by_diagonals(bpp, monkeypatch):
    from rasterloom.operators import vectors as V

    monkeypatch.setattr(V, "BAND", 7)
    r = np.random.default_rng(bpp)
    for height, pixels in ((1, 1), (5, 1), (1, 9), (23, 11)):
        rows = r.integers(0, 256, (height, pixels * bpp)).astype(np.uint8)
        above = np.concatenate((np.zeros_like(rows[:1]), rows[:-1]))
        kinds = r.integers(0, 5, height)
        each = {k: V.filter_chunk(rows, above, bpp, Filter(k)) for k in range(5)}
        assert (V.unfilter(np.stack([each[k][y] for y, k in enumerate(kinds)]), bpp) == rows).all()


def test_costs_have_a_limit(monkeypatch):
    from rasterloom.operators import vectors as V

    rows = np.full((2, 40), 128, np.uint8)
    assert V.costs(rows).tolist() == [5120, 5120]
    monkeypatch.setattr(V, "BIG_ROW", 40)
    monkeypatch.setattr(V, "MOST_COST", 3000)
    assert V.costs(rows).tolist() == [3000, 3000] and V.costs(rows[:, :39]).tolist() == [4992, 4992]


def test_progress_of_a_whole_image(spark):
    spec, options = RasterSpec(1920, 1080), EncodeOptions()
    rows = synthetic(spark, 1920, 1080, "ramp").select("image_id", "y", B.to_bytes(F.col("src")).alias("row"))
    got = progress(deflate_chunks(rows, spec, options), spec, options).first()
    assert (got["chunks_output"], got["chunks_total"], got["fraction"]) == (24, 24, 1.0)


def test_buffers(spark):
    data = bytes(range(12))
    df = spark.createDataFrame([(3, 10, bytearray(data)), (3, 20, bytearray())], "image_id long, first_y long, data binary")
    assert [(r["y"], bytes(r["row"])) for r in from_buffer(df, 4).orderBy("y").collect()] == [(10, data[:4]), (11, data[4:8]), (12, data[8:])]
    with pytest.raises(Exception, match="whole rows"):
        from_buffer(df, 5).collect()


def test_session_order(spark):
    s = EncodeSession(spark)
    for early in (lambda: s.write_palette(b"abc"), lambda: s.write_transparency(b"ab"), lambda: s.write_image_rows(b"abc")):
        with pytest.raises(InvalidInput):
            early()
    assert s.progress() == 0.0 and not s.is_finished()
    s.write_header(RasterSpec(4, 3, ColorType.INDEXED, 8))
    with pytest.raises(InvalidInput):
        s.write_header(RasterSpec(4, 3))
    for bad in (lambda: s.write_image_rows(b"abcd"), lambda: s.write_palette(b""), lambda: s.write_palette(b"abcd"), lambda: s.write_transparency(b"a"), lambda: s.write_chunk(b"abc", b"")):
        with pytest.raises(InvalidInput):
            bad()
    s.write_palette(b"abcdef")
    for bad in (lambda: s.write_palette(b"abc"), lambda: s.write_transparency(b""), lambda: s.write_transparency(b"abc")):
        with pytest.raises(InvalidInput):
            bad()
    s.write_transparency(b"ab")
    s.write_chunk(b"tEXt", b"k\0v")
    with pytest.raises(InvalidInput):
        s.write_image_rows(b"abc")
    s.write_image_rows(b"\0\1\0\1" * 2)
    with pytest.raises(InvalidInput):
        s.write_transparency(b"a")
    with pytest.raises(IncompleteImage):
        s.finish()
    with pytest.raises(IncompleteImage):
        s.write_image_rows(b"abcd" * 2)
    s.write_image_rows(b"\1\1\1\1")
    assert s.progress() == 1.0 and s.is_finished()
    png = b"".join(bytes(r["frame"]) for r in s.finish().orderBy("ordinal").collect())
    assert [t for t, _ in split_frames(png)] == [b"IHDR", b"PLTE", b"tRNS", b"tEXt", b"IDAT", b"IEND"]
    spec, palette, transparency, rows = decode(png)
    assert palette == b"abcdef" and transparency == b"ab" and rows.tobytes() == b"\0\1\0\1" * 2 + b"\1\1\1\1"


@pytest.mark.parametrize("color,good,bad", [(0, b"ab", b"a"), (2, b"abcdef", b"ab"), (4, None, b"ab"), (6, None, b"abcdef")])
def test_transparency_lengths(spark, color, good, bad):
    s = EncodeSession(spark)
    s.write_header(RasterSpec(1, 1, color, 8))
    with pytest.raises(InvalidInput):
        s.write_transparency(bad)
    if good:
        s.write_transparency(good)


def test_flush_gives_complete_chunks(spark):
    spec = RasterSpec(400, 100)
    rpc = spec.rows_per_chunk(32768)
    s = EncodeSession(spark, EncodeOptions(32768))
    s.write_header(spec)
    rows = rows_of(spec)
    s.write_image_rows(b"".join(rows[: rpc - 1]))
    with pytest.raises(IncompleteImage):
        s.flush()
    s.write_image_rows(b"".join(rows[rpc - 1 : rpc + 3]))
    assert [r["chunk_id"] for r in s.flush().collect()] == [0]
    assert s.progress() == 1 / spec.chunks(32768)


def test_png_source_and_sink(spark, tmp_path):
    spark.dataSource.register(PngDataSource)
    spec = RasterSpec(21, 9)
    images = {k: rows_of(spec, k) for k in range(3)}
    folder = str(tmp_path / "out")
    encode(table(spark, images), spec).coalesce(2).write.format("png_rows").mode("append").save(folder)
    got = spark.read.format("png_rows").load(folder).collect()
    assert len(got) == 27 and (tmp_path / "out" / "_SUCCESS").exists()
    for r in got:
        k = int(r["path"][-14:-4])
        assert (r["width"], r["height"], r["depth"], r["color_type"]) == (21, 9, 8, 2) and bytes(r["row"]) == images[k][r["y"]]
    assert spark.read.format("png_rows").load(folder + "/image-0000000001.png").count() == 9


def test_command_line(tmp_path):
    from rasterloom.cli import main
    from rasterloom.plans.encode import EncodeSession  # noqa: F401

    spec = RasterSpec(17, 5)
    import struct

    from rasterloom.operators.vectors import filter_chunk

    rows = np.frombuffer(b"".join(rows_of(spec)), np.uint8).reshape(5, -1)
    data = filter_chunk(rows, np.zeros_like(rows), 3, Filter.NONE).tobytes()
    f = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    source = tmp_path / "in.png"
    source.write_bytes(b"\x89PNG\r\n\x1a\n" + f(b"IHDR", struct.pack(">IIBBBBB", 17, 5, 8, 2, 0, 0, 0)) + f(b"IDAT", zlib.compress(data)) + f(b"IEND", b""))
    for extra in ([], ["--filter", "paeth", "--level", "9", "--streaming", "yes", "--chunk-size", "40000", "--strategy", "rle"]):
        assert main([*extra, str(source), str(tmp_path / "out.png")]) == 0
        assert decode((tmp_path / "out.png").read_bytes())[3].tolist() == rows.tolist()
    assert main([str(tmp_path / "absent.png"), str(tmp_path / "x.png")]) == 1
