import pytest
from pyspark.sql import functions as F

from rasterloom.functions import spec as S
from rasterloom.functions.spec import ColorType, EncodeOptions, Filter, InvalidInput, Level, RasterSpec, Strategy

LEGAL = [(c, d) for c in ColorType for d in S.DEPTHS[c]]


def test_fifteen_legal_pairs():
    assert len(LEGAL) == 15
    for c in ColorType:
        for d in (1, 2, 4, 8, 16):
            if (c, d) in LEGAL:
                RasterSpec(3, 3, c, d)
            else:
                with pytest.raises(InvalidInput):
                    RasterSpec(3, 3, c, d)


@pytest.mark.parametrize("bad", [dict(width=0), dict(height=0), dict(width=1 << 32), dict(color_type=5), dict(depth=3), dict(interlace=1), dict(compression=1), dict(filter_method=1)])
def test_refused_headers(bad):
    with pytest.raises(InvalidInput):
        RasterSpec(**{"width": 1, "height": 1, **bad})


def test_known_plans():
    assert (RasterSpec(1920, 1080).stride, RasterSpec(1920, 1080).rows_per_chunk(262144), RasterSpec(1920, 1080).chunks(262144)) == (5760, 46, 24)
    assert (RasterSpec(1024, 768).rows_per_chunk(200000), RasterSpec(1024, 768).chunks(200000)) == (66, 12)
    assert (RasterSpec(263168, 256).rows_per_chunk(262144), RasterSpec(263168, 256).chunks(262144)) == (1, 256)


@pytest.mark.parametrize("width,depth,stride", [(4, 1, 1), (12, 1, 2), (3, 4, 2), (2, 2, 1), (1, 1, 1), (8, 1, 1), (9, 1, 2)])
def test_strides_round_up_to_whole_bytes(width, depth, stride):
    """Also where four bits are left over, for which some encoders take a byte too few."""
    assert RasterSpec(width, 1, ColorType.GREYSCALE, depth).stride == stride


def test_columns_agree_with_classes(spark):
    cases = [(int(c), d, w) for c, d in LEGAL for w in (1, 2, 3, 5, 8, 64)]
    rows = spark.createDataFrame(cases, "c int, d int, w int")
    got = rows.select("c", "d", "w", S.channels(F.col("c")), S.bpp(F.col("c"), F.col("d")), S.stride(F.col("c"), F.col("d"), F.col("w")), S.rows_per_chunk(F.lit(40000), S.stride(F.col("c"), F.col("d"), F.col("w")))).collect()
    for c, d, w, channels, bpp, stride, rpc in got:
        spec = RasterSpec(w, 9, c, d)
        assert (channels, bpp, stride, rpc) == (spec.channels, spec.bpp, spec.stride, spec.rows_per_chunk(40000))


def test_options():
    for bad in (dict(chunk_size=32767), dict(level=5), dict(strategy=7), dict(filter=9)):
        with pytest.raises(InvalidInput):
            EncodeOptions(**bad)
    assert EncodeOptions(filter=-1).filter is None and EncodeOptions().zlib_level == -1 and EncodeOptions(level=9).level == Level.HIGH
    palette = RasterSpec(4, 4, ColorType.INDEXED, 4)
    assert EncodeOptions().filter_for(palette) == Filter.NONE and EncodeOptions().strategy_for(palette) == Strategy.DEFAULT
    assert EncodeOptions().filter_for(RasterSpec(4, 4, ColorType.GREYSCALE, 1)) is None
    assert EncodeOptions().strategy_for(RasterSpec(4, 4)) == Strategy.FILTERED
    assert EncodeOptions(filter=0).strategy_for(RasterSpec(4, 4)) == Strategy.DEFAULT and EncodeOptions(strategy=3).strategy_for(palette) == Strategy.RLE
