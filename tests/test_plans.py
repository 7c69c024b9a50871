"""Plans stay inside the engine and read what they need."""

import pytest

from rasterloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["filter_paeth", "row_complexity", "adaptive_choice", "adaptive_rows", "byte_crc32", "frame_bytes", "dictionary_trailer", "chunk_ranges"])
def test_no_python(spark, name):
    text = plan(spark, name)
    assert not any(k in text for k in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "MapInArrow", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_scans_read_two_columns_of_three(spark):
    text = plan(spark, "adaptive_choice")
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text


def test_a_fixed_filter_evaluates_no_other(spark):
    from rasterloom.functions.spec import Filter
    from rasterloom.operators.filters import filter_rows

    rows = filter_rows(catalog.above(catalog.raster(spark, SF)), 1, Filter.UP)
    assert "zip_with" in (text := rows._jdf.queryExecution().optimizedPlan().toString()) and "shiftright" not in text


def test_bulk_encoding_shuffles_once(spark):
    from pyspark.sql import functions as F

    from rasterloom.functions.spec import EncodeOptions, RasterSpec
    from rasterloom.operators.deflate import deflate_chunks

    rows = spark.range(100).select(F.lit(0).cast("long").alias("image_id"), F.col("id").alias("y"), F.lit(b"abc" * 4).alias("row"))
    text = deflate_chunks(rows, RasterSpec(4, 100), EncodeOptions())._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


@pytest.mark.parametrize("name", ["frame_layout_streaming", "frame_layout_buffered", "encode_png"])
def test_chunks_are_compressed_once_and_framed_without_a_window(spark, name):
    """Streaming layout compresses in a job of its own, which writes the chunks; no plan does it twice, and none sorts an image's frames."""
    from rasterloom import session

    before = len(session._written)
    text = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    written = [p for _, p in session._written[before:] if "/chunks-" in p]
    assert text.count("FlatMapGroupsInArrow") + len(written) == 1 and "Window" not in text


def test_inflating_takes_no_groups(spark):
    text = plan(spark, "deflate_roundtrip")
    assert "FlatMapGroupsInPandas" not in text and "MapInArrow" in text
