import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.spec import Filter
from rasterloom.operators import filters as R
from rasterloom.operators.vectors import filter_chunk, unfilter


def model(kind, src, prev, bpp):
    """Byte by byte, as the format words it."""
    out = []
    for i, v in enumerate(src):
        a, b, c = (src[i - bpp] if i >= bpp else 0), prev[i], (prev[i - bpp] if i >= bpp else 0)
        p = a + b - c
        near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
    return out


def best(src, prev, bpp):
    done = {k: model(k, src, prev, bpp) for k in range(1, 5)}
    cost = {k: sum(min(v, 256 - v) for v in d) for k, d in done.items()}
    k = min(cost, key=lambda k: (cost[k], k))
    return k, cost[k], done[k]


def image(width, height, seed, spread=256):
    r = random.Random(seed)
    rows = [[r.randrange(spread) if r.random() < 0.7 else 128 for _ in range(width)] for _ in range(height)]
    rows[0] = [0] * width
    return rows


@pytest.mark.parametrize("bpp", [1, 2, 3, 4, 6, 8])
def test_arrays_and_vectors_follow_the_model(spark, bpp):
    rows = image(24, 12, bpp)
    table = spark.createDataFrame([(0, y, r) for y, r in enumerate(rows)], "image_id long, y long, src array<int>")
    above = R.with_previous(table, 5)
    prev = [[0] * 24, *rows[:-1]]
    got = {r["y"]: r for r in above.select("y", *(R.filtered(k, bpp).alias(k.name) for k in Filter)).collect()}
    for y in range(12):
        for k in Filter:
            assert got[y][k.name] == model(k, rows[y], prev[y], bpp)
    chosen = {r["y"]: r for r in R.adaptive(above, bpp).collect()}
    matrix, over = np.array(rows, np.uint8), np.array(prev, np.uint8)
    vector = filter_chunk(matrix, over, bpp, None)
    for y in range(12):
        k, cost, data = best(rows[y], prev[y], bpp)
        assert (chosen[y]["filter_type"], chosen[y]["complexity"], chosen[y]["data"]) == (k, cost, [k, *data])
        assert vector[y].tolist() == [k, *data]
    for k in Filter:
        assert filter_chunk(matrix, over, bpp, k)[:, 1:].tolist() == [model(k, rows[y], prev[y], bpp) for y in range(12)]
        assert unfilter(filter_chunk(matrix, over, bpp, k), bpp).tolist() == rows
    assert unfilter(vector, bpp).tolist() == rows


def test_ties_go_to_the_earlier_filter(spark):
    zero = spark.createDataFrame([(0, 0, [0] * 6), (0, 1, [0] * 6)], "image_id long, y long, src array<int>")
    assert {r["filter_type"] for r in R.adaptive(R.with_previous(zero, 10), 3).collect()} == {1}


def test_average_of_large_neighbours():
    assert model(3, [255, 255], [255, 255], 1) == [(255 - 127) % 256, 0]
    assert filter_chunk(np.array([[255, 255]], np.uint8), np.array([[255, 255]], np.uint8), 1, Filter.AVERAGE)[0].tolist() == [3, 128, 0]


def test_cost_of_128_is_128(spark):
    one = spark.createDataFrame([([128, 1, 255],)], "v array<int>").select(R.complexity(F.col("v"))).first()[0]
    assert one == 130


def test_one_row_rasters_and_single_bytes(spark):
    one = spark.createDataFrame([(7, 0, [9])], "image_id long, y long, src array<int>")
    assert R.adaptive(R.with_previous(one, 1), 1).select("data").first()[0] == [1, 9]


def test_empty_table(spark):
    none = spark.createDataFrame([], "image_id long, y long, src array<int>")
    assert R.adaptive(R.with_previous(none, 3), 1).collect() == []
