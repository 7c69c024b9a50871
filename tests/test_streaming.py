import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rasterloom.functions.spec import EncodeOptions, RasterSpec
from rasterloom.sources.png import decode
from rasterloom.streaming.encode import encode_stream


@pytest.mark.parametrize("height", [1, 28, 100])
def test_rows_in_any_order_over_many_batches(spark, tmp_path, height):
    spec = RasterSpec(400, height)
    r = np.random.default_rng(height)
    images = {k: [r.integers(0, 256, spec.stride).astype(np.uint8).tobytes() for _ in range(height)] for k in range(2)}
    data = [(k, y, row) for k, rows in images.items() for y, row in enumerate(rows)]
    random.Random(2).shuffle(data)
    data.append(data[0])  # a row that comes twice
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(0, len(data), 60):
        some = data[n : n + 60]
        pq.write_table(pa.table({"image_id": [a for a, _, _ in some], "y": [b for _, b, _ in some], "row": pa.array([c for _, _, c in some], pa.binary())}), folder / f"{n:04d}.parquet")
    rows = spark.readStream.schema("image_id long, y long, row binary").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = encode_stream(rows, spec, EncodeOptions(32768, streaming=True))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("image_id", "ordinal").collect()
    for k, want in images.items():
        frames = [x for x in got if x["image_id"] == k]
        assert [x["ordinal"] for x in frames] == list(range(spec.chunks(32768) + 3))
        assert [x.tobytes() for x in decode(b"".join(bytes(x["frame"]) for x in frames))[3]] == want


@pytest.mark.parametrize("forget", [False, True])
def test_state_of_finished_images(spark, tmp_path, forget):
    """A few numbers, or nothing; unless it is forgotten, rows that come again make no second image."""
    spec, folder = RasterSpec(4, 3), tmp_path / "in"
    folder.mkdir()
    rows = [(k, y, bytes([k, y] * 6)) for k in range(3) for y in range(3)]

    def run(name, some):
        pq.write_table(pa.table({"image_id": [a for a, _, _ in some], "y": [b for _, b, _ in some], "row": pa.array([c for _, _, c in some], pa.binary())}), folder / name)
        stream = encode_stream(spark.readStream.schema("image_id long, y long, row binary").parquet(str(folder)), spec, EncodeOptions(32768, streaming=True), forget)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    assert run("0.parquet", rows[:-1]) == (1 if forget else 3)
    assert run("1.parquet", rows[-1:]) == (0 if forget else 3)
    if not forget:
        assert run("2.parquet", rows[:4]) == 3
    assert spark.read.parquet(str(tmp_path / "out")).where("tag = 'IEND'").count() == 3
