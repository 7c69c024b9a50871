import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from rasterloom import session
from rasterloom.llm import common


def there(table):
    store, name = fs.FileSystem.from_uri(table.scratch_path)
    return store.get_file_info(name).type == fs.FileType.Directory


def test_written_tables_and_their_release(spark):
    one, two = common.cut(spark.range(5), "five"), common.cut(spark.range(6), "six")
    assert one.count() == 5 and there(one) and there(two) and one.scratch_path.startswith(common.shared_dir(spark))
    common.release(one, two)
    assert not there(one) and not there(two)
    assert not any(path in (one.scratch_path, two.scratch_path) for _, path in session._written)


def test_batches_are_bounded_in_bytes_not_rows(spark):
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    common.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    got = spark.range(0, 400, 1, 1).select(F.expr("repeat('x', 100000)").alias("t")).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 400 and max(r["size"] for r in got) < common.ARROW_BYTES + 200_000


def test_a_lower_bound_of_the_session_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    common.small_batches(spark)
    assert spark.conf.get(key) == "1000"
    spark.conf.set(key, before)
