"""What a session needs before Python code of this package runs on its executors, and the folder that they share with the driver."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each Spark application, so that workers can import them wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rasterloom-"), "rasterloom_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder, as all
    its tasks run on this machine; any other master is refused one."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not given:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir isn't set, and executors of {context.master} don't share this machine's folders")
        app = context.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="rasterloom-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        given = f"file://{_own[app]}"
    return qualified(spark, given)


def qualified(spark: SparkSession, path: str) -> str:
    """With its scheme: Spark takes a bare path for one of its default store, others must be told."""
    if "://" not in path:
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm).toString()
        if path.startswith("file:/") and not path.startswith("file://"):
            path = f"file://{path[5:]}"
    return path.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under the application's name. What is there when this process ends goes with it; what a killed
    driver leaves is that application's folder."""
    path = f"{shared_dir(spark)}/rasterloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _written:
        if path.startswith("file://"):
            shutil.rmtree(path[7:], ignore_errors=True)
        elif spark.sparkContext._jsc is not None:  # not stopped yet
            remove(spark, path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no recomputation of what is above."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once everything that reads them has been written itself."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)
        _written[:] = [w for w in _written if w[1] != t.scratch_path]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
