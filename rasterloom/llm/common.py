"""Helpers that all training-data operators share: table reads, the shared folder, lineage cuts and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import cut, release, remove, scratch, shared_dir, ship_package

__all__ = ["ARROW_BYTES", "bounded", "components", "cut", "release", "remove", "scratch", "shared_dir", "small_batches", "table"]

#: Bytes in an Arrow batch (a longer row is a batch of its own); a lower setting of the session stays.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Makes sure that workers can import this package, and bounds what one Arrow batch holds in a Python worker. Rows may be of any
    length, so the bound is one of bytes; it is read when a plan runs, so the session's setting has to stay lowered."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def bounded(written: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows; beyond that the join that reads it shuffles."""
    return F.broadcast(written) if written.count() <= rows else written


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b) with a > b: rows (node, root) for every node that has an edge; root is the smallest node reachable.

    Alternates large-star and small-star until the forest of stars repeats. Both are a minimum by node and a join back, never a
    gathered neighbour list, so a node with very many edges is pre-aggregated and its join can be split. Every round is written to
    the shared folder; only two sums reach the driver.
    """
    label = "components"

    def star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written before they are joined back: then both sides have an exchange, and a centre with very many edges is split
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
        # large-star: what is larger than the centre moves to the centre's minimum
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), label)
        # small-star: smaller neighbours and the centre itself move to the minimum
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), label)
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), label)
        release(least, large, low, e)
        return after

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = cut(edges.select("a", "b").where("a <> b").distinct(), label)
    seen = mark(now)
    while seen[0]:
        now = star(now)
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
