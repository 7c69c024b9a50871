"""The corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

All stages but the last return the columns of the documents they were given; extra columns stay. Decisions are made and applied row by
row: a row is named by its doc_id, which may be null or come several times, and a hash of its text. Of rows that repeat both, exact dedup
keeps one. An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.byte_bpe import RANKS, digests
from rasterloom.llm.common import bounded, cut, release, table
from rasterloom.llm.decontaminate import overlaps
from rasterloom.llm.exact_dedup import exact_groups
from rasterloom.llm.near_dedup import near_groups
from rasterloom.llm.toxicity import keep_clean, train

#: Per cent of shared five-word shingles from which documents are near-duplicates; op3_near_dedup has its own.
NEAR = 80
#: Pieces that a worker keeps between batches.
REMEMBERED = 100_000
#: Named rows, of some 30 bytes each, that are broadcast to the documents; with more of them both sides are shuffled.
NAMED = 1_000_000


def _raw(docs: DataFrame) -> Column:
    """The hash that names a row's text, as exact_groups and near_groups give it."""
    return F.xxhash64(F.octet_length(docs["text"]), docs["text"])


def _named(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined by row with a written table (row_id, row_raw)."""
    rows = bounded(rows, NAMED)
    return docs.join(rows, docs["doc_id"].eqNullSafe(rows["row_id"]) & (_raw(docs) == rows["row_raw"]), how)


def _one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row of each group, that with the smallest doc_id. groups: doc_id, raw, key of every row; rows whose key is null stay."""
    several = cut(groups.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw")).alias("stays")).where("n > 1"), "several")
    judged = cut(groups.join(bounded(several, NAMED), "key").select(F.col("doc_id").alias("row_id"), F.col("raw").alias("row_raw"), F.expr("doc_id <=> stays.doc_id AND raw = stays.raw").alias("stays")), "judged")
    gone = cut(judged.where("NOT stays").select("row_id", "row_raw").distinct(), "gone")
    # the row that stays may itself come several times
    again = cut(judged.where("stays").groupBy("row_id", "row_raw").count().where("count > 1").drop("count"), "again")
    release(several, judged)
    left = _named(docs, gone, "left_anti")
    return _named(left, again, "left_anti").unionByName(_named(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold."""
    return keep_clean(docs, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, that with the smallest doc_id."""
    groups = cut(exact_groups(docs).where("group_size > 1").select("doc_id", "raw", F.col("text_sha256").alias("key")), "groups")
    return _one_of_each(docs, groups)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (a similarity of NEAR per cent or more), that with the smallest doc_id."""
    groups = cut(near_groups(docs, NEAR).where("group_key IS NOT NULL").select("doc_id", "raw", F.col("group_key").alias("key")), "groups")
    return _one_of_each(docs, groups)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark: texts are named by their hash, so a row is judged by its own."""
    found = overlaps(docs.select(_raw(docs).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = bounded(cut(found.select(F.col("doc_id").alias("text_hash")).distinct(), "found"), NAMED)
    return docs.join(found, _raw(docs) == found["text_hash"], "left_anti")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and hashes of the ids and of what they decode to. Workers remember fewer pieces than by default, for they
    still hold what earlier stages left."""
    return digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, REMEMBERED)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("byte_bpe", byte_bpe)]

#: No SQL: the toxicity model is trained, and merges by rank need recursion for every word.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            release(before)
    return docs
