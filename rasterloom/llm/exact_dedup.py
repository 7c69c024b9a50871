"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of CHUNK bytes. Each chunk's fingerprint is the polynomial sum((byte + 1) * r**(n - 1 - i)) modulo a
31-bit prime, under two primes at once; chunks are hashed side by side as one matrix product and combined by shifting the left one
by r**length of the right one, so pieces of a huge text could be hashed anywhere and merged in order. Texts whose fingerprint and
length agree are compared chunk by chunk before they count as equal; a text that differs in spite of that is grouped by its SHA-256.

Texts are equal when identical after replacing each run of white space (space, tab to carriage return) by one space.
Null texts count as empty. Rows that repeat a doc_id are judged one by one: each carries the same keep_id, and kept tells whether
its doc_id is the one that stays. A null doc_id never stays before one that isn't null; its rows are compared like all others. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, release, small_batches

CHUNK = 4096
PRIMES = (2147483647, 2147483629)
BASES = (1103515261, 1597334677)
#: Code points that a comparison holds of each text at once.
COMPARE = 1 << 16
#: Marks, of some 60 bytes each, that are broadcast to the rows they belong to; with more of them both sides are shuffled.
BROADCAST_ROWS = 500_000

_RUN = re.compile(r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def _powers() -> np.ndarray:
    out = np.empty((CHUNK, 2))
    for k, (p, r) in enumerate(zip(PRIMES, BASES, strict=True)):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, k] = x
            x = x * r % p
    return out


POWERS = _powers()
SHIFT = tuple(pow(r, CHUNK, p) for p, r in zip(PRIMES, BASES, strict=True))


def normalise(text: str | None) -> str:
    return _RUN.sub(" ", text) if text else ""


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    """The fingerprint of two byte strings on end, from theirs: the left one is shifted by the length of the right one."""
    return tuple((a * pow(r, right_length, p) + b) % p for a, b, p, r in zip(left, right, PRIMES, BASES, strict=True))


def fingerprint(data: bytes) -> tuple[int, int]:
    """Products stay below 2**8 * 2**31 * 2**12 = 2**51, so float64 sums are exact in any order."""
    n = len(data)
    whole = n // CHUNK
    values = np.frombuffer(data, np.uint8)
    out = (0, 0)
    for at in range(0, whole, 256):
        rows = values[at * CHUNK : min(whole, at + 256) * CHUNK].reshape(-1, CHUNK).astype(np.float64) + 1.0
        for one in (rows @ POWERS).astype(np.int64):
            out = tuple((a * s + int(x)) % p for a, s, x, p in zip(out, SHIFT, one, PRIMES, strict=True))
    if rest := n - whole * CHUNK:
        tail = (values[whole * CHUNK :].astype(np.float64) + 1.0) @ POWERS[CHUNK - rest :]
        out = combine(out, tuple(int(x) % p for x, p in zip(tail, PRIMES, strict=True)), rest)
    return out


def chunks(text: str | None, size: int = COMPARE) -> Iterator[str]:
    """The normalised text in pieces, of which the last may be short, without building it as a whole."""
    held, open_run = "", False
    text = text or ""
    for at in range(0, len(text), size):
        piece = text[at : at + size]
        if open_run:
            piece = piece.lstrip(_WHITE)
        if not piece:
            continue
        open_run = piece[-1] in _WHITE
        held += _RUN.sub(" ", piece)
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def same(a: str | None, b: str | None) -> bool:
    x, y = chunks(a), chunks(b)
    while True:
        p, q = next(x, None), next(y, None)
        if p != q:
            return False
        if p is None:
            return True


_MARKS = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("fp", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string())])
_SAME = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("text_sha256", pa.string())])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, lengths, shas = [], [], []
        for text in batch.column(2):
            data = normalise(text.as_py()).encode("utf-8", "surrogatepass")
            a, b = fingerprint(data)
            fps.append(a << 31 | b)
            lengths.append(len(data))
            shas.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(lengths, pa.int64()), pa.array(shas, pa.string())], schema=_MARKS)


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text isn't the head's."""
    for batch in batches:
        told = pa.array([not same(a.as_py(), b.as_py()) for a, b in zip(batch.column(3), batch.column(4), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(told) for k in range(3)], schema=_SAME)


def _named(documents: DataFrame) -> DataFrame:
    """doc_id, raw, text. What names a row is its doc_id and a hash of its text as it is, for a doc_id may be null or come with several texts."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.octet_length("text"), "text").alias("raw"), "text")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, raw, fp, n_bytes, text_sha256 of every row."""
    small_batches(documents.sparkSession)
    return _named(documents).mapInArrow(_mark, "doc_id long, raw long, fp long, n_bytes long, text_sha256 string")


def exact_groups(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, raw of every row; see the module's docstring for null, empty and repeated rows.

    Shuffles: the marks by fingerprint, partly aggregated, and the texts of those rows whose fingerprint isn't alone. A row without a
    partner never leaves its task unless such rows are more than BROADCAST_ROWS. A hot group meets its head in a plain equi-join of
    written tables, which adaptive execution splits.
    """
    marks = cut(fingerprints(documents), "marks")
    by = ["fp", "n_bytes"]
    # of each group with more than one row, the row that the others are compared with
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw")).alias("first")
    groups = cut(marks.groupBy(*by).agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select(*by, "first.doc_id", "first.raw").toDF(*by, "head_id", "head_raw"), "groups")
    members = cut(marks.join(bounded(groups, BROADCAST_ROWS), by), "members")
    is_head = F.expr("doc_id <=> head_id AND raw = head_raw")
    wanted = cut(members.select(F.col("doc_id").alias("id"), F.col("raw").alias("id_raw"), *by, "text_sha256", is_head.alias("is_head")).distinct(), "wanted")
    texts, named = _named(documents), bounded(wanted, BROADCAST_ROWS)
    bodies = cut(texts.join(named, texts["doc_id"].eqNullSafe(named["id"]) & (texts["raw"] == named["id_raw"])).select("doc_id", "raw", *by, "text_sha256", "is_head", "text"), "bodies")
    # a row that comes several times is compared as often; its head's text comes once
    heads = cut(bodies.where("is_head").dropDuplicates(by).select(*by, F.col("text").alias("head")), "heads")
    pairs = bodies.where("NOT is_head").join(heads, by).select("doc_id", "raw", "text_sha256", "text", "head")
    # texts that differ in spite of their fingerprints are grouped by their hash
    odd = cut(pairs.mapInArrow(_differ, "doc_id long, raw long, text_sha256 string").distinct().select(F.col("doc_id").alias("odd_id"), F.col("raw").alias("odd_raw"), F.col("text_sha256").alias("own")), "odd")
    release(wanted, bodies, heads, groups)

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.join(odd, rows["doc_id"].eqNullSafe(odd["odd_id"]) & (rows["raw"] == odd["odd_raw"]), "left").withColumn("own", F.coalesce("own", F.lit("")))

    key = [*by, "own"]
    sizes = cut(keyed(members).groupBy(*key).agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")), "sizes")
    release(members)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("group_id"))
    return keyed(marks).join(bounded(sizes, BROADCAST_ROWS), key, "left").select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", "raw")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_groups(table(spark, sf_dir, "documents")).drop("raw")


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW w AS (PARTITION BY body)
"""
