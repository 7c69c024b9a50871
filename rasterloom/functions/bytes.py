"""Byte strings in plans: big-endian numbers, conversion to arrays, mergeable checksums and frames."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADLER = 65521


def be32(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))


def u8(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def to_ints(data: Column) -> Column:
    """array<int> of a byte string's values."""
    return F.when(F.octet_length(data) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")))


def to_bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def adler32_of_ints(values: Column) -> Column:
    """Adler-32 in closed form: A = 1 + sum d, B = n + sum (n - i) d, i from 0, both modulo 65521."""
    n = F.size(values).cast("long")
    a = F.aggregate(values, F.lit(1).cast("long"), lambda s, d: s + d)
    b = n + F.aggregate(F.transform(values, lambda d, i: d * (n - i)), F.lit(0).cast("long"), lambda s, d: s + d)
    return (b % ADLER) * 65536 + a % ADLER


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    """Adler-32 of byte strings, Arrow batch by Arrow batch: Spark has no such function, and byte arrays would cost a hundredfold."""
    return data.map(lambda b: None if b is None else zlib.adler32(b)).astype("Int64")


def adler32_combine(parts: Column) -> Column:
    """Adler-32 of byte strings on end, from an array of structs (position, n, adler) in any order: an ordered fold, for it isn't commutative."""

    def step(s: Column, p: Column) -> Column:
        a1, b1 = s % 65536, F.shiftright(s, 16)
        a2, b2 = p["adler"] % 65536, F.shiftright(p["adler"], 16)
        a = F.pmod(a1 + a2 - 1, F.lit(ADLER))
        b = F.pmod(b1 + b2 + (p["n"] % ADLER) * (a1 - 1), F.lit(ADLER))
        return b * 65536 + a

    return F.aggregate(F.array_sort(parts), F.lit(1).cast("long"), step)


def frame(tag: Column, data: Column) -> Column:
    """Length, tag, data and CRC-32 of tag and data."""
    body = F.concat(tag, data)
    return F.concat(be32(F.octet_length(data)), body, be32(F.crc32(body)))
