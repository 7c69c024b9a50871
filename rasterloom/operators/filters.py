"""Row prediction filters, their cost and the adaptive choice, as array expressions.

A row needs the source row above it only, never another filtered row, so rows are filtered independently once that row is at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spec import Filter

#: Rows of this many bytes or more could overflow 32 bits, where the cost stays at its limit.
BIG_ROW, MOST_COST = 1 << 24, (1 << 32) - 1 - 256


def with_previous(rows: DataFrame, rows_per_chunk: int) -> DataFrame:
    """Adds prev, the row above (zeros above the first). The last row of each chunk is also sent to the next one, so that a window over
    (image, chunk) serves and one large image doesn't become one task."""
    chunk = F.floor(F.col("y") / rows_per_chunk)
    # a row is wanted by its own chunk, and as a neighbour by that of the row below
    wanted = F.array_distinct(F.array(chunk, F.floor((F.col("y") + 1) / rows_per_chunk)))
    sent = rows.select("*", F.explode(wanted).alias("chunk_id"))
    above = F.lag("src").over(W.partitionBy("image_id", "chunk_id").orderBy("y"))
    zeros = F.transform("src", lambda _: F.lit(0))
    return sent.withColumn("prev", above).where(F.col("chunk_id") == chunk).withColumn("prev", F.coalesce("prev", zeros))


def _at(values: Column, i: Column) -> Column:
    """0 before the start."""
    return F.coalesce(F.get(values, i), F.lit(0))


def paeth(left: Column, up: Column, corner: Column) -> Column:
    """Whichever neighbour is nearest to left + up - corner; the earlier on a tie."""
    a, b, c = F.abs(up - corner), F.abs(left - corner), F.abs(left + up - 2 * corner)
    return F.when((a <= b) & (a <= c), left).when(b <= c, up).otherwise(corner)


def filtered(kind: Filter, bpp: int, src: Column | None = None, prev: Column | None = None) -> Column:
    """The filtered bytes of a row, without the selector byte."""
    src, prev = F.col("src") if src is None else src, F.col("prev") if prev is None else prev
    wrap = lambda v: F.pmod(v, F.lit(256))
    if kind == Filter.NONE:
        return src
    if kind == Filter.SUB:
        return F.transform(src, lambda v, i: wrap(v - _at(src, i - bpp)))
    if kind == Filter.UP:
        return F.zip_with(src, prev, lambda v, u: wrap(v - u))
    if kind == Filter.AVERAGE:
        return F.transform(src, lambda v, i: wrap(v - F.shiftright(_at(src, i - bpp) + _at(prev, i), 1)))
    return F.transform(src, lambda v, i: wrap(v - paeth(_at(src, i - bpp), _at(prev, i), _at(prev, i - bpp))))


def limited(total: Column, size: Column) -> Column:
    """The cost of a row of so many bytes, held to its limit where 32 bits could overflow."""
    return F.when(size >= BIG_ROW, F.least(total, F.lit(MOST_COST))).otherwise(total)


def complexity(values: Column) -> Column:
    """Sum of the distances of filtered bytes from 0 modulo 256."""
    return limited(F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + F.least(v, 256 - v)), F.size(values))


CANDIDATES = (Filter.SUB, Filter.UP, Filter.AVERAGE, Filter.PAETH)


def costs(rows: DataFrame, bpp: int) -> DataFrame:
    """Adds c_sub, c_up, c_average, c_paeth."""
    return rows.select("*", *(complexity(filtered(k, bpp)).alias(f"c_{k.name.lower()}") for k in CANDIDATES))


def choice() -> tuple[Column, Column]:
    """Filter code and cost of the cheapest candidate; the earlier on a tie. Unfiltered rows never stand for election."""
    best = F.least(*(F.col(f"c_{k.name.lower()}") for k in CANDIDATES))
    code = F.lit(int(CANDIDATES[-1]))
    for k in CANDIDATES[-2::-1]:
        code = F.when(F.col(f"c_{k.name.lower()}") == best, int(k)).otherwise(code)
    return code, best


def adaptive(rows: DataFrame, bpp: int) -> DataFrame:
    """image_id, y, filter_type, complexity, data (selector byte first) of every row of with_previous()."""
    code, best = choice()
    chosen = costs(rows, bpp).select("image_id", "y", "src", "prev", code.alias("filter_type"), best.alias("complexity"))
    data = F.lit(None).cast("array<int>")
    for k in CANDIDATES:
        data = F.when(F.col("filter_type") == int(k), filtered(k, bpp)).otherwise(data)
    return chosen.select("image_id", "y", "filter_type", "complexity", F.concat(F.array("filter_type"), data).alias("data"))


def filter_rows(rows: DataFrame, bpp: int, mode: Filter | None) -> DataFrame:
    """A fixed filter, or the adaptive choice if mode is None; a fixed one evaluates no other."""
    if mode is None:
        return adaptive(rows, bpp)
    data = filtered(mode, bpp)
    return rows.select("image_id", "y", F.lit(int(mode)).alias("filter_type"), complexity(data).alias("complexity"), F.concat(F.array(F.lit(int(mode))), data).alias("data"))
