"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Tokens are the runs of letters, marks and digits of the lower-cased text. A mask is laid at every token position and hashes the
tokens under its ones; what lies under its zeros is ignored, so a substituted word there doesn't hide a copy. Hashes of documents
and of benchmark items are joined, and each hit names a diagonal: the document position minus the item position. On a diagonal the
tokens of the whole item are compared with the document's in place. It counts as an overlap if some WINDOW consecutive item tokens
(or the whole item, if shorter) agree in at least SIMILARITY per cent of their places.

MASKS find every such window of LONG tokens or more, wherever its substitutions are. Shorter items have masks of their own over the
whole item: one for each token that may be substituted, or a full one where the similarity allows for none. So nothing that the rule
calls an overlap is missed. Before masks are laid at a position, the few tokens there that all masks have in common are looked up in
a bitmap of the benchmark's; it only spares work.

Items with the same tokens are one, named by its smallest item_id (n_items tells how many there are). Items and texts without tokens
match nothing. Rows without a doc_id or item_id can't be reported and are left out. Rows that repeat a doc_id are pooled under it.
Extra columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, release

MASKS = ("111011", "1101011", "11100111")
WINDOW = 13
SIMILARITY = 80
#: Tokens of an item from which MASKS serve.
LONG = 8
#: Benchmark seeds, items and hits that may be broadcast, of some 50 bytes each; with more of them the join shuffles.
BROADCAST_ROWS = 1_000_000
#: The bitmap has 16 bits for each gram, but not more than so many 64-bit words, for each row of texts carries it through one operator.
BITMAP_WORDS = 1 << 13

_TOKENS = r"array_remove(split(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), '')"


def token_hashes(text: str) -> Column:
    return F.expr(f"transform({_TOKENS.format(text=text)}, t -> xxhash64(t))")


def once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """df with value as a column that the optimiser can't copy into a lambda, where it would be computed for every element."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def masks_of(length: int) -> tuple[str, ...]:
    """The masks that serve an item of so many tokens."""
    if length >= LONG:
        return MASKS
    spare = length - -(-SIMILARITY * length // 100)  # never above 1 below LONG
    return tuple("1" * k + "0" + "1" * (length - 1 - k) for k in range(length)) if spare else ("1" * length,)


def grams_of(length: int) -> tuple[tuple[int, ...], ...]:
    """Token places of which one group is intact wherever a mask of masks_of(length) hits."""
    masks = masks_of(length)
    common = tuple(i for i in range(min(map(len, masks))) if all(m[i] == "1" for m in masks))
    return (common,) if common else ((0, 1), (length - 2, length - 1))


def _gram(length: int, which: int, places: tuple[int, ...], i: str) -> str:
    """A number for the tokens at some places from i on."""
    parts = [f"shiftleft(get(h, {i} + {p}), {k})" for k, p in enumerate(places)]
    return " ^ ".join([*parts, f"{length * 977 + which}L"])


def _seed(mask: str, i: str) -> str:
    under = ", ".join(f"get(h, {i} + {k})" for k, bit in enumerate(mask) if bit == "1")
    return f"if({i} + {len(mask)} <= n, named_struct('pos', {i}, 'seed', xxhash64('{mask}', {under})), NULL)"


def _at(words: int) -> tuple[str, str]:
    """Word and bit of a gram x in the bitmap."""
    return f"CAST((x ^ shiftright(x, 32)) & {words - 1}L AS INT)", "CAST(shiftright(x, 48) & 63 AS INT)"


def seeds(hashed: DataFrame, key: str, lengths: list[int], bitmap: tuple[DataFrame, int] | None = None) -> DataFrame:
    """key, pos, seed at every position of hashed(key, n, h) where the bitmap doesn't rule a hit out. lengths: of items, LONG for all long ones."""
    parts = []
    for length in lengths:
        masks = masks_of(length)
        least = min(map(len, masks))
        if bitmap is None:
            places = f"sequence(0, n - {least})"
        else:
            word, bit = _at(bitmap[1])
            hit = f"(shiftright(get(bits, {word}), {bit}) & 1) = 1"
            told = [f"transform(transform(sequence(0, n - {least}), i -> {_gram(length, w, g, 'i')}), x -> {hit})" for w, g in enumerate(grams_of(length))]
            held = told[0] if len(told) == 1 else f"zip_with({told[0]}, {told[1]}, (a, b) -> a OR b)"
            places = f"array_compact(transform({held}, (a, i) -> if(a, i, NULL)))"
        parts.append(f"if(n >= {least}, flatten(transform({places}, i -> array({', '.join(_seed(m, 'i') for m in masks)}))), array())")
    rows = hashed if bitmap is None else hashed.withColumn("bits", bitmap[0].scalar())
    return rows.select(key, F.explode(F.expr(f"array_compact(concat({', '.join(parts)}))")).alias("s")).select(key, "s.pos", "s.seed")


def bitmap_of(items: DataFrame, lengths: list[int], count: int) -> tuple[DataFrame, int]:
    """One row with the bitmap of the items' grams as array<bigint>, and its length. count: of their tokens."""
    words = 64
    while words < min(BITMAP_WORDS, count // 4):
        words *= 2
    word, bit = _at(words)
    grams = ", ".join(
        f"if({f'n >= {LONG}' if length == LONG else f'n = {length}'}, transform(sequence(0, n - {min(map(len, masks_of(length)))}), i -> {_gram(length, w, g, 'i')}), array())" for length in lengths for w, g in enumerate(grams_of(length))
    )
    bits = items.select(F.explode(F.expr(f"concat({grams})")).alias("x")).groupBy(F.expr(word).cast("long").alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("bits"))
    every = items.sparkSession.range(words).join(bits, "id", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all")).select(F.col("all.bits")), words


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_tokens (of the item), n_matched (most tokens that agree on one diagonal), n_items of every overlapping pair."""
    told = once(benchmark, "h", token_hashes("text"), "item_id").where("item_id IS NOT NULL AND size(h) > 0")
    items = cut(told.groupBy("h").agg(F.min(F.col("item_id").cast("long")).alias("item_id"), F.count(F.lit(1)).alias("n_items")).withColumn("n", F.size("h")), "items")
    sizes = items.groupBy(F.least("n", F.lit(LONG)).alias("length")).agg(F.sum("n").alias("tokens")).collect()  # LONG rows at most
    if not sizes:
        return documents.limit(0).select(*(F.lit(0).cast("long").alias(c) for c in ("doc_id", "item_id", "n_tokens", "n_matched", "n_items")))
    lengths = sorted(r["length"] for r in sizes)
    # an item has the seeds of its own length only
    each = [seeds(items.where(F.col("n") >= LONG if length == LONG else F.col("n") == length), "item_id", [length]) for length in lengths]
    tests = each[0]
    for more in each[1:]:
        tests = tests.unionByName(more)
    tests = bounded(cut(tests.distinct().withColumnRenamed("pos", "item_pos"), "seeds"), BROADCAST_ROWS)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    hashed = once(texts, "h", token_hashes("text"), "doc_id").withColumn("n", F.size("h"))
    found = seeds(hashed, "doc_id", lengths, bitmap_of(items, lengths, sum(r["tokens"] for r in sizes)))
    hits = cut(found.join(tests, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct(), "hits")
    # a document's hits go to its text together, which is tokenised once; what leaves it is as long as the items
    known = bounded(items.select("item_id", "n"), BROADCAST_ROWS)
    grouped = bounded(cut(hits.join(known, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "n")).alias("hits")), "grouped"), BROADCAST_ROWS)
    near = once(texts.join(grouped, "doc_id"), "h", token_hashes("text"), "doc_id", "hits")
    beside = "concat(array_repeat(CAST(NULL AS BIGINT), greatest(0, -x.diagonal)), slice(h, greatest(0, x.diagonal) + 1, x.n))"
    sides = near.select("doc_id", F.explode(F.expr(f"transform(hits, x -> named_struct('item_id', x.item_id, 'side', {beside}))")).alias("x")).select("doc_id", "x.*")
    whole = sides.join(bounded(items, BROADCAST_ROWS), "item_id")
    # nulls where the item hangs over an end of the text
    agree = once(whole, "agree", F.expr("slice(zip_with(h, side, (x, y) -> if(x = y, 1, 0)), 1, n)"), "doc_id", "item_id", "n", "n_items").withColumn("w", F.least(F.lit(WINDOW), "n"))
    enough = F.expr(f"exists(sequence(0, n - w), s -> 100 * aggregate(slice(agree, s + 1, w), 0, (a, x) -> a + x) >= {SIMILARITY} * w)")
    out = agree.where(enough).select("doc_id", "item_id", F.col("n").cast("long").alias("n_tokens"), F.expr("aggregate(agree, 0L, (a, x) -> a + x)").alias("n_matched"), "n_items")
    out = cut(out.groupBy("doc_id", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.max("n_matched").alias("n_matched"), F.max("n_items").alias("n_items")), "overlaps")
    release(hits)
    return out


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All diagonals, without seeds: every pair of equal tokens, and windows of item places along each diagonal.
ORACLE = rf"""
WITH dt AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '') AS t FROM documents WHERE doc_id IS NOT NULL),
bt AS (SELECT min(item_id) AS item_id, count(*) AS n_items, t FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '') AS t FROM benchmark WHERE item_id IS NOT NULL) WHERE len(t) > 0 GROUP BY t),
d AS (SELECT rid, unnest(generate_series(1, len(t))) AS p, unnest(t) AS token FROM dt),
b AS (SELECT item_id, len(t) AS m, least({WINDOW}, len(t)) AS w, unnest(generate_series(1, len(t))) AS q, unnest(t) AS token FROM bt),
same AS (SELECT rid, item_id, m, w, p - q AS diagonal, q FROM d JOIN b USING (token)),
-- windows start at matches; one that would reach beyond the item holds no more matches than the item's last window
dense AS (SELECT *, count(*) OVER (PARTITION BY rid, item_id, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k FROM same),
diagonals AS (SELECT rid, item_id, diagonal, max(m) AS m, count(*) AS n_matched FROM dense GROUP BY rid, item_id, diagonal HAVING bool_or(100 * k >= {SIMILARITY} * w))
SELECT doc_id, item_id, max(m)::BIGINT AS n_tokens, max(n_matched)::BIGINT AS n_matched, max(n_items)::BIGINT AS n_items
FROM diagonals JOIN dt USING (rid) JOIN bt USING (item_id) GROUP BY doc_id, item_id
"""
