"""Near-duplicate documents by SetSketch registers.

A document's set holds the distinct 5-word shingles of its whole text (A-Z lower-cased, words are runs of anything but space, tab
to carriage return); a shorter text is one shingle, a text without words has the empty set and is linked with nothing.

1. Each set gets registers: every shingle draws one value from each of as many exponentially spaced truncated intervals
   and deals them to the registers by its own permutation; a register keeps the minimum, stored as floor(1 - log_b x). Registers of a
   union are the elementwise maximum of the parts' registers, so they merge. Later intervals hold larger values only, so a set stops
   drawing once every register is filled.
2. Documents with equal sets form one class, named by a hash of the set. Some bands of some register values each put classes in
   buckets; at the threshold's similarity two classes miss each other in all bands with a chance of MISS. The threshold is 0.85
   unless another is given; bands, rows, registers and floor follow from it (Plan).
3. Classes that buckets connect make up a neighbourhood. One of at most GROUP classes and GROUP_SHINGLES shingles is one group, which each
   class's set and registers reach once however many buckets it is in; its pairs with a bucket in common are looked at. Larger ones are
   taken bucket by bucket, a pair in the first band in which it collides: in a bucket of more than BLOCK classes each is first compared
   with one of them, the leader, whose set goes to every STAR of them once. Those not linked to it are cut in blocks of about BLOCK, the
   others too, and each pair of blocks with one that isn't is a small group whatever the bucket's size.
   The likelihood of the two registers' comparison, with the set sizes known, has its maximum above the plan's floor or the pair is
   dropped (5 standard deviations below the threshold); what remains is confirmed on the full sets. A group returns a spanning forest of
   its links, never its pairs.
4. Links become components by alternating large-star and small-star.

Null text counts as empty. Rows with a null doc_id are linked like all others, but never give a component its name; one of such rows
alone has a null component and all its rows count as kept (group_key tells it from others). Rows that repeat a doc_id are judged by
their own texts, which are classes of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, cut, release, small_batches

SHINGLE = 5
MISS = 1e-6
MAX_BANDS, MAX_ROWS = 64, 8  # a bucket's number ends in six bits of its band; a band is hashed as two words of four registers
BASE, RATE = 1.001, 20.0
BLOCK = 128
#: Members of a large bucket that meet its leader in one group.
STAR = 512
#: Classes of a neighbourhood that is one group, and the shingles in them, of 8 bytes each.
GROUP, GROUP_SHINGLES = 256, 4_000_000
PIECE = 1 << 18
#: Classes and buckets, of some 60 bytes each, that are broadcast to the rows they belong to; with more of them both sides are shuffled.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Plan:
    """What follows from a threshold of per_cent: 44 bands of 8 of 353 registers at 85, 59 bands of 7 of 419 at 80."""

    per_cent: int = 85

    @cached_property
    def _bands(self) -> tuple[int, int]:
        for rows in range(MAX_ROWS, 0, -1):
            bands = math.ceil(math.log(MISS) / math.log1p(-((self.per_cent / 100) ** rows)))
            if bands <= MAX_BANDS:
                return bands, rows
        raise ValueError(f"no bands for a threshold of {self.per_cent} per cent")

    @property
    def bands(self) -> int:
        return self._bands[0]

    @property
    def rows(self) -> int:
        return self._bands[1]

    @cached_property
    def registers(self) -> int:
        """A prime, so that every stride visits all registers; those beyond the bands only take part in the estimate."""
        m = self.bands * self.rows + 1
        while any(m % k == 0 for k in range(2, math.isqrt(m) + 1)):
            m += 1
        return m

    @cached_property
    def floor(self) -> float:
        """5 standard deviations below the threshold."""
        s = self.per_cent / 100
        return math.floor(100 * (s - 5 * math.sqrt(s * (1 - s) / self.registers))) / 100

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        at = np.minimum(np.searchsorted(a, b), len(a) - 1)
        both = int((a[at] == b).sum())
        return 100 * both >= self.per_cent * (len(a) + len(b) - both)


PLAN = Plan()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD1342543DE82EF95
_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, for at least n places."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * PIECE)
        for key, value in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            line = np.full(size, value, np.uint64)
            line[0] = 1
            _powers[key] = np.cumprod(line, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of data."""
    values = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~_WHITE[values]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _steps(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_BYTE[values] * up[: len(values)], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _long_words(data: bytes) -> np.ndarray:
    """Word hashes of a long text, in pieces that end at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _WHITE[data[end]]:
            end += 1
        out.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out)


def _windows(words: np.ndarray) -> np.ndarray:
    n = min(SHINGLE, len(words))
    total = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _PLACE[k]
    return mix(total)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts of a batch are hashed together in pieces of bounded size."""
    held: list[bytes] = []

    def flush() -> Iterator[np.ndarray]:
        if not held:
            return
        lengths = np.array([len(x) + 1 for x in held])
        words, starts = word_hashes(b" ".join(held))
        cuts = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(_windows(words[a:b])) if b > a else np.empty(0, np.uint64)
        held.clear()

    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > PIECE:
            yield from flush()
            size = 0
            words = _long_words(data)
            yield np.unique(_windows(words)) if len(words) else np.empty(0, np.uint64)
            continue
        held.append(data)
        size += len(data)
        if size >= PIECE:
            yield from flush()
            size = 0
    yield from flush()


def registers(items: np.ndarray, plan: Plan = PLAN) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes (uint16, 0 only in the empty set's)."""
    m = plan.registers
    out = np.zeros(m, np.uint16)
    n = len(items)
    if not n:
        return out
    place = mix(items ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)
    stride = mix(items ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(m - 1) + np.uint64(1)
    done, most = 0, min(m, math.ceil(m * -math.expm1(-(math.log(m) + 4) / n)))
    while done < m:
        j = np.arange(done, most, dtype=np.uint64)
        for at in range(0, n, 1 << 16):
            some = slice(at, at + (1 << 16))
            where = (place[some, None] + stride[some, None] * j) % np.uint64(m)
            u = (mix(items[some, None] + (j + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            x = -np.log((m - 1 - j.astype(np.float64) + np.maximum(u, 1e-12)) / m) / RATE
            level = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-26)) / math.log(BASE)), 1, 65535).astype(np.uint16)
            np.maximum.at(out, where.ravel().astype(np.intp), level.ravel())
        done, most = most, min(m, 2 * most)
        if out.all():
            break
    return out


_BAND_SALT = mix(np.arange(1, MAX_BANDS + 1, dtype=np.uint64) * np.uint64(0x589965CC75374CC3))


def band_hashes(levels: np.ndarray, plan: Plan = PLAN) -> np.ndarray:
    n = plan.bands
    held = np.zeros((n, MAX_ROWS), np.uint16)
    held[:, : plan.rows] = levels[: n * plan.rows].reshape(n, plan.rows)
    pair, salt = held.view(np.uint64), _BAND_SALT[:n]
    mixed = mix(mix(pair[:, 0] + salt) ^ (pair[:, 1] * np.uint64(0x9E3779B97F4A7C15) + salt))
    return ((mixed & ~np.uint64(63)) | np.arange(n, dtype=np.uint64)).view(np.int64)


def set_key(items: np.ndarray) -> str | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).hexdigest() if len(items) else None


_SKETCH = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.string()), ("bands", pa.list_(pa.int64()))])
_FULL = pa.schema([("key", pa.string()), ("items", pa.binary()), ("levels", pa.binary())])


def _sketch(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, bands = [], [], []
        for items in shingle_sets(batch.column(2).to_pylist()):
            sizes.append(len(items))
            keys.append(set_key(items))
            bands.append(band_hashes(registers(items, plan), plan) if len(items) else np.empty(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
        flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=_SKETCH)


def _full(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, set and registers of each class. A row that comes several times makes its class's once in a task."""
    done: set[str] = set()
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        new = [i for i, k in enumerate(keys) if k not in done and not done.add(k)]
        sets = list(shingle_sets([texts[i] for i in new]))
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.string()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([registers(x, plan).tobytes() for x in sets], pa.binary())], schema=_FULL)


def likely(higher: np.ndarray, lower: np.ndarray, size: int, sizes: np.ndarray, plan: Plan = PLAN) -> np.ndarray:
    """Whether the joint likelihood of a register comparison has its maximum at a similarity of the plan's floor or more.

    higher, lower: registers of one set above and below the other's. The log-likelihood is concave, so the sign of its
    derivative at floor tells on which side the maximum lies.
    """
    floor = plan.floor
    u = size / (size + sizes)
    v = 1 - u
    c = (BASE - 1) / BASE
    x, y = u - v * floor, v - u * floor
    p, q = (-np.log1p(-c * z) / math.log(BASE) for z in (x, y))
    dp, dq = (v * c / (1 - c * x) / math.log(BASE), u * c / (1 - c * y) / math.log(BASE))
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = -higher * dp / p - lower * dq / q + (plan.registers - higher - lower) * (dp + dq) / (1 - p - q)
    return (x > 0) & (y > 0) & (slope >= 0)


_LINK = pa.schema([("a", pa.string()), ("b", pa.string())])


def forest(plan: Plan, rows: list[tuple[str, int, bytes, bytes]], left: int = 0, right: int = 0, band: int | None = None) -> list[tuple[str, str]]:
    """The links of one pair of blocks, less those that close a circle. rows: key, block, set and registers of each class. band: that of the
    bucket, so pairs that share an earlier one are left to it; without it, pairs that share any."""
    rows = list({r[0]: r for r in rows}.values())
    keys = [r[0] for r in rows]
    blocks = np.array([r[1] for r in rows])
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    levels = np.stack([np.frombuffer(r[3], np.uint16) for r in rows])
    sizes = np.array([len(x) for x in sets], np.float64)
    banded = levels[:, : plan.bands * plan.rows].reshape(len(keys), plan.bands, plan.rows)
    parent = list(range(len(keys)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(blocks == left):
        others = np.flatnonzero(blocks == right)
        if left == right:
            others = others[others > i]
        ratio = np.minimum(sizes[others], sizes[i]) / np.maximum(sizes[others], sizes[i])
        others = others[ratio * 100 >= plan.per_cent - 1e-9]
        if band != 0 and len(others):
            common = (banded[others, :band] == banded[i, :band]).all(2).any(1)
            others = others[common if band is None else ~common]
        if not len(others):
            continue
        higher, lower = (levels[i] > levels[others]).sum(1), (levels[i] < levels[others]).sum(1)
        for j in others[likely(higher, lower, sizes[i], sizes[others], plan)]:
            x, y = find(i), find(j)
            if x != y and plan.linked(sets[i], sets[j]):
                parent[y] = x
                out.append((max(keys[i], keys[j]), min(keys[i], keys[j])))
    return out


def _told(links: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.string()), pa.array([b for _, b in links], pa.string())], schema=_LINK)


def _gathered(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come sorted by their first columns, group by group; a group is held only while its rows come in."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _neighbours(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _gathered(batches, 1):
        if len(rows) > 1 and (links := forest(plan, [(k, 0, items, levels) for k, items, levels in rows])):
            yield _told(links)


def _buckets(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, low, high, band), rows in _gathered(batches, 4):
        if len(rows) > 1 and (links := forest(plan, rows, low, high, band)):
            yield _told(links)


def _stars(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of members to their leader, which comes before them."""
    at, head = None, None
    for batch in batches:
        links = []
        leaders, salts, keys, sets = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        for leader, salt, key, items in zip(leaders, salts, keys, sets, strict=True):
            items = np.frombuffer(items, np.uint64)
            if (leader, salt) != at:
                at, head = (leader, salt), items
            elif key != leader and plan.linked(items, head):
                links.append((max(key, leader), min(key, leader)))
        yield _told(links)


def _large(placed: DataFrame, full: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """The blocks of large buckets, and links to their leaders.

    Every member is compared with the bucket's leader, its smallest key. Those that are linked to it are connected already, so only the
    rest are compared among themselves and with them. A bucket of many like texts takes as many rows as it has members; blocks cost
    more in proportion to those that aren't like the leader.
    """
    leaders = cut(placed.groupBy("bucket").agg(F.min("key").alias("leader")), "leaders")
    led = cut(placed.join(leaders, "bucket").select("key", "bucket", "band", "leader"), "led")
    pairs = led.where("key <> leader").select("key", "leader").distinct()
    counts = cut(pairs.groupBy("leader").agg(F.expr(f"(count(1) + {STAR - 1}) div {STAR}").alias("salts")), "salts")
    dealt = cut(pairs.join(counts, "leader").select("leader", F.expr("pmod(xxhash64(key), salts)").alias("salt"), F.lit(1).alias("place"), "key"), "dealt")
    heads = counts.select("leader", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.lit(0).alias("place"), F.col("leader").alias("key"))
    met = dealt.unionByName(heads).join(full.select("key", "items"), "key").select("leader", "salt", "place", "key", "items")
    stars = cut(met.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "place").mapInArrow(partial(_stars, plan), "a string, b string"), "stars")
    linked = stars.select(F.greatest("a", "b").alias("member"), F.least("a", "b").alias("head"))
    members = led.join(linked, (F.col("key") == F.col("member")) & (F.col("leader") == F.col("head")), "left").select("key", "bucket", "band", (F.col("member").isNotNull() | (F.col("key") == F.col("leader"))).alias("like"))
    members = cut(members.distinct(), "likes")
    counted = cut(members.groupBy("bucket").agg(F.sum(F.when(F.col("like"), 1).otherwise(0)).alias("n_like"), F.sum(F.when(F.col("like"), 0).otherwise(1)).alias("n_other")), "counts")
    release(leaders, led, counts, dealt)
    # blocks of the others come first, then those of the like
    dealt = members.join(counted, "bucket").withColumn("others", F.expr(f"(n_other + {BLOCK - 1}) div {BLOCK}")).withColumn("likes", F.expr(f"(n_like + {BLOCK - 1}) div {BLOCK}"))
    dealt = dealt.where("others > 0").withColumn("block", F.expr("if(like, others + pmod(xxhash64(key), likes), pmod(xxhash64(key), others))"))
    meets = F.expr("if(like, sequence(0L, others - 1), sequence(0L, others + likes - 1))")
    spread = dealt.select("key", "bucket", "band", "block", F.explode(meets).alias("x"))
    return spread.select("key", "bucket", "band", "block", F.least("block", "x").alias("low"), F.greatest("block", "x").alias("high")), stars


def links_of(texts: DataFrame, heads: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between classes: a spanning forest of each group. texts: doc_id, raw, text; heads: doc_id, raw, set_key, n_shingles, bands."""
    # a bucket's number ends in that of its band
    every = heads.select(F.col("set_key").alias("key"), "doc_id", "raw", "n_shingles", F.explode("bands").alias("bucket"))
    shared = cut(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    held = cut(every.join(bounded(shared, BROADCAST_ROWS), "bucket"), "held")
    placed = cut(held.select("bucket", "key").distinct(), "placed")
    # buckets with the same members are looked at once, in the first band: there all their pairs collide first
    members = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")).where("n > 1")
    first = members.groupBy("n", "x", "y").agg(F.min(F.struct(F.expr("bucket & 63").alias("band"), "bucket")).alias("first")).select("n", "first.band", "first.bucket")
    chosen = cut(placed.join(first, "bucket"), "members")
    wanted = held.join(chosen.select("key").distinct(), "key").groupBy("key").agg(F.min(F.struct("doc_id", "raw", "n_shingles")).alias("row"))
    wanted = cut(wanted.select("key", F.col("row.doc_id").alias("id"), F.col("row.raw").alias("id_raw"), F.col("row.n_shingles").alias("size")), "wanted")
    named = bounded(wanted, BROADCAST_ROWS)
    full = cut(texts.join(named, texts["doc_id"].eqNullSafe(named["id"]) & (texts["raw"] == named["id_raw"])).select("key", "text").mapInArrow(partial(_full, plan), "key string, items binary, levels binary"), "sets")
    release(shared, held, placed)
    # neighbourhoods: what buckets connect
    leaders = cut(chosen.groupBy("bucket").agg(F.min("key").alias("leader")), "leaders")
    around = components(chosen.join(leaders, "bucket").select(F.col("key").alias("a"), F.col("leader").alias("b")))
    sized = around.join(wanted.select(F.col("key").alias("node"), "size"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("classes"), F.sum("size").alias("shingles"))
    near = cut(around.join(cut(sized.where((F.col("classes") <= GROUP) & (F.col("shingles") <= GROUP_SHINGLES)), "sized"), "root").select(F.col("node").alias("key"), "root"), "near")
    grouped = full.join(bounded(near, BROADCAST_ROWS), "key").select("root", "key", "items", "levels").repartition("root").sortWithinPartitions("root")
    links = cut(grouped.mapInArrow(partial(_neighbours, plan), "a string, b string"), "links")
    # the others, bucket by bucket
    rest = cut(chosen.join(near, "key", "left_anti"), "rest")
    release(leaders, near, chosen, wanted)
    small = rest.where(F.col("n") <= BLOCK).select("key", "bucket", "band", *(F.lit(0).cast("long").alias(c) for c in ("block", "low", "high")))
    large, stars = _large(rest.where(F.col("n") > BLOCK), full, plan)
    spread = small.unionByName(large).join(full, "key").select("bucket", "low", "high", "band", "key", "block", "items", "levels")
    more = spread.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(partial(_buckets, plan), "a string, b string")
    return links.unionByName(more).unionByName(stars)


def near_groups(documents: DataFrame, per_cent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group_key, raw of every row; sets are linked from a similarity of per_cent. group_key: the same
    for all rows of a component, null for empty sets.

    Shuffles: numbers of buckets, partly aggregated; once, the sets and registers of classes that share a bucket. Texts and bands stay
    where they are unless more than BROADCAST_ROWS classes are wanted of them.
    """
    small_batches(documents.sparkSession)
    plan = Plan(per_cent)
    # what names a row is its doc_id and a hash of its text, for a doc_id may come with several texts
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.octet_length("text"), "text").alias("raw"), "text")
    sketches = cut(texts.mapInArrow(partial(_sketch, plan), "doc_id long, raw long, n_shingles long, set_key string, bands array<long>"), "sketches")
    known = sketches.where("set_key IS NOT NULL")
    classes = cut(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    twice = bounded(cut(classes.where("n > 1"), "twice"), BROADCAST_ROWS)
    heads = known.join(twice, "set_key", "left").where("n IS NULL OR doc_id <=> rep").select("doc_id", "raw", "set_key", "n_shingles", "bands")
    found = components(links_of(texts, heads, plan))
    named = found.join(classes, found["node"] == classes["set_key"]).select("node", "root", "rep")
    least = cut(named.groupBy("root").agg(F.min("rep").alias("least")), "least")
    linked = cut(named.join(least, "root").select(F.col("node").alias("set_key"), "root", "least"), "linked")
    release(classes, least)
    with_set = known.join(twice, "set_key", "left").join(bounded(linked, BROADCAST_ROWS), "set_key", "left")
    with_set = with_set.select("doc_id", "n_shingles", F.expr("CASE WHEN root IS NOT NULL THEN least WHEN n IS NOT NULL THEN rep ELSE doc_id END").alias("component_id"), F.coalesce("root", "set_key").alias("group_key"), "raw")
    rest = sketches.where("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("group_key"), "raw")
    return with_set.unionByName(rest).select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "group_key", "raw")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_groups(table(spark, sf_dir, "documents")).drop("group_key", "raw")


#: Full sets, all pairs with a shingle in common, and components by recursion.
ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS t FROM documents
),
n AS (
  SELECT rid, doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < {SHINGLE} THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(t) - {SHINGLE - 1}), lambda i: array_to_string(t[i:i + {SHINGLE - 1}], ' '))) END AS s FROM w
),
u AS (SELECT rid, unnest(s) AS x FROM n),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.rid < b.rid GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM pairs JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * k >= 85 * (len(p.s) + len(q.s) - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(rid, other) AS (SELECT rid, rid FROM n UNION SELECT r.rid, e.b FROM reach r JOIN edges e ON e.a = r.other),
lowest AS (SELECT r.rid, min(o.doc_id) AS component_id FROM reach r JOIN n o ON o.rid = r.other GROUP BY r.rid)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN lowest USING (rid)
"""
