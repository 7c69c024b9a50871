"""Byte-level BPE encoding and decoding with recursive DuckDB queries, one in-memory database for each Python worker.

A text is cut by the tokenizer's pattern; each distinct piece of a batch that isn't known yet becomes rows (word, position, token).
A recursive query keeps each row's successor, joins the two with the merge table, contracts every word's leftmost pair of minimum rank and
repeats until no word has a pair left; the rows of a word's last round, in order, are its ids. The merge table holds every way to
cut a vocabulary entry in two entries, since any two neighbours whose concatenation is an entry may merge. Decoding joins the ids
of a batch with the vocabulary and aggregates the pieces of each document in order of position.

A piece of more than LONG bytes is first split wherever two bytes stand side by side that do so in no vocabulary entry: no token can
span such a place, so the parts are contracted by themselves. Parts that are still long would take a round for every merge. For them the
query contracts all places of the minimum pair in one round, of places that overlap the first, third and so on. That is what one place
at a time comes to as long as no pair that comes about ranks lower; where one does, only the leftmost place is contracted. The rounds
are run some at a time, since a recursive query keeps the rows of them all.

Results for pieces are kept between batches, KNOWN of them at most (half of them the last used).

Null text counts as empty: no ids, and the hash of nothing. Rows with a null or repeated doc_id are encoded one by one. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG = 256
KNOWN = 1_000_000
#: Pieces that one recursive query contracts, and rows that it holds of long ones, over all its rounds.
LEARNED, LONG_ROWS = 20_000, 3_000_000
#: MB that a worker's database may hold, and bytes more for each byte of a long part that can't be split.
MEMORY, LONG_BYTES = 200, 600
#: Token rows that one decoding query holds.
DECODE_ROWS = 1 << 17

_CONTRACT = """
WITH RECURSIVE step(round, w, pos, id, after, next) AS (
  SELECT 0, w, pos, id, lead(pos) OVER o, lead(id) OVER o FROM pieces WINDOW o AS (PARTITION BY w ORDER BY pos)
  UNION ALL
  (
    WITH pairs AS MATERIALIZED (SELECT s.*, m.merged FROM step s LEFT JOIN merges m ON m.a = s.id AND m.b = s.next),
    best AS (SELECT w, min(merged::BIGINT * 65536 + pos) AS key FROM pairs WHERE merged IS NOT NULL GROUP BY w),
    first AS (SELECT p.w, p.pos AS at, p.merged, p.after AS gone FROM best b JOIN pairs p ON p.w = b.w AND p.pos = b.key % 65536),
    joined AS (SELECT f.*, p.after AS then_after, p.next AS then_next FROM first f JOIN pairs p ON p.w = f.w AND p.pos = f.gone)
    SELECT p.round + 1, p.w, p.pos, CASE WHEN p.pos = j.at THEN j.merged ELSE p.id END,
      CASE WHEN p.pos = j.at THEN j.then_after ELSE p.after END,
      CASE WHEN p.pos = j.at THEN j.then_next WHEN p.after = j.at THEN j.merged ELSE p.next END
    FROM pairs p JOIN joined j ON j.w = p.w
    WHERE p.pos <> j.gone
  )
)
SELECT w, id FROM (SELECT *, max(round) OVER (PARTITION BY w) AS last FROM step) WHERE round = last ORDER BY w, pos
"""
#: The same over long pieces, from a state of earlier rounds: hits are all places of the minimum pair, of which those in odd places of a run go.
_CONTRACT_LONG = """
WITH RECURSIVE step(round, w, pos, id, after, next) AS (
  SELECT 0, w, pos, id, after, next FROM state
  UNION ALL
  (
    WITH pairs AS MATERIALIZED (SELECT s.*, m.merged FROM step s LEFT JOIN merges m ON m.a = s.id AND m.b = s.next),
    best AS (SELECT w, min(merged::BIGINT << 32 | pos) AS key FROM pairs WHERE merged IS NOT NULL GROUP BY w),
    places AS MATERIALIZED (
      SELECT p.w, p.pos AS spot, p.merged, p.after AS gone, g.after AS then_after, g.next AS then_next, q.id AS before, b.key & 4294967295 AS leftmost
      FROM best b JOIN pairs p ON p.w = b.w AND p.merged = b.key >> 32 JOIN pairs g ON g.w = p.w AND g.pos = p.after LEFT JOIN pairs q ON q.w = p.w AND q.after = p.pos
    ),
    lower AS (
      SELECT p.w FROM places p JOIN lows l ON l.a = p.merged AND l.b = p.then_next AND l.merged < p.merged
      UNION SELECT p.w FROM places p JOIN lows l ON l.a = p.before AND l.b = p.merged AND l.merged < p.merged
      UNION SELECT p.w FROM places p JOIN lows l ON l.a = p.merged AND l.b = p.merged
    ),
    hits AS (
      SELECT p.*, row_number() OVER o AS k, lag(p.gone) OVER o IS NOT DISTINCT FROM p.spot AS follows
      FROM places p LEFT JOIN lower l ON l.w = p.w WHERE l.w IS NULL OR p.spot = p.leftmost WINDOW o AS (PARTITION BY p.w ORDER BY p.spot)
    ),
    runs AS (SELECT *, k - max(CASE WHEN follows THEN 0 ELSE k END) OVER (PARTITION BY w ORDER BY spot) AS place FROM hits),
    joined AS MATERIALIZED (SELECT * FROM runs WHERE place % 2 = 0),
    kept AS (
      SELECT p.round + 1 AS round, p.w, p.pos, coalesce(j.merged, p.id) AS id, CASE WHEN j.spot IS NULL THEN p.after ELSE j.then_after END AS after, CASE WHEN j.spot IS NULL THEN p.next ELSE j.then_next END AS next
      FROM pairs p SEMI JOIN best b ON b.w = p.w ANTI JOIN joined g ON g.w = p.w AND g.gone = p.pos LEFT JOIN joined j ON j.w = p.w AND j.spot = p.pos
      WHERE p.round < $rounds
    )
    SELECT k.round, k.w, k.pos, k.id, k.after, coalesce(n.merged, k.next) FROM kept k LEFT JOIN joined n ON n.w = k.w AND n.spot = k.after
  )
)
SELECT w, pos, id, after, next, last FROM (SELECT *, max(round) OVER (PARTITION BY w) AS last FROM step) WHERE round = last ORDER BY w, pos
"""
_DECODE = "SELECT t.d AS d, array_to_string(list(v.piece ORDER BY t.pos), '') AS body FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY t.d"


class ByteBpe:
    """path: the file of ranks; pattern: how texts are cut before they are encoded."""

    def __init__(self, path: str, pattern: str, remember: int = KNOWN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        ranks = self.ranks
        cuts = np.fromiter((x for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks for x in (ranks[t[:k]], ranks[t[k:]], r)), np.int32).reshape(-1, 3)
        self.merges = pa.table({"a": cuts[:, 0].copy(), "b": cuts[:, 1].copy(), "merged": cuts[:, 2].copy()})
        self.beside = np.zeros((256, 256), bool)
        for t in ranks:
            b = np.frombuffer(t, np.uint8)
            self.beside[b[:-1], b[1:]] = True
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY}MB", "allocator_flush_threshold": "4MB", "allocator_bulk_deallocation_flush_threshold": "4MB"})
        self.db.register("merges_in", self.merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.unregister("merges_in")
        self.db.execute("CREATE TABLE lows AS SELECT * FROM merges WHERE merged < greatest(a, b)")
        # a byte stands as the code point of its number, so that ordered string aggregation joins bytes
        pieces = pa.table({"id": np.array(list(ranks.values()), np.int32), "piece": [t.decode("latin-1") for t in ranks]})
        self.db.register("vocabulary_in", pieces)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")
        self.db.unregister("vocabulary_in")
        self.remember, self.known, self.old = remember, {}, {}

    def parts(self, data: bytes) -> list[bytes]:
        """data, split where no token can span."""
        b = np.frombuffer(data, np.uint8)
        edges = [0, *(np.flatnonzero(~self.beside[b[:-1], b[1:]]) + 1).tolist(), len(data)]
        return [data[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]

    def _long(self, data: bytes) -> bytes:
        """The ids of one part."""
        pos, ids = np.arange(len(data), dtype=np.int64), self.single[np.frombuffer(data, np.uint8)]
        state = pa.table({"w": np.zeros(len(data), np.int32), "pos": pos, "id": ids, "after": pa.array([*range(1, len(data)), None], pa.int64()), "next": pa.array([*ids[1:].tolist(), None], pa.int32())})
        self.db.execute(f"SET memory_limit = '{MEMORY + len(data) * LONG_BYTES // 1_000_000}MB'")
        while True:
            rounds = max(4, LONG_ROWS // len(state))
            self.db.register("state", state)
            state = self.db.sql(_CONTRACT_LONG, params={"rounds": rounds}).to_arrow_table()
            self.db.unregister("state")
            if state["last"][0].as_py() < rounds:
                self.db.execute(f"SET memory_limit = '{MEMORY}MB'")
                return state["id"].to_numpy().astype("<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Puts the ids of words in known."""
        data = {w: w.encode("utf-8", "surrogatepass") for w in words}
        long = {w: self.parts(d) for w, d in data.items() if len(d) > LONG}
        short = sorted({d for w, d in data.items() if w not in long} | {p for parts in long.values() for p in parts if len(p) <= LONG})
        ids: dict[bytes, bytes] = {}
        for at in range(0, len(short), LEARNED):
            some = short[at : at + LEARNED]
            sizes = np.array([len(d) for d in some])
            starts = np.cumsum(sizes) - sizes
            w = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
            pos = (np.arange(sizes.sum()) - np.repeat(starts, sizes)).astype(np.int32)
            self.db.register("pieces", pa.table({"w": w, "pos": pos, "id": self.single[np.frombuffer(b"".join(some), np.uint8)]}))
            got = self.db.execute(_CONTRACT).fetchnumpy()
            self.db.unregister("pieces")
            edges = np.searchsorted(got["w"], np.arange(len(some) + 1))
            flat = np.asarray(got["id"]).astype("<u4").tobytes()
            ids |= {d: flat[4 * a : 4 * b] for d, a, b in zip(some, edges[:-1].tolist(), edges[1:].tolist(), strict=True)}
        for w in words:
            if w in long:
                self.known[w] = b"".join(ids[p] if len(p) <= LONG else self._long(p) for p in long[w])
            else:
                self.known[w] = ids[data[w]]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.split(t) if t else [] for t in texts]
        new = {w for words in cut for w in words if w not in self.known}
        if new and 2 * (len(self.known) + len(new)) > self.remember:
            # what was used since the last turn grows old; what was old and wasn't used goes
            self.old, self.known = self.known, {}
            new = {w for words in cut for w in words}
        if new:
            if self.old:
                again = {w: ids for w in new if (ids := self.old.get(w)) is not None}
                self.known |= again
                new -= again.keys()
            self.learn(sorted(new))
        known = self.known
        for words in cut:
            yield b"".join([known[w] for w in words])

    def decode(self, coded: list[bytes]) -> list[bytes]:
        out = [b""] * len(coded)
        start = 0
        while start < len(coded):
            end, rows = start, 0
            while end < len(coded) and (end == start or rows + len(coded[end]) // 4 <= DECODE_ROWS):
                rows += len(coded[end]) // 4
                end += 1
            sizes = np.array([len(c) // 4 for c in coded[start:end]])
            ids = np.frombuffer(b"".join(coded[start:end]), "<u4").astype(np.int32)
            table = pa.table({"d": np.repeat(np.arange(start, end, dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int32), "id": ids})
            self.db.register("tokens", table)
            for d, body in self.db.execute(_DECODE).fetchall():
                out[d] = body.encode("latin-1")
            self.db.unregister("tokens")
            start = end
        return out


_open: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str, remember: int = KNOWN) -> ByteBpe:
    """One for each worker process."""
    if (path, pattern) not in _open:
        _open[path, pattern] = ByteBpe(path, pattern)
    _open[path, pattern].remember = remember
    return _open[path, pattern]


_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Characters of the texts that are cut in pieces together.
GROUP = 1 << 20


def _code(path: str, pattern: str, remember: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path, pattern, remember)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start = 0
        while start < len(texts):
            end, size, some = start, 0, []
            while end < len(texts) and (end == start or size < GROUP):
                some.append(texts[end].as_py())
                size += len(some[-1] or "")
                end += 1
            coded = list(bpe.encode(some))
            plain = bpe.decode(coded)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, end - start), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array([hashlib.sha256(p).hexdigest() for p in plain], pa.string())],
                schema=_CODED,
            )
            start = end


def _ids(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path, pattern)
    for batch in batches:
        coded = [np.frombuffer(c, "<u4").astype(np.int32) for c in bpe.encode(batch.column(1).to_pylist())]
        offsets = np.concatenate(([0], np.cumsum([len(c) for c in coded]))).astype(np.int32)
        flat = np.concatenate(coded) if coded else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])


def token_ids(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_ids, path, pattern), "doc_id long, ids array<int>")


def digests(documents: DataFrame, path: str, pattern: str, remember: int = KNOWN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row. No shuffle. remember: pieces that a worker keeps, some 140 bytes each."""
    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_code, path, pattern, remember), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
