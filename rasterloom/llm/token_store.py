"""Token-id output: raw id shards with a minimal perfect hash index.

Documents are dealt to tasks by ranges of doc_id, and a task starts another shard once one holds SHARD_BYTES of ids or SHARD_DOCS
documents, so shard after shard holds the ids in ascending doc_id order and no shard grows with the corpus. A shard file is

    ids | doc_id of each document (i64, then its occurrence number as u32 and a null flag as u8) | hash levels | slot table |
    u64 position of the keys, levels and slots | 8 bytes magic, u32 bytes an id, u32 reserved, u64 documents, u64 ids

The hash is a cascade of bit arrays: a key that lands alone in a level's array owns its bit, the others go on to the next level; the
rank of a bit among all levels is the key's slot, so n keys fill slots 0 to n - 1. Ranks are stored for every BLOCK bits, so a lookup
counts the bits of one block at most and takes the same few probes at any size. A slot holds the document's offset and count and a
32-bit fingerprint of its key, which turns foreign keys away. The shard of a key comes from the shards' first keys (the route, one row
for each shard). Files are mapped where they are local; on any other store, ids are read by ranges.

Each task streams its documents to a file of its own attempt and renames it when it is whole, unless another attempt was first: both
hold the same bytes. Null text counts as empty and still gets the end id. Rows that repeat a doc_id keep an occurrence number, counted
in each shard from the first of them there (the route tells how many are in shards before); they may be spread over tasks, in order of
their texts' hashes. Rows with a null doc_id come first. Strings of special tokens in a text become those tokens, as the library does by
default, unless special_as_text is set. Extra columns are ignored; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, scratch, small_batches
from .near_dedup import mix

VOCABULARY = "word_bpe_49k.json"
END = 2
MAGIC = b"RLTOKID1"
HEADER = struct.Struct("<8sIIQQ")
FOOTER = struct.Struct("<QQQ")
#: Bytes of ids and documents from which a shard is full, and bytes of text for each task.
SHARD_BYTES, SHARD_DOCS, TASK_BYTES = 128 << 20, 1 << 20, 256 << 20
GAMMA = 2
LEVELS = 24
#: Bits between stored ranks.
BLOCK = 512
#: Bytes that are read at once where a file can't be mapped.
AHEAD = 4 << 20
#: Words whose ids a worker remembers, and the longest of them; some 250 bytes each.
KNOWN, KEPT = 1_300_000, 48
_KEY = np.dtype([("doc_id", "<i8"), ("occurrence", "<u4"), ("null", "u1")])
_SLOT = np.dtype([("offset", "<u8"), ("count", "<u4"), ("fingerprint", "<u4")])


def key_hashes(keys: np.ndarray) -> np.ndarray:
    ids = np.ascontiguousarray(keys["doc_id"]).view(np.uint64)
    return mix(mix(ids) + (keys["occurrence"].astype(np.uint64) << np.uint64(1)) + keys["null"].astype(np.uint64))


def _at(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(bits)).astype(np.int64)


@dataclass
class Level:
    """A bit array in 64-bit words, and the number of bits before each block, those of earlier levels among them."""

    words: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, bits: np.ndarray, base: int) -> Level:
        words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(words.reshape(-1, BLOCK // 64)).sum(1, dtype=np.uint64)
        return cls(words, np.cumsum(counts, dtype=np.uint64) - counts + np.uint64(base))

    def slots(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each bit is set, and how many are set before it."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        own = self.words[word]
        rank = self.ranks[at // BLOCK] + np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
        first = at // BLOCK * (BLOCK // 64)
        for k in range(BLOCK // 64 - 1):
            rank += np.where(first + k < word, np.bitwise_count(self.words[first + k]), 0).astype(np.uint64)
        return (own >> bit & np.uint64(1)).astype(bool), rank.astype(np.int64)


@dataclass
class PerfectHash:
    """left: the hashes that no level could place, sorted, which get the last slots."""

    levels: list[Level]
    left: np.ndarray
    placed: int

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, placed = [], 0
        while len(hashes) and len(levels) < LEVELS:
            bits = -(-max(BLOCK, GAMMA * len(hashes)) // BLOCK) * BLOCK
            at = _at(hashes, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(Level.of(alone, placed))
            placed += int(alone.sum())
            hashes = hashes[~alone[at]]
        return cls(levels, np.sort(hashes), placed)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; of a foreign key any slot, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for k, level in enumerate(self.levels):
            hit, slot = level.slots(_at(hashes[open_], k, 64 * len(level.words)))
            out[open_[hit]] = slot[hit]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.left):
            at = np.minimum(np.searchsorted(self.left, hashes[open_]), len(self.left) - 1)
            hit = self.left[at] == hashes[open_]
            out[open_[hit]] = self.placed + at[hit]
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<IIQ", len(self.levels), len(self.left), self.placed)]
        parts += [struct.pack("<Q", len(x.words)) + x.words.tobytes() + x.ranks.astype("<u8").tobytes() for x in self.levels]
        return b"".join([*parts, self.left.astype("<u8").tobytes()])

    @classmethod
    def load(cls, data: memoryview) -> PerfectHash:
        n, left, placed = struct.unpack_from("<IIQ", data)
        at, levels = 16, []
        for _ in range(n):
            (words,) = struct.unpack_from("<Q", data, at)
            blocks = words * 64 // BLOCK
            levels.append(Level(np.frombuffer(data, "<u8", words, at + 8), np.frombuffer(data, "<u8", blocks, at + 8 + 8 * words)))
            at += 8 + 8 * (words + blocks)
        return cls(levels, np.frombuffer(data, "<u8", left, at), placed)


#: White space to Python, but not to the tokenizer: a text with such is only cut at what both take for it.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_BETWEEN = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str) -> list[str]:
    return _BETWEEN.findall(text) if any(c in text for c in _SEPARATORS) else text.split()


#: How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}

#: The tokenizer always cuts between a letter or digit and such marks, and it lower-cases.
_TAIL = re.compile(r"(.*[^\W_])([.,:;!?|#$%&*]+)", re.S)


def _ends_in_letter(word: str) -> bool:
    """Also when the tokenizer has composed and lower-cased it: some letters turn into one and a mark."""
    return word[-1].isascii() or unicodedata.is_normalized("NFC", word) and word[-1].lower()[-1].isalnum()


class _Known(dict):
    """Words and their ids; a word that isn't there is encoded, and kept unless it is long."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if (m := _TAIL.fullmatch(word)) and _ends_in_letter(m[1]):
            ids = self[m[1]] + self[m[2]]
        elif word.isascii() and (low := word.lower()) != word:
            ids = self[low]
        else:
            ids = self.encode(word)
        if len(word) <= KEPT:
            self[word] = ids
        return ids


class Words:
    """Ids of a text by those of its words. The tokenizer drops white space and never looks across it, so a word's ids don't depend on its
    neighbours. A text that holds the string of an added token is left to the tokenizer as a whole."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and not (special_as_text and t.special)]
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known = _Known(self.encode_word)

    def encode_word(self, word: str) -> bytes:
        """A lower-case word of letters is one piece to the tokenizer, so its model takes it as it is; anything else goes all the way."""
        if word.isalpha() and word == word.lower() and (word.isascii() or unicodedata.is_normalized("NFC", word)):
            piece = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = [t.id for t in self.model.tokenize(piece)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return self._packed(ids)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        known, end = self.known, np.array([END], self.kind).tobytes()
        for text in texts:
            if len(known) > KNOWN:
                known.clear()
            if not text:
                yield end
            elif any(t in text for t in self.added):
                yield self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids) + end
            else:
                yield b"".join(map(known.__getitem__, cut_words(text))) + end


_open: dict[tuple[str, bool], Words] = {}


def _words(path: str, special_as_text: bool = False) -> Words:
    if (path, special_as_text) not in _open:
        _open[path, special_as_text] = Words(path, special_as_text)
    return _open[path, special_as_text]


_SHARD = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_null", pa.int32()), ("first_id", pa.int64()), ("last_null", pa.int32()), ("last_id", pa.int64()), ("n_last", pa.int64())])


class _Writer:
    """One shard on its way: ids go straight to the file, keys and counts wait for its end."""

    def __init__(self, words: Words, folder: str, name: str):
        self.words, self.uri = words, f"{folder}/{name}"
        self.store, base = fs.FileSystem.from_uri(folder)
        self.temporary, self.final = f"{base}/.attempt-{uuid.uuid4().hex}", f"{base}/{name}"
        self.store.create_dir(base, recursive=True)
        self.out = self.store.open_output_stream(self.temporary)
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, coded: bytes) -> None:
        self.out.write(coded)
        self.ids.append(doc_id)
        self.counts.append(len(coded) // self.words.width)
        self.size += len(coded)

    def full(self) -> bool:
        return self.size >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def close(self) -> dict:
        keys = np.zeros(len(self.ids), _KEY)
        keys["doc_id"], keys["null"] = [x or 0 for x in self.ids], [x is None for x in self.ids]
        # equal keys stand together: the occurrence number is the distance from the first of them
        new = np.concatenate(([True], (keys["doc_id"][1:] != keys["doc_id"][:-1]) | (keys["null"][1:] != keys["null"][:-1])))
        place = np.arange(len(keys))
        keys["occurrence"] = place - np.maximum.accumulate(np.where(new, place, 0))
        hashes = key_hashes(keys)
        perfect = PerfectHash.build(hashes)
        slots = np.zeros(len(keys), _SLOT)
        at = perfect.slots(hashes)
        n = np.array(self.counts, np.uint64)
        slots["offset"][at], slots["count"][at], slots["fingerprint"][at] = np.cumsum(n) - n, n, (mix(hashes) >> np.uint64(32)).astype(np.uint32)
        places, position = [], self.size
        for part in (keys.tobytes(), perfect.dump(), slots.tobytes()):
            places.append(position)
            self.out.write(part)
            position += len(part)
        self.out.write(FOOTER.pack(*places))
        self.out.write(HEADER.pack(MAGIC, self.words.width, 0, len(keys), int(n.sum())))
        self.out.close()
        if self.store.get_file_info(self.final).type == fs.FileType.NotFound:
            self.store.move(self.temporary, self.final)
        else:
            self.store.delete_file(self.temporary)
        first, last = keys[0], keys[-1]
        ends = {"first_null": int(not first["null"]), "first_id": int(first["doc_id"]), "last_null": int(not last["null"]), "last_id": int(last["doc_id"])}
        return {"path": self.uri, "n_docs": len(keys), "n_ids": int(n.sum()), "n_last": int(last["occurrence"]) + 1, **ends}


def _write(tokenizer_path: str, special_as_text: bool, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _words(tokenizer_path, special_as_text)
    part, shard, held = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        for doc_id, coded in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
            held = held or _Writer(words, folder, f"shard-{part:06d}-{shard:05d}.ids")
            held.add(doc_id, coded)
            if held.full():
                yield pa.RecordBatch.from_pylist([{"part": part, "shard": shard, **held.close()}], schema=_SHARD)
                shard, held = shard + 1, None
    if held:
        yield pa.RecordBatch.from_pylist([{"part": part, "shard": shard, **held.close()}], schema=_SHARD)


class Shard:
    """A shard file, mapped where the store allows it. Elsewhere its index is read, which SHARD_DOCS bounds, and ids as they are asked for."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        if isinstance(store, fs.LocalFileSystem):
            self.data, self.size = memoryview(np.memmap(name, np.uint8, "r")), None
        else:
            self.file = store.open_input_file(name)
            self.data, self.size = None, self.file.size()
        end = self.size if self.data is None else len(self.data)
        self.held: tuple[int, memoryview] = (0, memoryview(b""))
        tail = self.span(end - HEADER.size - FOOTER.size, HEADER.size + FOOTER.size)
        magic, self.width, _, self.n_docs, self.n_ids = HEADER.unpack(tail[FOOTER.size :])
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a shard of token ids")
        self.key_place, levels, slots = FOOTER.unpack(tail[: FOOTER.size])
        self.hash = PerfectHash.load(self.span(levels, slots - levels))
        self.slots = np.frombuffer(self.span(slots, self.n_docs * _SLOT.itemsize), _SLOT)

    def span(self, start: int, size: int, ahead: int = 0) -> memoryview:
        """Bytes of the file; ahead: how many may be read at once, for what follows."""
        if self.data is not None:
            return self.data[start : start + size]
        at, held = self.held
        if start < at or start + size > at + len(held):
            at, held = start, memoryview(self.file.read_at(min(max(size, ahead), self.size - start), start))
            if ahead:
                self.held = at, held
        return held[start - at : start - at + size]

    def keys(self, start: int, count: int) -> np.ndarray:
        """Keys by place in the file."""
        count = min(count, self.n_docs - start)
        return np.frombuffer(self.span(self.key_place + start * _KEY.itemsize, count * _KEY.itemsize), _KEY)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, the offset of its first id and its number of ids."""
        hashes = key_hashes(keys)
        at = self.hash.slots(hashes)
        slot = self.slots[np.maximum(at, 0)] if self.n_docs else np.zeros(len(keys), _SLOT)
        there = (at >= 0) & (slot["fingerprint"] == (mix(hashes) >> np.uint64(32)).astype(np.uint32))
        return there, slot["offset"].astype(np.int64), slot["count"].astype(np.int64)

    def ids(self, offset: int, count: int, ahead: int = 0) -> np.ndarray:
        return np.frombuffer(self.span(offset * self.width, count * self.width, ahead), f"<u{self.width}")


@dataclass(frozen=True)
class Route:
    """A shard: its first key (null ids have known = 0 and come first), how many rows of that id are in shards before, and how many ids."""

    path: str
    known: int
    first_id: int
    occurrences: int
    ids: int


class TokenStore:
    """Keyed access to the shards, in order."""

    def __init__(self, route: list[Route]):
        self.route = route
        self.first = [(r.known, r.first_id, r.occurrences) for r in route]
        self._shards: dict[int, Shard] = {}

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document with its end id, or None."""
        known = int(doc_id is not None)
        k = bisect_right(self.first, (known, doc_id or 0, occurrence)) - 1
        if k < 0:
            return None
        if k not in self._shards:
            self._shards[k] = Shard(self.route[k].path)
        shard, at = self._shards[k], self.route[k]
        key = np.zeros(1, _KEY)
        key["doc_id"], key["null"] = doc_id or 0, not known
        key["occurrence"] = occurrence - (at.occurrences if (at.known, at.first_id) == (known, doc_id or 0) else 0)
        there, offset, count = shard.find(key)
        return shard.ids(int(offset[0]), int(count[0])) if there[0] else None


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def routed(rows: list) -> list[Route]:
    """From what the tasks told of their shards, in order."""
    out, ids, last, same = [], 0, None, 0
    for r in sorted(rows, key=lambda r: (r["part"], r["shard"])):
        first = (r["first_null"], r["first_id"])
        before = same if first == last else 0
        out.append(Route(r["path"], *first, before, ids))
        ids, last = ids + r["n_ids"], (r["last_null"], r["last_id"])
        same = r["n_last"] + (before if first == last else 0)
    return out


def write_store(documents: DataFrame, tokenizer_path: str, folder: str, special_as_text: bool = False) -> list[Route]:
    """Writes the shards and returns their route: one row for each shard, which is all that reaches the driver.

    Texts are shuffled once, by range of doc_id (rows with one doc_id by their hash), to as many tasks as the session has shuffle
    partitions, or more if a task got more than TASK_BYTES of text; the ids are never shuffled.
    """
    spark = documents.sparkSession
    small_batches(spark)
    size = documents.agg(F.sum(F.octet_length("text").cast("long")).alias("size")).first()["size"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = named.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    schema = "part long, shard long, path string, n_docs long, n_ids long, first_null int, first_id long, last_null int, last_id long, n_last long"
    # written, so that the shards are made once
    told = cut(dealt.mapInArrow(partial(_write, tokenizer_path, special_as_text, folder), schema), "shards")
    out = routed(told.collect())
    release(told)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(path)
            for at in range(0, shard.n_docs, 8192):
                keys = shard.keys(at, 8192)
                there, offset, count = shard.find(keys)
                if not there.all():
                    raise ValueError(f"{path}: the index lacks keys")
                crc = [zlib.crc32(shard.ids(o, n, AHEAD).astype("<u4").tobytes()) for o, n in zip(offset.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys["doc_id"], pa.int64(), mask=keys["null"].astype(bool)), pa.array(offset + before), pa.array(count), pa.array(crc, pa.int64())], schema=_READ)


def read_store(spark, route: list[Route]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, each looked up by its key."""
    small_batches(spark)
    return spark.createDataFrame([(r.path, r.ids) for r in route], "path string, before long").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return read_store(spark, write_store(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), scratch(spark, "tokens")))
