"""URL filters by a sorted digest array.

A rule is a host and a path prefix, such as example.net/en/, with block or allow. The rules' keys are hashed with 64-bit xxhash and
kept as one sorted array of digests beside the keys' verdicts and full strings, in a file of the shared folder that workers map into
memory; where the store can't be mapped, a worker maps a copy that it makes once and that has no name. A URL's keys are its host and all its parent domains, each with the prefixes of its path in the lengths that the rules have; all keys of a batch
are probed by one vectorised binary search, and a hit counts only if the stored string is the key, so a colliding digest decides
nothing. The longest rule that fits wins, of equally long ones that with the longer host; without one the filter's default holds (allow).

The host runs from after the first :// to the next slash, question mark, hash or the end, A-Z lower-cased; the path from there to a
question mark, hash or the end. A null url or one without :// has an empty host and path and fits no rule. Rows with a null or
repeated page_id are judged one by one. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches

#: The rules of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT = "allow"
MAGIC = b"RLURLSET"
HEADER = struct.Struct("<8sQQQ")  # then the number of rules, bytes of their keys, and how many lengths their paths have
COPY = 4 << 20
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


def build(rules: Iterable[tuple[str, str]]) -> bytes:
    """The array as a file: header, lengths, digests in order, where each key ends, verdicts, keys. A rule that comes twice keeps its last verdict."""
    last = {key.partition("/")[0].translate(_LOWER) + "/" + key.partition("/")[2]: verdict for key, verdict in rules}
    order = sorted((digest(k), k) for k in last)
    blobs = [k.encode("utf-8", "surrogatepass") for _, k in order]
    ends = np.cumsum([len(b) for b in blobs], dtype=np.uint64) if blobs else np.empty(0, np.uint64)
    text = b"".join(blobs)
    lengths = sorted({len(k.partition("/")[2]) + 1 for k in last})
    return HEADER.pack(MAGIC, len(order), len(text), len(lengths)) + np.array(lengths, "<u8").tobytes() + np.array([d for d, _ in order], "<u8").tobytes() + ends.astype("<u8").tobytes() + bytes(last[k] == "block" for _, k in order) + text


@dataclass
class DigestArray:
    digests: np.ndarray
    ends: np.ndarray
    blocks: np.ndarray
    text: np.ndarray
    lengths: list[int]  # of the rules' paths

    @classmethod
    def open(cls, path: str) -> DigestArray:
        store, name = fs.FileSystem.from_uri(path)
        if isinstance(store, fs.LocalFileSystem):
            data = np.memmap(name, np.uint8, "r")
        else:
            with store.open_input_stream(name) as f, tempfile.TemporaryFile() as own:
                while piece := f.read(COPY):
                    own.write(piece)
                own.flush()
                data = np.memmap(own, np.uint8, "r")  # lasts after the file is closed
        magic, n, size, lengths = HEADER.unpack(bytes(data[: HEADER.size]))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a digest array")
        view = lambda kind, count, start: np.ndarray(count, kind, data, start)
        at = HEADER.size + 8 * lengths
        return cls(view("<u8", n, at), view("<u8", n, at + 8 * n), view("u1", n, at + 16 * n), view("u1", size, at + 17 * n), view("<u8", lengths, HEADER.size).tolist())

    def key(self, i: int) -> str:
        start = int(self.ends[i - 1]) if i else 0
        return self.text[start : int(self.ends[i])].tobytes().decode("utf-8", "surrogatepass")

    def find(self, keys: list[str]) -> np.ndarray:
        """The place of each key, or -1."""
        wanted = np.array([digest(k) for k in keys], np.uint64)
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests):
            return out
        at = np.searchsorted(self.digests, wanted)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:
                if self.key(j) == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out


def split(url: str | None) -> tuple[str, str]:
    """Host and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:cut]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def judge(array: DigestArray, urls: list[str | None], default: str = DEFAULT) -> list[tuple[str, str, str | None, str]]:
    """host, path, rule and verdict of each url."""
    parts = [split(u) for u in urls]
    keys, owner = [], []
    for i, (host, path) in enumerate(parts):
        if not host or not path:
            continue
        labels = host.split(".")
        for k in range(len(labels)):
            domain = ".".join(labels[k:])
            for n in array.lengths:
                if n <= len(path):
                    keys.append(domain + path[:n])
                    owner.append(i)
    best: dict[int, int] = {}
    for i, j in zip(owner, array.find(keys).tolist(), strict=True):
        if j >= 0 and (i not in best or len(array.key(j)) > len(array.key(best[i]))):
            best[i] = j
    return [(host, path, array.key(best[i]), "block" if array.blocks[best[i]] else "allow") if i in best else (host, path, None, default) for i, (host, path) in enumerate(parts)]


_open: dict[str, DigestArray] = {}


def _array(path: str) -> DigestArray:
    """One for each worker process, the last used."""
    if path not in _open:
        _open.clear()
        _open[path] = DigestArray.open(path)
    return _open[path]


def _judge(path: str, default: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    array = _array(path)
    for batch in batches:
        rows = judge(array, batch.column(1).to_pylist(), default)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in range(4))], schema=_JUDGED)


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row. No shuffle; the array is one file in the shared folder."""
    spark = pages.sparkSession
    small_batches(spark)
    path = scratch(spark, "urls")
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as f:
        f.write(build(rules))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(partial(_judge, path, default), "page_id long, host string, path string, rule string, verdict string")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
told AS (SELECT *, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM part)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM told
"""
