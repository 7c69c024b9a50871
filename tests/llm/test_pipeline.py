import hashlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline as C
from rasterloom.llm import byte_bpe, decontaminate, toxicity

from .test_exact_dedup import white
from .test_near_threshold import kept_ids


def test_stages():
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "byte_bpe"]


def test_run_equals_brute_force(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    machine = model.machine()
    rows = {d: t for d, t in rows.items() if model.score([toxicity.features(t, machine)[0]])[0] < toxicity.THRESHOLD}
    assert len(rows) < 200
    groups = defaultdict(list)
    for d, t in rows.items():
        groups[white(t)].append(d)
    rows = {d: rows[d] for d in map(min, groups.values())}
    rows = {d: rows[d] for d in kept_ids(list(rows.items()), C.NEAR)}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # without seeds: every pair of equal tokens in SQL
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": list(rows), "text": list(rows.values())}))
    c.register("benchmark", pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}))
    found = {r[0] for r in c.execute(decontaminate.ORACLE).fetchall()}
    assert found
    ranks = byte_bpe.tokenizer(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d, len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows.items() if d not in found)
    got = sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in C.run(spark, sf).collect())
    assert got == want


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_edges(spark, edges, empty, sf, name):
    stage = dict(C.STAGES)[name]
    got = stage(spark, edges, sf)
    if name != "byte_bpe":
        assert got.schema == edges.schema
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    if name == "exact_dedup":
        # nothing (1, 2 and a null id), white space, the ten words (4 to 6), and one of the two long texts
        assert sorted(i for i in ids if i is not None) == [1, 3, 4, 7, 7, 8, 10, 11, 12] and ids.count(None) == 1
    elif name == "near_dedup":
        assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 7, 7, 8, 10, 11, 12] and ids.count(None) == 2
    else:
        assert len(ids) == edges.count()
    assert stage(spark, empty, sf).collect() == []


@pytest.mark.parametrize("name", ["exact_dedup", "near_dedup"])
def test_decisions_are_made_row_by_row(spark, name):
    """A row goes or stays for its own text, whatever other rows with its doc_id are."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a, "x"), (7, a, "y"), (7, b, "z"), (None, b, "u"), (None, c, "v"), (None, c, "w"), (9, None, "t"), (9, None, "t")], "doc_id long, text string, row_raw string")
    got = sorted(((r["doc_id"], r["text"]) for r in dict(C.STAGES)[name](spark, docs, "").collect()), key=repr)
    empty = [(9, None)] * (1 if name == "exact_dedup" else 2)
    assert got == sorted([(1, a), (7, b), (None, c), *empty], key=repr)


def test_decontamination_judges_every_row(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(1, f"before {item} after"), (1, "a clean text"), (None, item), (None, "another clean text"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, C.decontaminate(spark, docs, sf).collect()), key=repr)
    assert got == sorted([(1, "a clean text"), (None, "another clean text"), (2, None)], key=repr)
