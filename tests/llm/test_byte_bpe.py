import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import byte_bpe as B

from .conftest import EDGES, LONG

PATH, PATTERN = public_tokenizers.path(B.RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    return B.tokenizer(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids(library, text):
    return np.array(library.encode_ordinary(text or ""), "<u4").tobytes()


@given(st.lists(st.text(max_size=80), max_size=6))
@settings(max_examples=40, deadline=None)
def test_any_text_as_the_library(bpe, library, texts):
    coded = list(bpe.encode(texts))
    assert coded == [ids(library, t) for t in texts]
    assert bpe.decode(coded) == [t.encode() for t in texts]


def test_long_pieces_and_texts(bpe, library):
    texts = ["a" * 3000, "ab" * 400, "0123456789" * 60, " " * 900 + "x", "=" * 300, "日本語のテキスト" * 50, LONG, "<|endoftext|>", "aaaaaaaab" * 31, "ab" * 5000 + "ba" * 5000, "x" * 70000, "haha" * 3000 + "ha", "einsein" * 900]
    texts += ["".join(random.Random(k).choice(letters) for _ in range(4000)) for k, letters in enumerate(("acgt", "aA", "abcdefghijklmnopqrstuvwxyz", "in", "the", "ßäü日本"))]
    assert list(bpe.encode(texts)) == [ids(library, t) for t in texts]


def test_both_ways_of_contracting_agree(bpe):
    for w in ("bcbcbc", "aaaaaaa", "ungewöhnlich", " Donaudampfschiff", "ababababa" * 9):
        data = w.encode()
        bpe.known.pop(w, None)
        bpe.learn([w])
        assert bpe.known[w] == bpe._long(data)


@given(st.text(alphabet="aábehinorstl ", min_size=1, max_size=200))
@settings(max_examples=60, deadline=None)
def test_contracting_many_places_at_once_is_contracting_one_by_one(bpe, library, text):
    """Of a string that the pattern wouldn't keep in one piece, too."""
    assert bpe._long(text.encode()) == np.array(library._core_bpe.encode_single_piece(text.encode()), "<u4").tobytes()


def test_places_that_no_token_spans(bpe, library):
    for text in ("日本語のテキスト" * 50, "acgt" * 300, "zzqqxjkv" * 20):
        parts = bpe.parts(text.encode())
        assert b"".join(parts) == text.encode() and len(parts) > 1
        assert sum((library._core_bpe.encode_single_piece(p) for p in parts), []) == library._core_bpe.encode_single_piece(text.encode())


def test_a_long_piece_in_few_rounds_at_a_time(bpe, library, monkeypatch):
    monkeypatch.setattr(B, "LONG_ROWS", 1)
    text = "in" * 300 + "ni" * 300
    bpe.known.pop(text, None)
    bpe.old.pop(text, None)
    assert list(bpe.encode([text])) == [ids(library, text)]


def test_forgetting_changes_nothing(bpe, library, monkeypatch):
    monkeypatch.setattr(bpe, "remember", 8)
    texts = ["one two three four", "five six seven", "one two", "two eight nine", "", "one two three four five six seven eight nine ten", "two"]
    for _ in range(3):
        assert [list(bpe.encode([t]))[0] for t in texts] == [ids(library, t) for t in texts]
        assert len(bpe.known) <= 12


def test_decoding_in_parts(bpe, monkeypatch):
    monkeypatch.setattr(B, "DECODE_ROWS", 4)
    texts = ["", "a b c d e f g", "x", "", "y z"]
    assert bpe.decode(list(bpe.encode(texts))) == [t.encode() for t in texts]


def test_edges(edges, empty, library):
    got = sorted(map(tuple, B.digests(edges, PATH, PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(((r[0], len(ids(library, r[1])) // 4, sha(ids(library, r[1])), sha((r[1] or "").encode())) for r in EDGES), key=repr)
    assert got == want
    assert B.digests(empty, PATH, PATTERN).collect() == [] and B.token_ids(empty, PATH, PATTERN).collect() == []


def test_token_ids(edges, library):
    assert all(r["ids"] == library.encode_ordinary(dict((a, b) for a, b, *_ in EDGES)[r["doc_id"]] or "") for r in B.token_ids(edges.where("doc_id IN (1, 4, 11)"), PATH, PATTERN).collect())


def test_query_round_trip(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in B.op9_byte_bpe(spark, sf).collect():
        assert r["ids_sha256"] == hashlib.sha256(ids(library, texts[r["doc_id"]])).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
