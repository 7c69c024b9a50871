import hashlib
import re
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import exact_dedup as E

from .conftest import EDGES

white = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@given(st.binary(max_size=3 * E.CHUNK), st.binary(max_size=50))
def test_fingerprints_combine(a, b):
    assert E.combine(E.fingerprint(a), E.fingerprint(b), len(b)) == E.fingerprint(a + b)


@given(st.text(alphabet=" \t\nab ", max_size=60), st.integers(1, 9))
def test_pieces_are_the_normalised_text(text, size):
    assert "".join(E.chunks(text, size)) == white(text) == E.normalise(text)


def test_same():
    assert E.same("a  b", "a\nb") and E.same(None, "") and not E.same("a b", "ab") and not E.same("a", "a ")
    assert E.same("x " * 200000, "x\t" * 200000) and not E.same("x " * 200000, "x " * 199999 + "y ")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[white(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[white(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(white(r[1]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edges(edges, empty):
    assert sorted(map(tuple, E.exact_groups(edges).drop("raw").collect()), key=repr) == expected(EDGES)
    assert E.exact_groups(empty).collect() == []


def test_colliding_fingerprints_are_told_apart(edges, monkeypatch):
    """All texts get one fingerprint; the comparison must still find the groups."""
    real = E.fingerprints
    monkeypatch.setattr(E, "fingerprints", lambda d: real(d).withColumn("fp", F.lit(1).cast("long")).withColumn("n_bytes", F.lit(1).cast("long")))
    assert sorted(map(tuple, E.exact_groups(edges).drop("raw").collect()), key=repr) == expected(EDGES)


def test_rows_without_an_id_are_compared(spark, monkeypatch):
    real = E.fingerprints
    monkeypatch.setattr(E, "fingerprints", lambda d: real(d).withColumn("fp", F.lit(1).cast("long")).withColumn("n_bytes", F.lit(1).cast("long")))
    rows = [(None, "a b"), (None, "a  b"), (None, "c"), (3, "c"), (3, "d"), (3, "d")]
    got = E.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).drop("raw")
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_shuffled_joins_give_the_same(edges, monkeypatch):
    """As with more groups than may be broadcast."""
    monkeypatch.setattr(E, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, E.exact_groups(edges).drop("raw").collect()), key=repr) == expected(EDGES)


def test_query(same_as_sql):
    same_as_sql("op8_exact_dedup")
