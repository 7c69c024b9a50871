import random
import re

import numpy as np
import pytest

from rasterloom.llm import near_dedup as N

from .conftest import EDGES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Component of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        root = min((x for x in ids if x is not None), default=None)
        out.append((doc, len(sets[i]), root, doc == root))
    return sorted(out, key=repr)


def variants(seed, copies, words, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    for _ in range(copies):
        own = list(base)
        for _ in range(r.randint(*edits)):
            own[r.randrange(words)] = f"x{r.randrange(10**6)}"
        yield " ".join(own)


def test_shingle_sets_match_words():
    texts = [None, "", " \n", "a", "A a", "a b c d e", "a b c d e f a b c d e", "É é É", "x" * (N.PIECE + 5) + " y " + "z w " * 400000, *(t for _, t, *_ in EDGES)]
    for text, items in zip(texts, N.shingle_sets(texts), strict=True):
        assert len(items) == len(shingles(text))
        assert (np.diff(items.astype(object)) > 0).all()
    a, b = N.shingle_sets(["a b c d e f", "q A B C D E f"])
    assert len(np.intersect1d(a, b)) == 2


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for n in (1, 5, 200, 3000):
        a, b = pool[:n], pool[n // 3 : n + n // 3]
        assert (np.maximum(N.registers(a), N.registers(b)) == N.registers(np.union1d(a, b))).all()
    a, b = pool[:1000], pool[80:1080]  # a similarity of 0.852
    x, y = N.registers(a), N.registers(b)
    assert abs((x == y).mean() - 920 / 1080) < 0.08
    one = np.array([1000.0])
    tell = lambda p, q: N.likely((p > q).sum(keepdims=True), (p < q).sum(keepdims=True), 1000, one)[0]
    assert tell(x, y) and not tell(x, N.registers(pool[500:1500]))


def test_recall_of_the_bands():
    """Pairs right at the threshold share a band."""
    r = np.random.default_rng(2)
    for n in (60, 400, 2000):
        for _ in range(60):
            pool = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            k = int(n * 0.081)
            a, b = N.registers(pool[:n]), N.registers(pool[k : n + k])
            assert (N.band_hashes(a) == N.band_hashes(b)).any()


def test_recall_for_small_sets():
    """Of sets of 7 to 40 shingles that are linked."""
    r = np.random.default_rng(6)
    for n in range(7, 41):
        k = n * 15 // 185  # the most that may differ on either side
        for _ in range(40):
            pool = r.integers(0, 1 << 63, n + k, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[k:])
            assert N.PLAN.linked(a, b)
            x, y = N.registers(a), N.registers(b)
            assert (N.band_hashes(x) == N.band_hashes(y)).any()
            assert N.likely((x > y).sum(keepdims=True), (x < y).sum(keepdims=True), n, np.array([float(n)]))[0]


@pytest.mark.parametrize("block, group", [(N.BLOCK, N.GROUP), (N.BLOCK, 1), (16, 1), (16, 20)])
def test_groups_equal_brute_force(spark, monkeypatch, block, group):
    """As neighbourhoods, bucket by bucket, and with one of more members than a block, linked through chains."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "GROUP", group)
    monkeypatch.setattr(N, "STAR", block)
    texts = [*variants(1, 90, 120, (0, 4)), *variants(2, 30, 60, (1, 6)), *variants(3, 5, 300, (0, 2)), "", "a b", "a b", "A b", "a b c"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).drop("group_key", "raw")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    """As with more classes than may be broadcast."""
    monkeypatch.setattr(N, "BROADCAST_ROWS", -1)
    rows = list(enumerate([*variants(1, 40, 120, (0, 4)), *variants(2, 20, 60, (1, 6)), "a b", "a b"]))
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).drop("group_key", "raw")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_rows_without_an_id(spark):
    """Linked like all others; a component of nothing else has a key, but no id."""
    one, two, three = (list(variants(k, 2, 200, (0, 1))) for k in (31, 32, 33))
    rows = [(None, one[0]), (4, one[1]), (None, two[0]), (None, two[1]), (None, three[0]), (None, three[0]), (None, ""), (None, None)]
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.drop("group_key", "raw").collect()), key=repr) == brute(rows)
    keys = [r["group_key"] for r in got.where("group_key IS NOT NULL").collect()]
    assert len(keys) == 6 and sorted(map(keys.count, set(keys))) == [2, 2, 2]


def test_one_id_with_several_texts(spark):
    """Links of every text count, whatever order rows come in."""
    groups = [list(variants(k, 2, 200, (0, 1))) for k in range(12)]
    rows = [(5, a) for a, _ in groups] + [(100 + k, b) for k, (_, b) in enumerate(groups)] + [(5, groups[0][0])]
    for some in (rows, rows[::-1]):
        got = N.near_groups(spark.createDataFrame(some, "doc_id long, text string")).collect()
        assert {r["component_id"] for r in got} == {5} and sum(r["kept"] for r in got) == 13


def test_edges(edges, empty):
    rows = [(r[0], r[1]) for r in EDGES if r[0] != 7]
    got = N.near_groups(edges.where("doc_id IS NULL OR doc_id <> 7"))
    assert sorted(((a, b, c, d) for a, b, c, d, *_ in got.collect()), key=repr) == brute(rows)
    seven = N.near_groups(edges.where("doc_id = 7")).collect()
    assert [(r["component_id"], r["kept"]) for r in seven] == [(7, True)] * 2
    assert N.near_groups(empty).collect() == []


def test_query(same_as_sql):
    same_as_sql("op3_near_dedup")
