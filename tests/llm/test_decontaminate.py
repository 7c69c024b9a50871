import itertools
import random
import re

import pytest

from rasterloom.llm import decontaminate as D

from .conftest import LONG

tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    """All diagonals of all pairs, whatever the masks."""
    out, classes = {}, {}
    for i, item in items:
        if i is not None and tokens(item):
            classes.setdefault(tuple(tokens(item)), []).append(i)
    for d, text in docs:
        a = tokens(text)
        for b, ids in classes.items():
            w = min(D.WINDOW, len(b))
            for g in range(-len(b) + 1, len(a)):
                eq = [0 <= k + g < len(a) and a[k + g] == b[k] for k in range(len(b))]
                if d is not None and any(100 * sum(eq[s : s + w]) >= D.SIMILARITY * w for s in range(len(b) - w + 1)):
                    key = (d, min(ids))
                    out[key] = (len(b), max(sum(eq), out.get(key, (0, 0))[1]), len(ids))
    return {(*k, *v) for k, v in out.items()}


def sample():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((40, 20, 15, 13, 9, 8, 7, 6, 5, 4, 0))]
    items += [(90, items[3][1]), (91, items[8][1])]
    docs = []
    for k in range(40):
        words = [word() for _ in range(r.randint(0, 60))]
        if k % 2:
            copy = tokens(items[k % 10][1])
            for _ in range(r.randint(0, len(copy) // 4)):
                copy[r.randrange(len(copy))] = "zz" + word()
            at = r.randrange(len(words) + 1)
            words[at:at] = copy[: r.choice((len(copy), len(copy), len(copy) // 2))]
        docs.append((k, r.choice((" ", ", ", "\n")).join(words).title()))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = sample()
    got = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert set(map(tuple, got.collect())) == want and len(want) > 10


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    test_equals_brute_force(spark)


def test_no_allowed_substitution_hides_a_copy():
    """For every length of a window or whole item, every set of places that may differ leaves a mask of that length intact, and a gram with it."""
    for n in range(1, D.WINDOW + 1):
        spare = n - -(-D.SIMILARITY * n // 100)
        for gone in itertools.combinations(range(n), spare):
            # a window of a longer item is served by the masks of long items
            for length in {n, D.WINDOW} if n >= D.LONG else {n}:
                laid = [s for m in D.masks_of(length) for s in range(n - len(m) + 1) if not any(s <= g < s + len(m) and m[g - s] == "1" for g in gone)]
                assert laid, (n, gone)
                assert all(any(not set(gone) & {s + p for p in places} for places in D.grams_of(length)) for s in laid)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 14, 30])
def test_short_items_with_a_substitution(spark, n):
    words = [f"w{k}x" for k in range(n)]
    docs = [(0, "before " + " ".join(words) + " after")]
    docs += [(1 + k, "before " + " ".join([*words[:k], "other", *words[k + 1 :]])) for k in range(n)]
    got = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(words))], "item_id long, text string"))
    assert set(map(tuple, got.collect())) == brute(docs, [(5, " ".join(words))])


def test_a_full_bitmap_hides_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "BITMAP_WORDS", 1)
    test_equals_brute_force(spark)


def test_edges(spark, edges, empty):
    items = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "one two three four five six seven eight nine ten", 1), (3, "one two three four five six seven eight nine ten", 1), (None, LONG[:400], 1), (5, LONG[:400], 1)], "item_id long, text string, seed int")
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(edges, items).collect()}
    assert got == {(4, 3), (5, 3), (6, 3), (8, 5), (9, 5)}
    assert D.overlaps(empty, items).collect() == [] and D.overlaps(edges, items.where("false")).collect() == []


def test_query(same_as_sql):
    same_as_sql("op7_decontaminate")
