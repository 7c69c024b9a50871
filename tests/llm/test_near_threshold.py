import random

import numpy as np

import corpus_pipeline as C
from rasterloom.llm import near_dedup as N

from .test_near_dedup import shingles, variants


def kept_ids(rows, per_cent):
    """The smallest id of each component, by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d for d in sets if find(d) == d}


def test_plans():
    a, b = N.Plan(85), N.Plan(80)
    assert (a.bands, a.rows, a.registers, a.floor) == (44, 8, 353, 0.75)
    for p in (a, b):
        assert (1 - (p.per_cent / 100) ** p.rows) ** p.bands <= 1e-6 and p.bands <= 64


def test_recall_of_the_bands_at_80():
    """Pairs right at 0.8 share a band and pass the floor."""
    r, plan = np.random.default_rng(2), N.Plan(80)
    for n in (60, 400, 2000):
        for _ in range(60):
            pool = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            k = n // 9
            a, b = N.registers(pool[:n], plan), N.registers(pool[k : n + k], plan)
            assert (N.band_hashes(a, plan) == N.band_hashes(b, plan)).any()
            assert N.likely((a > b).sum(keepdims=True), (a < b).sum(keepdims=True), n, np.array([float(n)]), plan)[0]


def test_the_stage_drops_copies_from_80_per_cent(spark):
    r = random.Random(4)
    rows = []
    for _ in range(40):  # one to four of 120 words replaced: similarities on both sides of 0.80 and 0.85
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        own = list(base)
        for i in r.sample(range(120), r.randint(1, 4)):
            own[i] = f"x{r.randrange(10**6)}"
        rows += [" ".join(base), " ".join(own)]
    rows = list(enumerate([*rows, *variants(5, 20, 90, (0, 3))]))
    want = kept_ids(rows, 80)
    assert len(want) < len(kept_ids(rows, 85)) and len(want) > 20
    got = C.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {x["doc_id"] for x in got.collect()} == want
