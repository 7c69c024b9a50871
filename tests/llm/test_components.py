import random

from rasterloom.llm.common import components


def test_chains_stars_and_rings(spark):
    r = random.Random(4)
    edges = [(i + 1, i) for i in range(60)] + [(200 + i, 200) for i in range(1, 150)] + [(400 + (i + 1) % 9, 400 + i) for i in range(9)]
    edges += [(500 + r.randrange(80), 500 + r.randrange(80)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")
    got = {x["node"]: x["root"] for x in components(df).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
