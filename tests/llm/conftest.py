import duckdb
import pytest

#: doc_id, text, lang, source, and columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket string, gone int, seed int, rep int, score string, found int, rid int, count int"
LONG = "lorem ipsum dolor sit amet consectetur " * 6000
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, None),
    (4, "one two three four five six seven eight nine ten", "en", "a"),
    (5, "one two three four five six seven eight nine ten", "en", "b"),
    (5, "one two three four five six seven eight nine ten", "en", "b"),
    (6, "one  two\nthree four five six seven eight nine ten", "en", "b"),
    (7, "short", "en", "b"),
    (7, "another text under the same id", "de", "b"),
    (None, "a row without an id", "en", None),
    (None, None, None, None),
    (8, LONG, "la", "c"),
    (9, LONG, "la", "c"),
    (10, "x" * 70000, "en", "c"),
    (11, "naïve café 日本語 🙂 ñ́", "fr", "c"),
    (12, "😀" * 300, "", ""),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    return spark.createDataFrame([(*r, 1, 2, "b", 3, 4, 5, "s", 6, 7, 8) for r in EDGES], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sql(sf):
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def run(query):
        r = c.execute(query)
        names = [d[0] for d in r.description]
        return [dict(zip(names, x, strict=True)) for x in r.fetchall()]

    return run


@pytest.fixture(scope="session")
def same_as_sql(spark, sf, sql):
    def check(name):
        from rasterloom.llm import queries

        got = [r.asDict() for r in queries.queries()[name](spark, sf).collect()]
        want = sql(queries.oracle_sql()[name])
        key = lambda r: repr(sorted(r.items()))
        assert sorted(got, key=key) == sorted(want, key=key)

    return check
