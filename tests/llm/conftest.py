import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, null, empty and white texts, repeated rows, one id with two texts, a very long text; columns named like the operators' own."""
    long = " ".join(f"wort{i % 977} und{i % 13}" for i in range(40_000))
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en", "a", 1), (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
            (2, None, "en", "a", 0), (3, "", "en", None, 0), (4, " \t\n ", "en", None, 3), (None, "the quick brown fox jumps over the lazy dog", "en", "b", 1),
            (None, None, None, None, None), (5, "one", "en", "b", 3), (5, "two words", "en", "b", 9), (-7, long, "de", "c", len(long)),
            (8, "▁ a  b c\U0001f600 ́x", "xx", "", 5), (2**62, "ONE", "en", "b", 3)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as size", "2 as token", "3 as _block", "4 as n", "'x' as cls", "5 as copies", "6 as rank", "7 as accepted", "8 as shard", "9 as labels")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def plain(v):
    if isinstance(v, float):
        return repr(v)
    return str(list(v)) if isinstance(v, list) else str(v)


def same_rows(df, relation):
    """A Spark result and a DuckDB one hold the same rows in the same columns."""
    cols = [d[0] for d in relation.description]
    assert sorted(cols) == sorted(df.columns)
    a = sorted("|".join(plain(r[c]) for c in sorted(cols)) for r in (x.asDict() for x in df.collect()))
    b = sorted("|".join(plain(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in relation.fetchall())
    assert a == b
    return len(a)
