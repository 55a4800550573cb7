import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def long_text(seed: int, n: int = 60) -> str:
    """Words that repeat rarely enough for shingles to differ."""
    return " ".join(f"{WORDS[(i * i + seed) % 12]}{(i * (seed + 3)) % 17}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like ones the operators make."""
    base = long_text(5, 120)
    rows = [
        (1, base), (2, base), (3, base + " tail"), (4, base.replace(" ", "\t\n ")), (5, None), (6, ""), (7, "   "), (8, "Zeile ß 😀\n\nx"),
        (9, "one"), (9, "one"), (10, "ONE"), (None, "no id"), (None, None), (11, "word " * 30_000), (12, long_text(9)), (13, long_text(9)[:-4] + "end"),
        (-5, base), (14, "a\r\nb\x0b\x0cc\n"),
    ]
    rows = [(i, t, "en", None, 0, i, "k", "d", 1, "dot") for i, t in rows]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, digest string, bitmap string, score int, `x.Y z` string"
    return spark.createDataFrame(rows, ddl).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the smallest data set, as a dict."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] for r in rows}
