import pytest

#: Rows with nulls, empty texts, ties, repeated rows, an own id for two texts; other columns carry names that operators might use inside.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog while the band plays on", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog while the band plays on", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog while the band plays on", "en", "a"),
    (3, "", "en", "b"),
    (4, None, None, "b"),
    (5, "password=abcdef123456789\nline two", "en", None),
    (6, "1234 5678 !!", "de", None),
    (6, "Über den Wolken muß die Freiheit wohl grenzenlos sein", "de", "c"),
    (7, "é à ü\t\x0b x\r\ny", "fr", "c"),
    (None, "no id at all but some words here", "en", "a"),
    (8, "word " * 3000, "en", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, "u", "k", 3, "s", 1.5) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, uid string, key string, n int, sha string, score double").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
