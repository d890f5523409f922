import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture
def odd_docs(spark):
    """Null and empty texts, ties, repeated rows, a null id and source, a long text, columns of clashing names."""
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(20_000))
    rows = [
        (1, None, "en", "a", 0, 0.5, "x"), (2, "", "en", "a", 0, 0.5, "x"), (3, " \t\n", None, None, 0, 0.5, "x"), (4, "one", "en", "b", 3, None, None), (5, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 9, 0.1, "y"),
        (6, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 9, 0.1, "y"), (6, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 9, 0.1, "y"), (None, "no id here", "fr", "b", 1, 0.2, "z"), (7, long, "en", "a", 1, 0.3, "z"),
        (8, "漢字 and émigré 😀 <|endoftext|> it's", "ja", None, 1, 0.3, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, score double, kept string")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
