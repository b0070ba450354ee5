import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, one word, repeated rows, ties, special strings, separators that only Python calls white space, very long texts.
TEXTS = [None, "", " \t\n", "One", "the pier opens at dawn", "the pier opens at dawn", "A b c d", "ab" * 40_000, "x y " * 20_000, "Ünï cödé ΣΑΣ 漢字 😀 <|endoftext|> it's we're\x1cz ", "  two  spaces\n\n\nlines ", "don't 'll 'r 're"]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, None if i % 2 else "en", "s", None) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s", 1), (None, "a row without an id", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus():
    return "/root/testdata/sf0.001"
