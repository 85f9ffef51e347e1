import pytest

#: Nulls, empty and very long texts, ties, rows that repeat, and what each kind of operator looks for.
TEXTS = [
    None, "", " \n\t", "one", "one two", "The quick brown fox jumps over the lazy dog again and again today", "the QUICK brown fox jumps over the lazy dog again and again today",
    "word " * 4000, "line one here\nline one here\nline one here\n" * 20, "mail a.b@c.example and 10.0.0.1 call +1 (988) 555-2485 card 4111 1111 1111 1111 ok", "é😀 日本語 x\x1cy <|endoftext|> don't", "#### $$$$ %%%% ||||",
    "The quick brown fox jumps over the lazy dog again and again today",
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, f"c{i}", -i, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "r", 0, "x"), (None, "no id here at all", "n", 0, None)]
    # columns with names that the operators use for their own
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, row long, pii string")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
