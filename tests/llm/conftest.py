import pytest

#: Rows that no operator may stumble over: nulls, empty and long texts, repeats, odd characters, clashing extra columns.
ODD = [
    (1, None), (2, ""), (3, " \n\t\n "), (4, "word"), (5, "The cat sat on the mat and looked at the dog for a while."),
    (5, "The cat sat on the mat and looked at the dog for a while."), (6, "THE cat sat on the mat, and looked at the dog for a while!"),
    (None, "No id at all, but a line of text.\nNo id at all, but a line of text."), (7, "é" * 3000 + "\n" + "x" * 5000 + " tail\n" + "ab " * 3000),
    (8, "\x00  🙂 ﬁ É é Å"), (9, "...---...\n\n\n"), (10, "line one is long enough\nline two is long enough"), (11, "Line one is LONG enough  \nother"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", "src0", 0, "x", "y", 1, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, bitmap string, key int, spans string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def benchmark(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    return spark.createDataFrame([(1, text), (2, "Looked at; the DOG"), (3, None), (4, ""), (5, text), (20, "nowhere to be found at all"), (None, "line one is long")], "item_id long, text string")
