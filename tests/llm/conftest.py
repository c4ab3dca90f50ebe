import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with every awkward case: nulls anywhere, blank and long texts, ties, repeated rows, clashing extra columns."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    passage = " ".join(base)
    rows = [
        (1, passage, "a"), (2, passage, "a"), (2, passage, "a"), (3, "start " + passage + " end of it", "b"), (4, None, "b"), (5, "", None), (6, "   \n\t ", "c"), (None, passage + " null id", "c"),
        (7, "one\ntwo\none\none two\n\n  \nfive # $ % words here", "b"), (8, " ".join(base * 40), None), (9, "word " * 3000, "a"), (10, "\u00e9t\u00e9 na\u00efve \u4e2d\u6587 \U0001f600 the of and to in is that", "a"),
        (11, "the cat and the dog of the house is in a garden with that bird for it", "c"), (12, "x" * 20000, "c"), (13, "a\u00a0b c\u2003d", "a"),
    ]
    return spark.createDataFrame([(i, t, "xx", s, len(t or ""), "clash") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")


@pytest.fixture(scope="session")
def nothing(spark, documents):
    return spark.createDataFrame([], documents.schema)
