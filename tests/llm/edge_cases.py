import pytest

SF001 = "/root/testdata/sf0.001"

EXTRA = "score double, kept boolean, n long, row long, h long, key long, ids string, host string, lang_pred string, start long, token long"


def words(k, n, stem="w"):
    """``n`` words that depend on ``k``."""
    return " ".join(f"{stem}{(k * 7919 + i * 104729) % 9973}" for i in range(n))


EDGE_TEXTS = [
    (1, ""), (2, None), (None, words(3, 80)), (4, words(4, 80)), (4, words(4, 80)), (5, words(4, 80)),
    (6, "   \n\t "), (7, words(7, 60000)), (8, "one"), (9, "one"), (10, "Über\u00a0straße \U0001f642 ½ a\u0301 \x00 \x1c end"),
    (11, "same line here\n" * 40), (12, "### $$$ &&& " * 60), (None, None),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    rows = [(i, t, None if k % 3 == 0 else "en", None, None) + (None,) * 11 for k, (i, t) in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
