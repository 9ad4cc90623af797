import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, id long, h long, class_id long, spans string"


@pytest.fixture(scope="session")
def messy(spark):
    """Null, empty, very long and repeated rows, ties, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 997} and" for i in range(30_000))
    rows = [(0, None), (1, ""), (2, "   \n "), (3, "one"), (4, "one"), (5, long), (6, long), (7, "naïve café 中文 \U0001f600 İstanbul"), (8, "a b c d e f g h i j"), (8, "a b c d e f g h i j"), (9, "x" * 5000), (None, "no id here at all now")]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 1.0, 1, 1, 1, 1, "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(messy):
    return messy.where("doc_id < -1")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
