import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, id string, key long, text_length int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and names that operators use themselves."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        (None, None, None, None, None, None, None, None, None, None),
        (1, "", "en", "a", 0, "r", 0.5, "i", 1, 1),
        (1, "", "en", "a", 0, "r", 0.5, "i", 1, 1),
        (2, long, "en", "a", len(long), "r", None, "i", 1, 1),
        (3, "\x00 \u00a0\x1c é İ ﬁ 漢字 <s>[INST] 😀 \n\n\t", None, None, 9, None, 1.0, None, None, None),
        (4, "the same text again and again", "de", "b", 29, "r", 0.1, "i", 2, 3),
        (5, "the same text again and again", "de", "b", 29, "r", 0.1, "i", 2, 3),
        (None, "no id here at all", "fr", "c", 17, "x", 0.2, "j", 3, 4),
    ]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("1 = 0")
