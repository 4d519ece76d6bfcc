import pytest

LONG = " ".join(f"w{i % 977}x" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    rows = [
        (1, None, "a"), (2, "", "b"), (3, "same text here again and more", "c"), (4, "same text here again and more", None), (4, "same text here again and more", None),
        (5, LONG, "d"), (6, "Naïve Œuvre 日本語 <|endoftext|> 's it''s", "e"), (None, "no id", "f"), (None, None, None), (7, " \n\t ", "g"), (8, "x" * 70_000, "h"),
    ]
    more = [(*r, "s", 1, "k", True, 0.5, 7, "t") for r in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, sha string, shard int, key string, kept boolean, score double, size int, node string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
