import pytest


LONG = "alpha beta gamma delta " * 40_000


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows and clashing column names."""
    rows = [
        (1, "", "en", "a"), (2, None, None, None), (3, " \n\t ", "en", "a"), (4, "one", "en", None),
        (5, "The same text, twice over. " * 9, "en", "a"), (6, "The same text, twice over. " * 9, "de", "b"),
        (6, "The same text, twice over. " * 9, "de", "b"), (None, "no key here", "en", "a"), (None, None, None, None),
        (7, LONG, "en", "a"), (8, "<|endoftext|> Ünïcode 日本語 ½ \u001c x́", "fr", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    for i, name in enumerate(("score", "ids", "digest", "bands", "n_words", "shard", "key", "items", "places", "block", "id",
                              "class", "bucket")):
        df = df.selectExpr("*", f"{i} as {name}")
    return df


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
