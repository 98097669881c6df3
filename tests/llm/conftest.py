import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __block string, fp string, root int, word string, class string, digits string, copies int"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", 1, "z", "c", "d", 9)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and extra columns with names that operators use."""
    rows = [
        row(1, "Hello wörld, this is a text. " * 9), row(2, None), row(3, ""), row(4, " \t\n"), row(5, LONG), row(6, "Hello wörld, this is a text. " * 9), row(None, "no id here"), row(None, "no id here"),
        row(8, "same id"), row(8, "same id"), row(8, "same id, other text"), row(9, "!!! 123 ###"), row(10, "one", None, None), row(11, "mail a.b@c.de, +1 (555) 555-0123 and 10.0.0.255", "de", "t"), row(12, "x" * 100_000),
        row(13, "日本語 テキスト ١٢٣"), row(14, "a\x00b\x1fc"), (None,) * 12,
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
