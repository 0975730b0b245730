import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, keep_id string, fp string, node int, word int, bits int, `_bit` int, n int, at int, h long, part int, shard int"
LONG = "lorem ipsum dolor " * 20_000


def rows(*pairs):
    """(doc_id, text, lang) rows with clashing extra columns."""
    return [(d, t, lang, None, None, 7, "x", "y", "z", 1, 2, 3, 4, 5, 6, 8, 9, 10) for d, t, lang in pairs]


@pytest.fixture(scope="session")
def edge(spark):
    """Null identifiers and texts, empty and very long texts, repeated rows, ties, other scripts."""
    texts = [
        (1, "Hello world, this is a Test of the thing", "en"), (2, "hello WORLD, this is a test of the thing", "en"), (3, None, None), (4, "", "en"), (5, LONG, "la"),
        (6, "Grüße ÄÖÜ und so weiter, wir sagen hallo", "de"), (7, "grüße ÄÖÜ und so weiter, wir sagen hallo", None), (7, "grüße ÄÖÜ und so weiter, wir sagen hallo", None),
        (None, "hello world, this is a test of the thing", "en"), (None, None, None), (8, "中文字 🙂 <|endoftext|> 'tis x's", None), (9, " \t\n ", "en"), (10, "12345 +1 (555) 010-9999 a@b.co", "en"),
    ]
    return spark.createDataFrame(rows(*texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


def by_id(df, id_col="doc_id"):
    return {r[id_col]: r for r in df.collect()}
