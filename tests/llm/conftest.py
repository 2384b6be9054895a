import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that results or intermediate tables use, as extra columns of the input.
CLASHING = ["id", "n", "size", "target", "score", "node", "token", "length", "piece", "offset", "spans", "copies", "kept", "s", "part", "lang_pred", "__gone", "block"]
LONG = "word " * 60_000 + "x" * 50_000


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, repeated texts and rows."""
    text = "The quick brown fox jumps over the lazy dog, and the dog sleeps on in the warm sun of the late afternoon today."
    return [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n ", None, "a", 4), (4, text, "en", "a", 1), (5, text, "en", "b", 1),
            (5, text, "en", "b", 1), (6, LONG, "en", None, 7), (7, "Hi.", None, "c", 3), (8, "12 34 !!", "de", "c", 8), (None, text + " Ünïcode 😀", None, None, None),
            (9, "a\n\nb\n\n\nc", "fr", "b", 9)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows, SCHEMA)
    for k, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit(str(k)) if k % 2 else F.lit(k))
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
