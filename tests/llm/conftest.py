import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, n int, key long, label string, shard int, _key string, _t string, rep long, score double, _millrace string"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").cache()


ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one two three", "en"), (4, "one two three", "en"), (None, "one two three", "de"), (5, "Ünï çödé 日本語 words here and there again", "fr"), (6, "12345 67890", "es"),
    (7, "word " * 60_000, "en"), (8, "x" * 150_000, "en"), (9, "\x00\x0b\r\n control ▁ sign", None), (10, "one two three", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeats, very long texts, and columns named like the operators' own."""
    rows = [(i, t, g, None, None, 1, 1, 1, "x", 1, "x", "x", 1, 0.5, "x") for i, t, g in ODD]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
