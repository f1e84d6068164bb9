import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, part int, n long, items string"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing column names."""
    long = "one two three " * 30_000
    rows = [
        (None, None), (None, "null id text with some words"), (1, None), (2, ""), (3, "   \n\t "), (4, "word"),
        (5, "two words"), (6, long), (7, "same text again and again here"), (7, "same text again and again here"),
        (8, "same text again and again here"), (9, "x" * 100_000), (10, "9" * 50_000), (11, "a@" * 20_000),
        (12, "Zürich café naïve 日本 語     end"), (13, "tie"), (14, "tie"), (-5, "negative id"),
    ]
    return spark.createDataFrame([(*r, None, "src0", 1, 2, 3, 4, "y") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tok():
    from tokenizers import Tokenizer

    from stratagrid.llm.encoding import default_tokenizer

    return Tokenizer.from_file(default_tokenizer())
