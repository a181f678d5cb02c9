import pytest

from scriptloom.llm.queries import vocabulary


@pytest.fixture(scope="session")
def path():
    return vocabulary()


@pytest.fixture(scope="session")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def hard(spark):
    """NULLs, empty, tied, repeated and long texts, with extra columns whose names clash with ours."""
    rows = [
        (1, None, 5, "a"),
        (2, "", None, None),
        (3, " \n\t", 1, "x"),
        (4, "alpha beta gamma delta epsilon zeta", 1, "x"),
        (4, "alpha beta gamma delta epsilon zeta", 1, "x"),
        (5, "alpha beta gamma delta epsilon zeta", 2, "y"),
        (6, "Σίσυφος İstanbul naïve café 漢字 𝔘 é 'S <|endoftext|> #$%", 3, "z"),
        (7, "the long one of a kind and the rest, was it the end of the story? " * 800, 4, "z"),
        (8, "x" * 3000, 4, "z"),
        (9, "a\x1cb !\x1f! \x85 　  z", 4, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id int, own string")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def pairs():
    def of(df, id_column="doc_id"):
        return [(r[id_column], r["text"] or "") for r in df.select(id_column, "text").collect()]

    return of
