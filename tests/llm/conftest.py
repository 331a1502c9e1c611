import pytest

from llm_cases import EDGES, SF


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with further columns whose names operators use themselves."""
    extra = "length int, start int, task int, node bigint, digest string, w string, present string, _doc int, _key int, row int, block int, score string"
    rows = [(*r, "x", 1, 2, 3, 4, "d", "w", "p", 5, 6, 7, 8, "s") for r in EDGES]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, " + extra).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
