import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from mise.session import build_session
    return build_session("local[4]", app="mise-tests", shuffle_partitions=8)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text) as documents, with columns that clash with the operators' own."""
    def make(rows, clash=()):
        schema = SCHEMA + "".join(f", {c} string" for c in clash)
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *("x" for _ in clash)) for i, t in rows], schema)
    return make


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "same text here again"), (5, "same text here again"), (6, "same text here again"),
       (None, "a row without an id"), (7, "word " * 30000), (8, "x" * 200000), (9, "日本語 ✓ 🙂 é\x00b"), (10, "12 " * 5000)]


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD)
