import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text) or longer tuples."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit("x") for c in ("a", "b", "n", "size", "key", "comp", "spans", "nodes", "quality", "label", "score", "lang_pred", "seq", "start", "id", "line", "gone", "target", "items", "uid")})

    return add


ODD = [(1, None), (2, ""), (3, "   \n\t"), (None, "no id here"), (4, "one"), (5, "one"), (5, "one"), (6, "Ünïcode – text\n日本語"), (7, "word " * 3000)]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)
