import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pra", "sti") for b in ("dor", "fen", "gam", "hul", "jix", "rov")]


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) pairs or whole rows."""

    def make(rows):
        full = [r if len(r) == 5 else (*r, "en", "src1", None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


def with_odd_columns(df):
    """The table with extra columns, named like those that operators make."""
    return df.withColumns({c: F.lit(7) for c in ("doc", "mark", "n", "text_sha256", "__text", "quality", "cut", "lm")})


ODD = [None, "", " ", "\n", "\n\n", "a", "é", "日本 語", "x" * 5000, "same words again and again " * 40]
