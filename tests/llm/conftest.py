import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Shard int, sequence_id long, score string"


@pytest.fixture
def docs(spark):
    """Builds a table of documents from (doc_id, text[, lang, source]) with extra, clashing columns."""
    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, 7, 8, "x") for r in rows]
        return spark.createDataFrame([Row(*r) for r in full], SCHEMA)
    return build


@pytest.fixture
def odd_rows():
    """NULLs, empty and blank texts, repeated rows, a long text, other scripts."""
    long = " ".join(f"w{i % 977}" for i in range(60000))
    return [(None, None, None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (5, "été ß 漢字 ok", None, None),
            (None, "one two three four five six seven"), (6, long), (7, long), (8, "x" * 100000), (9, "... 123 !!!")]
