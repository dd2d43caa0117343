"""Small frames shared by the tests of this folder."""

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (id, text, lang, source) rows, with a column name that others might use."""
    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars int, score string, size string, key string, gap string"
        data = [(i, t, g, s, len(t) if t is not None else None, "x", "y", "z", "w") for i, t, g, s in rows]
        return spark.createDataFrame(data, schema)
    return build


@pytest.fixture(scope="session")
def words():
    """Deterministic word-like text."""
    def make(rng, n, stems):
        return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))
    return make
