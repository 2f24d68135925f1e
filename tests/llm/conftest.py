import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, component_id string, _row string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]), with further columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), -1, "x", "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random words, the same for a seed."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))

    return make
