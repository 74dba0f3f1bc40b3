import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(spark, texts, langs=None, ids=None):
    rows = [
        (ids[i] if ids else i, t, langs[i] if langs else "en", "s", len(t) if t is not None else None)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(7)
    return ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(400)]


@pytest.fixture()
def docs_of(spark):
    return lambda texts, langs=None, ids=None: make(spark, texts, langs, ids)
