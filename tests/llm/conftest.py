from __future__ import annotations

import pytest

from tidemark.llm.common import prepare

# Columns of documents plus two whose names clash with those the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, length int"


@pytest.fixture
def docs(spark):
    prepare(spark)

    def make(*texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        rows = [(i, t, g, "s", None if t is None else len(t), "x", 1) for i, t, g in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def odd(docs):
    """Null, empty and repeated rows, a null id, a very long text and characters of many kinds."""
    return docs(
        None, "", " ", "word", "word", "Some text here, with a few words.", "Some text here, with a few words.", "ÄÖ ñ 漢字 🙂\u0000\n\t x",
        "long " * 60_000, "x" * 50_000, ids=[0, 1, 2, 3, 3, 4, None, 5, 6, 7], langs=[None, "en", "en", "de", "de", "fr", "fr", "es", "en", "xx"],
    )


@pytest.fixture
def none(docs, spark):
    return spark.createDataFrame([], SCHEMA)
