from __future__ import annotations

import pytest

from lodestar.llm.queries import PIECES, WORD_BPE, tokenizer_file


@pytest.fixture(scope="session")
def word_bpe():
    return tokenizer_file(WORD_BPE)


@pytest.fixture(scope="session")
def pieces():
    return tokenizer_file(PIECES)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table like documents, with columns whose names helpers or results might take."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x", 7, "y") for i, t, s in ((*r, "src0")[:3] for r in rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, id string")

    return make


@pytest.fixture(scope="session")
def by_id():
    return lambda df: {r["doc_id"]: r for r in df.collect()}
