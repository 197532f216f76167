from __future__ import annotations

import pytest

from caselink.llm.queries import importable

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(autouse=True)
def workers_find_the_package(spark):
    importable(spark)


@pytest.fixture
def docs(spark):
    """Documents from (id, text) or longer tuples, with the columns of the table."""

    def make(rows, extra: str = ""):
        full = []
        for row in rows:
            row = tuple(row)
            text = row[1]
            lang = row[2] if len(row) > 2 else "en"
            source = row[3] if len(row) > 3 else "s0"
            full.append((row[0], text, lang, source, len(text) if text is not None else None, *row[4:]))
        return spark.createDataFrame(full, DOCS + (", " + extra if extra else ""))

    return make


#: Null, empty, blank and wordless texts, ties, repeated rows and ids, and a null id.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "two words"), (5, "other words"),
    (None, "no id at all"), (None, "no id at all"), (6, "é ß … 日本   ' \" * <|endoftext|>"),
]


@pytest.fixture
def odd():
    return list(ODD)
