import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

PARA = " ".join(f"word{i} of the story {i * 7 % 13}" for i in range(60))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, start int, k string, spans string, tokens string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and blank texts, copies, near copies, a shared passage, a long text, and columns with clashing names."""
    texts = [None, "", "  \n", "one", PARA, PARA, PARA.replace(" ", "  ") + "\n", PARA + " tail words here", "intro " + PARA[:900] + " outro",
             PARA[200:1100] + " elsewhere", "mail a.b@c.example.com +1 (555) 555-0100 10.2.3.4 4111 1111 1111 1111 999.1.1.1", "é ü ß " * 300,
             " ".join(f"unique{i}" for i in range(20000)), "Licensed under the Apache Licence, version 2.0", "abc " * 500]
    rows = [(i + 1, t, None if i == 3 else "en", None if i == 4 else "s", 0, 1, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
