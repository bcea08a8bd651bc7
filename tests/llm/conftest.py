import random

import pytest

#: Columns of documents and one with a name that operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def document(doc_id, text, source="s", lang="en"):
    return doc_id, text, lang, source, len(text or ""), "clash"


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame([document(*r) for r in rows], DOCS)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    syllables = ["an", "the", "tion", "er", "is", "ou", "re", "ing", "é", "ß", "ha"]
    return lambda n, seed=None: " ".join("".join((random.Random(f"{seed}-{i}") if seed is not None else rng).choices(syllables, k=1 + i % 3)) for i in range(n))


@pytest.fixture
def corpus(make, words):
    """Nulls, empty and long texts, exact and near copies, repeated rows, a null id and a null source."""
    base = words(300, 1)
    near = base.replace(" the", " the the", 1)
    rows = [(1, base), (2, base), (3, near), (4, words(40, 2), "t"), (5, None, None), (6, ""), (7, " \t\n"), (8, "one two"), (None, words(60, 3), "t"), (9, words(9000, 4), "u"), (10, words(200, 5) + "\n" + base[:700] + "\n" + words(50, 6)), (4, words(40, 2), "t"), (11, "日本語 ünïcode " * 60)]
    return make(rows)
