"""Small tables with everything that may go wrong in them."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, size int,"
    " row string, class string, draws string, bitmap string, n int, score string"
)
SHARED = "This very line stands in many of the documents, Word for Word."
EXTRA = ("k", 1, "r", "c", "d", "b", 2, "s")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, blanks, a long text, ties, repeated rows."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("th", "Re", "ou", "ñé") for b in ("ing", "er,", "on.", "ß")]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows = [
        (1, None, None, None),
        (2, "", "en", ""),
        (3, " \t\n\x0b\x0c\r ", "en", "a"),
        (None, prose(30), "en", "a"),
        (None, None, None, "b"),
        (4, "1234 5678 !!", "en", "b"),
        (5, prose(4), "fr", "b"),
        (6, prose(6000) + "\n" + SHARED, "en", "a"),
        (7, "中日 \U0001f600 é\x85\xa0x\x00y", "fr", "b"),
    ]
    copy = prose(80)
    rows += [(10 + i, copy, "en", "a") for i in range(6)]
    rows += [(20 + i, f"{prose(12)}\n  {SHARED.upper() if i % 2 else SHARED}\t\n{prose(9)}", "fr", "b") for i in range(7)]
    near = prose(120).split()
    for i in range(6):
        changed = list(near)
        changed[17 * i] = f"changed{i}"
        rows.append((40 + i, " ".join(changed), "en", "c"))
    rows += [(50, prose(20), "en", "a")] * 3 + [(51, "x", "en", "a"), (51, "y z", "fr", "b")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in odd_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
