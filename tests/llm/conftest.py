import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


_LONG = " ".join(f"w{i}" for i in range(400))
_PASSAGE = " ".join(f"p{i % 61}x{i}" for i in range(80))

#: Nulls, empty and blank texts, ties, repeats, one word over and over, no break, several scripts.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one", "b"), (6, "ONE two three four", "b"),
    (7, "a " * 300, "a"), (8, "a " * 120 + "b", "a"), (9, _LONG, "a"), (10, _LONG, "a"), (11, _LONG.upper(), None),
    (12, "start " + _PASSAGE + " end", "c"), (13, "other " + _PASSAGE, "c"), (14, _PASSAGE, "c"), (15, "x" * 5000, "c"),
    (16, "é ü 漢字　かな \U0001f600 ŧ\x0bv\x0cf\rr", "d"), (17, "line one is here\nline one is here\n\nline one is here", "d"),
    (18, "#*$%&|<> !! ?? " * 5, "d"), (19, " ".join(f"w{i}" for i in range(5, 400)), "a"), (20, "ab " * 60 + "cd " * 60, "e"), (21, "cd " * 60 + "ab " * 55, "e"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """(doc_id, text, source) with odd texts, and columns whose names an operator may use itself."""
    rows = [(*r, "x", i, None) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, block string, rank int, kept_text string").cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
