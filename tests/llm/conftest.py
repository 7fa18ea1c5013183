import random

import pytest

LONG = " ".join(f"w{k % 5000}" for k in range(60_000))


@pytest.fixture(scope="session")
def model():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and columns that clash with names used inside."""
    prose = "one two three four five six seven eight nine ten\nsecond line of the same text here\nthird line is here as well"
    rows = [
        (1, prose, "en", "a", 5),
        (1, prose, "en", "a", 5),
        (2, prose, "en", "b", 5),
        (3, None, None, None, None),
        (None, "text of no id with five words or more", "xx", "a", 1),
        (None, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t\n ", "de", "b", 5),
        (6, LONG, "en", "a", len(LONG)),
        (7, "🙂 ﻿x\0y", "fr", "c", 7),
        (8, "word", "es", "c", 4),
        (8, "another word", "es", None, 4),
    ]
    clash = ("id", "uid", "rid", "key", "h", "size", "block", "removed", "n_lines", "spans", "rank", "root", "ids")
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    return spark.createDataFrame([(*r, *("x" if k % 2 else None for k, _ in enumerate(clash))) for r in rows], names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture
def rng():
    return random.Random(17)
