import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, size string, _shard long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source) rows, with further columns of clashing names."""

    def build(rows, parts=3):
        full = [(i, t, "en", s, len(t) if t is not None else None, 7, "x", 9) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null in every column, empty and blank texts, one long text, copies, ties, repeated rows."""
    import random

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "éta", "theta", "the", "of", "日本", "x1"]
    prose = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 160))) for _ in range(25)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(prose)]
    rows += [
        (100, None, "s1"), (101, "", "s2"), (102, " \t\n ", None), (103, None, None), (None, prose[0], "s0"), (None, None, None),
        (104, prose[1], "s3"), (104, prose[1], "s3"), (105, prose[1].replace(" ", "\n"), "s0"), (106, prose[1] + " tail", "s1"),
        (107, "one", "s1"), (108, "ONE", "s2"), (109, "a" * 3000, "s1"), (110, "a" * 1200, "s2"),
        (111, " ".join(prose) * 8, "s0"), (112, "line one\nline two\n\nline one\n", "s1"), (104, "other text of the same id", "s0"),
        (113, "\x00nul\x0bsep\x0c" + prose[2], "s2"),
    ]
    return rows


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
