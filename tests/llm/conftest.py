from __future__ import annotations

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int = 60) -> str:
    """n words that depend on the seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2147483648
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x // 4096 % 50))
    return " ".join(out)


#: What every operator must bear: nulls, empty and blank texts, repeated rows, a long text, columns with names of results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, n_words string, spans string, range string"


def rows(texts: dict | list) -> list[tuple]:
    pairs = texts.items() if isinstance(texts, dict) else texts
    return [(i, t, "en", "s", None if t is None else len(t), "k", "s", "w", "p", "r") for i, t in pairs]


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, prose(4)), (4, prose(4)), (5, prose(4)), (6, prose(6, 4)), (None, prose(7)), (8, "x" * 50_000 + " " + prose(8, 3000)), (9, "ünï ☃ \U0001f600 text"), (10, prose(4) + " more")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(ODD), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)
