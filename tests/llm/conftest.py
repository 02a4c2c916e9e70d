import random

import pytest

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups phi chi psi ome".split()
#: Columns that operators could use for themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row long, rid long, size long, score double, bucket int, words string, label string, keep long, `odd name` string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def hard_texts() -> list[tuple]:
    """(doc_id, text, source): nulls, empties, white space, copies, repeated rows, odd characters, long and spaceless texts."""
    base = prose(1, 300)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, base, "a"), (5, base.upper(), "b"), (6, base, "b"), (6, base, "b"), (7, base + " extra", "c"),
        (8, prose(2, 60_000), "a"), (9, "x" * 30_000, None), (10, "É é ß 😀 日本語 \u0000 \x1c", "d"), (11, "one", "d"), (12, "one two", ""), (13, "the MIT License and MIT  license.", "b"),
        (14, "日本語" * 4000, "a"), (15, "É" + base, "c"), (None, "no number", "a"), (16, prose(3, 50), "c"), (17, prose(4, 800), "c"), (18, "He He He He He He He He He He He He", "d"),
    ]


@pytest.fixture(scope="session")
def hard(spark):
    rows = [(i, t, "en", s, len(t or ""), 1, 2, 3, 0.5, 4, "w", "l", 5, "o") for i, t, s in hard_texts()]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASHING)
