import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture
def prose():
    """prose(seed, n): n words of a small invented vocabulary, so that short runs repeat and long ones do not."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))

    return make


@pytest.fixture
def docs(spark):
    """docs((id, text), ...): with further columns whose names the operators use themselves."""

    def make(*rows):
        schema = "doc_id long, text string, id string, n long, size int, token string, prefix string, bytes long, place int"
        return spark.createDataFrame([(i, t, "x", 1, 2, "t", "p", 3, 4) for i, t in rows], schema)

    return make


@pytest.fixture
def odd_rows(prose):
    """Null and empty texts, white space, one word, a very long text, a word of 50,000 letters, ties, repeated rows, a null id."""
    same = prose(1, 120)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, prose(2, 30_000)), (6, "w" * 50_000), (7, same), (8, same), (8, same), (9, same + " "),
        (None, same), (None, None), (10, "Großes ÉTÉ 日本語 \U0001d518 naïve"), (11, "a b c"), (12, "A B C"), (13, "▁x"),
    ]
