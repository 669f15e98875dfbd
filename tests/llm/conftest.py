import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n invented words."""
    import random

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Nulls in every column, empty, very long and repeated texts, repeated rows, and extra columns with clashing names."""
    p = prose(1, 300)
    rows = [
        (1, p, "en", "a", 1), (2, p, "en", "a", 1), (2, p, "en", "a", 1), (3, None, "fr", None, None), (None, p, None, "b", 2), (None, None, None, None, None), (4, "", "en", "c", 0),
        (5, "  \n\t ", "en", "c", 5), (6, "one", "en", "c", 3), (7, "12 34 !!", "en", "c", 8), (8, prose(2, 40_000), "en", "d", 9), (9, "x" * 2_500_000, "en", "d", 9), (10, p + " tail", "fr", "e", 4),
        (11, "é" * 70 + " 日本語 テキスト 🙂 password = hunter2hunter2", "es", "e", 6),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # names that the operators use inside
    return df.selectExpr("*", "1 as n", "'x' as key", "2 as h1", "'y' as s", "0 as part", "'z' as component", "array(1) as _spans", "'w' as `odd.name`", "7 as Text2")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")
