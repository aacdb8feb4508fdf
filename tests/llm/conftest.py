import pytest

#: Columns that an operator might use a name of for itself.
CLASH = "size string, count long, kept string, row long, h string, node string, label string, token string, score string, rank string, n long, id string, part string, target string, copies string, shard string, slot string, base string, spans string, set string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(n, seed=0):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, source with nulls, empty and long texts, ties and repeated rows."""
    a, b, long = text(80, 1), text(60, 2), text(30_000, 3)
    return [
        (1, a, "s1"),
        (2, a.replace(" ", " \t\n"), "s1"),
        (3, None, None),
        (4, "", "s2"),
        (5, " ", "s2"),
        (6, long, "s1"),
        (7, b, "s3"),
        (7, b, "s3"),
        (8, b + " tail", "s3"),
        (9, a.upper(), "s1"),
        (None, a, "s1"),
        (None, None, None),
        (10, "one", "s2"),
        (11, "ÄÖ ß ﬁ́ 日本語 <|endoftext|> <s> \x00\x1c x", "s4"),
        (12, "one two", "s2"),
        (13, "nul\x00 \x0b\x0c\x1f\xa0end", None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    names = [c.split()[0] for c in CLASH.split(", ")]
    rows = [(*r, "en", len(r[1] or ""), *[None] * len(names)) for r in odd_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, n_chars long, {CLASH}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
