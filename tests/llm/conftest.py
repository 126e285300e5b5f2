import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, keep_id string, _id long, token string, taken double"
WORDS = "the of and to in is that was for on with as by at from this be are an or thou ther ing tion".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(n))


@pytest.fixture(scope="session")
def table_of(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(*r, 0, 1, "x", 2, "y", 0.5) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, equal and near copies, ties, rows repeated whole."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 120)), "en", f"s{i % 4}") for i in range(60)]
    base = prose(rng, 150)
    for i in range(60, 75):
        words = base.split()
        words[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(words), "fr", "s0"))
    rows += [(80 + i, base, "fr", None) for i in range(6)]
    rows += [(90, None, None, None), (91, "", "en", ""), (92, " \t\n", None, "s1"), (93, "1 2 3 4", "en", "s2"), (94, "héé ßü", "de", "s9")]
    rows += [(95, prose(rng, 30_000), "en", "s1"), (96, "ab" * 5000, "en", "s1"), (97, "x" * 400_000, "en", "s3")]
    rows += [(98, rows[3][1].upper() + "  " + rows[4][1], "en", "s1"), (98, rows[3][1].upper() + "  " + rows[4][1], "en", "s1")]
    rows += [(99, "one two", "en", "s1"), (99, "another text under the same id", "en", "s2"), (None, base, "fr", "s0"), (None, None, None, None)]
    rows += [(100, prose(rng, 40) + " " + base, "en", "s5"), (101, base + " " + base, "en", "s5")]
    return rows
