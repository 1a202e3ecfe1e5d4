import random

import pytest

# Further columns with names that the operators use themselves or that differ in case only.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "_hash string, _key int, TEXT string, kept string, _row int, _c1 string"
)
EXTRA = ("h", 1, "other", "k", 2, "c")


def sentence(draw, words):
    stems = ["alpha", "Beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    return " ".join(draw.choice(stems) + str(draw.randrange(400)) for _ in range(words))


def odd_rows():
    """Nulls everywhere, empty, one-letter, repeated, near and very long texts."""
    draw = random.Random(3)
    base = sentence(draw, 260)
    words = base.split()
    near = " ".join(words[:130] + ["changed"] + words[131:])
    long = sentence(draw, 30_000)
    shared = sentence(draw, 90)
    return [
        (1, base, "en", "a", 1),
        (2, base.upper().replace("É", "é"), "en", "a", 1),
        (3, near, None, "a", None),
        (3, near, None, "a", None),
        (4, "", "en", None, 0),
        (5, None, None, None, None),
        (None, base, "en", "b", 1),
        (None, None, None, None, None),
        (6, long, "de", "b", 1),
        (7, long[:150_000] + " x " + long[150_000:], "de", "b", 1),
        (8, "x", "en", "b", 1),
        (9, "12 34 !? ½", "en", "b", 1),
        (10, sentence(draw, 40) + " " + shared + " " + sentence(draw, 60), "fr", "a", 1),
        (11, sentence(draw, 10) + " " + shared + " " + sentence(draw, 25), "fr", "a", 1),
        (12, "Ñandú ÉTÉ " * 400, "es", "a", 1),
        (12, "same id, other text", "es", "a", 1),
        (2**40, sentence(draw, 3), "es", "c", 1),
    ]


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    spark.conf.set("spark.sql.caseSensitive", "true")
    made = spark.createDataFrame([(*row, *EXTRA) for row in rows], SCHEMA)
    spark.conf.set("spark.sql.caseSensitive", "false")
    return made


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
