import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, owner string, row string, bucket int"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus():
    """Small documents with exact and near copies, shared passages, nulls, empty and odd texts, repeated rows."""
    rng = random.Random(7)
    shared = " ".join(words(rng, 60))
    texts = [" ".join(words(rng, rng.randrange(1, 200))) for _ in range(60)]
    texts += [f"{' '.join(words(rng, 20))} {shared} {' '.join(words(rng, 30))}" for _ in range(8)]
    texts += [texts[0], texts[0], texts[1].replace(" ", "\t\n "), texts[61] + " end", "x " * 90, "x " * 90, "a" * 300, "a" * 260]
    texts += ["", None, " \n\t ", "é", "Ünï ß — 漢字   \x1c end", "!!! ... 123", shared, shared[10:], "one two"]
    long = " ".join(words(rng, 4000, 50_000))
    texts += [long, long[:9000] + " changed " + long[9000:]]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


def table(spark, rows):
    """Documents with columns of other names that must not matter."""
    return spark.createDataFrame([(i, t, None, "s", None, "o", "r", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated and null identifiers, repeated rows."""
    return table(spark, [*rows[:30], *rows[60:70], *rows[:3], (None, rows[0][1]), (None, None), (rows[0][0], rows[62][1])])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
