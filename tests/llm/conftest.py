import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, periodic, very long, empty and null texts."""
    rng = random.Random(11)
    passage = words(rng, 60)
    base = words(rng, 120)
    rows = [words(rng, rng.randrange(1, 200)) for _ in range(60)]
    rows += [base] * 6 + [words(rng, 3)] * 3 + ["", None, " \n\t ", "one", "one two", "One  TWO"]
    for _ in range(25):  # near copies: one or two words changed
        w = base.split()
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    for _ in range(25):
        rows.append(words(rng, 20) + " " + passage + " " + words(rng, 30))
    rows += ["ha " * 300, "ha " * 170, words(rng, 9000), "é日本 " * 80, "x" * 5000]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "src", None) for i, t in corpus], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
