import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and a hot source."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 200)) for _ in range(30)]
    texts = list(base)
    for i in range(40):
        copy = base[i % 10].split(" ")
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy) if i % 2 else base[i % 7])
    texts += [None, "", " \t\n", "x", "one two", "é" * 300, "a" * 900, words(rng, 20_000), base[3][:120] + "é" + base[4]]
    rows = [(i, t, "en" if i % 3 else None, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], rows[31], (None, base[5], "en", "s1", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
