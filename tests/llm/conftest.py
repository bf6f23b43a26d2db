import random

import pytest


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, long, tied and repeated rows around a few related texts."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}é" for i in range(40)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    hot, bases, rows = text(9), [text(60) for _ in range(4)], []
    for i in range(160):
        kind = rnd.random()
        if kind < .2:
            t = text(rnd.randint(0, 80))
        elif kind < .5:
            words = rnd.choice(bases).split()
            words[rnd.randrange(len(words))] = "zz"
            t = " ".join(words)
        elif kind < .7:
            t = f"{text(20)} {hot} {text(10)}"
        elif kind < .8:
            t = "a " * rnd.randint(1, 50)
        else:
            t = f"{rnd.choice(bases)}\n{text(5)}"
        rows.append((i, t))
    return rows + [(7, "x y"), (7, "x y"), (None, bases[0]), (500, None), (501, ""), (502, "  \t\n "), (503, text(4000))]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", 1, 2, "k") for d, t in odd_rows],
                                 "doc_id long, text string, lang string, source string, did int, n_words int, key string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
