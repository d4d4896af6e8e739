import random

import pytest

LOWER = {a: a + 32 for a in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, nulls, blanks, repeats and very long and odd texts."""
    rng = random.Random(5)
    out = []
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    for i, t in enumerate(texts):
        out.append((i, t))
    base = prose(rng, 300, 5000)
    for i in range(60, 75):  # near copies of one text
        w = base.split(" ")
        w[rng.randrange(300)] = f"edit{i}"
        out.append((i, " ".join(w)))
    out += [(75, texts[3]), (76, texts[3].upper()), (77, None), (78, ""), (79, " \t\n "), (80, "one"), (81, "ONE"), (82, "Ünïcode — ﬁ  x\n\ny"), (83, "a b"), (84, "a b c d e f"), (85, "a b c d e"), (86, prose(rng, 20000, 900)), (None, texts[5]), (None, "loose"), (4, texts[4]), (4, "another text of the same id")]
    return [(i, t, ["en", "fr", None][k % 3], ["s1", "s2", "s2", "s2", None][k % 5], None if t is None else len(t)) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
