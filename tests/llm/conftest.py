from __future__ import annotations

import random

import pytest

EXTRA = "row string, target int, g long, rep long, anchor string, n int, tokens int, first int, runs int, tag int, score string, component string, keep string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def make_docs(spark, rows):
    """documents from (id, text) with columns whose names the operators use themselves."""
    extra = ("x", 1, 2, 3, "y", 4, 5, 6, 7, 8, "z", "c", "k")
    return spark.createDataFrame(
        [(i, t, (None, "en", "fr")[j % 3], f"src{j % 2}" if j % 5 else None, len(t or ""), *extra) for j, (i, t) in enumerate(rows)], SCHEMA
    ).repartition(3)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Copies, near copies, shared passages, runs of a word, and every odd case."""
    rng = random.Random(3)
    base = [sentence(rng, n) for n in (80, 200, 300, 61, 1500)]
    shared = sentence(rng, 70)
    rows = [(10 + i, t) for i, t in enumerate(base)]
    rows += [(30 + i, t) for i, t in enumerate(base[:3])]  # exact copies
    for i in range(12):  # near copies at all distances
        w = base[i % 3].split(" ")
        for _ in range(1 + i):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        rows.append((50 + i, " ".join(w)))
    rows += [(100 + i, f"{sentence(rng, 40)} {shared} {sentence(rng, 25 + i)}") for i in range(4)]
    rows += [(120 + i, "again " * (60 + 20 * i)) for i in range(3)]
    rows += [(130 + i, "a b " * (40 + i)) for i in range(3)]
    rows += [(140, None), (141, ""), (142, " \n\t "), (143, "one"), (144, "ONE"), (145, "one two three"), (146, "one  two\nthree"), (147, "é ü \x85 ñ ß ş")]
    rows += [(None, base[1]), (None, None), (5, base[3]), (5, base[3]), (6, base[4]), (6, sentence(rng, 90)), (-7, base[0])]
    rows += [(150, sentence(rng, 30_000, 3000)), (151, "x" * 5000), (152, "x" * 3000), (153, "one two three four five six"), (154, "one two three four five six")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return make_docs(spark, odd_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
