"""Fixtures of the operators' tests: awkward documents and brute-force answers."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, host string, slot string, row int"


def long_text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, and columns with names that clash."""
    rng = random.Random(3)
    base = long_text(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = "\n".join(long_text(rng, 30) for _ in range(600))
    lines = "\n".join(long_text(rng, 60) for _ in range(3))
    texts = [base, " ".join(near), base.upper(), None, "", "   \n\t ", "one two", "ONE TWO", "one two three four five", long, lines, "x " + lines, lines, "é É ß ſ K İ " + base, " " + base, "a" * 5000, "!!! ... ???"]
    rows = [(i, t, ["en", "de", None][i % 3], ["src1", None, "b2"][i % 3], 1, "r", None, "s", i) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, None, None, None, None, None, None, None), (None, None, "en", "src1", 0, "r", "h", "s", 1), (7, "other text with one id " + long_text(rng, 40), "en", "src1", 0, "r", "h", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def families(spark):
    """Families of near copies around the threshold, a passage that many texts share, and loners."""
    rng = random.Random(11)
    passage = long_text(rng, 50)
    texts = []
    for _ in range(12):
        base = long_text(rng, rng.choice([6, 30, 90, 300])).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(copy) // 15))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [passage + " " + long_text(rng, 40, 10**6) for _ in range(30)]
    base = long_text(rng, 80).split()
    for i in range(120):  # one large family
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(len(copy))] = f"f{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
