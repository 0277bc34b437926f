import random

import pytest

WORDS = [a + b for a in "ka lo mi ne ru ta vo".split() for b in "bel dor fin gus hal jet".split()]


@pytest.fixture(scope="session")
def prose():
    """prose(words, seed) -> text of invented words"""

    def text(words: int, seed: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(words))

    return text


@pytest.fixture(scope="session")
def documents(spark):
    """documents((doc_id, text), ...) -> DataFrame with an extra column whose name clashes with results"""
    return lambda *rows: spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, score int")
