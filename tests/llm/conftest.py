import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, h long, t string, count int, kept boolean, score string, size int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


#: Nulls in every column, empty and long texts, copies, repeated rows; other columns bear names that operators use.
def odd_rows() -> list[tuple]:
    long, same = prose(1, 6000), prose(2, 120)
    texts = [(0, long), (1, same), (2, same), (2, same), (3, None), (4, ""), (5, " \t\n"), (None, same), (None, None), (6, same.replace(" ", "\n ")), (7, "é😀 ▁ x  y " + prose(3, 90)), (8, "one two"), (9, long + " end"), (10, prose(4, 2) * 400)]
    return [(i, t, None if k == 1 else "en", None if k in (0, 3) else f"s{k % 2}", None if k == 2 else len(t or ""), "d", 1, 2, "t", 3, True, "x", 9) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
