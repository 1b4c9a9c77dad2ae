import random

import pytest
from pyspark.sql import types as T

WORDS = ("the of and to in that it was for on with as his they be at one have this from or had by hot but some what "
         "there we can out other were all your when up use how said each she").split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    lines = []
    while n > 0:
        k = min(n, rng.randint(5, 14))
        lines.append(" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(k)) + ".")
        n -= k
    return "\n".join(lines)


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, unusual white space and characters."""
    shared = prose(1, 90)
    return [
        (1, shared), (2, shared), (2, shared), (3, prose(2, 30) + "\n" + shared + "\n" + prose(3, 30)),
        (4, None), (5, ""), (None, prose(4, 60)), (None, None), (6, " \n\t "), (7, "one two"),
        (8, "a  b c ▁ d́ \U0001f642\r\n" + prose(5, 40)), (9, prose(6, 9000)),
        (10, "token = \"" + "0123456789abcdef" * 2 + "01234567\" and AKIA" + "ABCD1234" * 2 + "\n" + prose(7, 40)),
        (11, ("same words " * 60).strip()), (12, "x" * 3000),
    ]


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # extra columns named as the operators name theirs
    *(T.StructField(c, T.LongType()) for c in (
        "key", "piece", "start", "length", "ids", "score", "fp", "line", "template", "leaf", "spans", "base", "_row",
        "_id", "_key", "_lines", "_dropped", "_text_key", "n_chars", "sketch", "next_text", "y", "half", "span"))])


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", *([7] * (len(SCHEMA) - 3))) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, odd_rows()).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 13)] + [(None, 1, 0), (3, None, None), (2, 1, 1)],
                                 "doc_id long, quality int, toxic int")
