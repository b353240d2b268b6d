import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, letters: str = "abcdefghij") -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or longer tuples; what is left out is null."""

    def make(*rows):
        return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null and empty texts, a null id, white space only, a very long text, repeated rows, signs, no word."""
    long = prose(1, 60_000)
    return make_docs(
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (None, prose(2, 80), "en", "b"),
        (4, long, "en", "b"), (5, long, "en", "b"), (6, prose(3, 90), "de", "b"), (6, prose(3, 90), "de", "b"),
        (7, "?!", "de", ""), (8, "x", "fr", "c"), (9, "🙂 ñ 　 ß", "fr", "c"), (10, "no" * 40_000, "fr", "c"),
    )


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs()


def with_clashes(df, *names):
    """df with further columns of the given names."""
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    found = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in found.collect()), key=repr)
