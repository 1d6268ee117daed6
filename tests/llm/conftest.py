import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that the operators use themselves
        T.StructField("id", T.StringType()),
        T.StructField("key", T.IntegerType()),
        T.StructField("copies", T.IntegerType()),
        T.StructField("Block", T.IntegerType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source), with further columns of clashing names."""

    def make(rows, parts=3):
        rows = [(*r, None, None)[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(parts)

    return make


WORDS = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau été 42".split()


@pytest.fixture
def prose():
    rng = random.Random(3)
    return lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
