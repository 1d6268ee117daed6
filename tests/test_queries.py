"""Every query beside its SQL, and what its plan must not hold."""

import pytest

from queries import ORACLES, QUERIES
from scripts.compare import difference, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name) is None


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("profile", "recommend", "src_save", "top", "check"))))
def test_no_pairs_of_rows(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
