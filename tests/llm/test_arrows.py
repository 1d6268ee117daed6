"""Joins with small tables on both sides of the limit."""

from plumbline.llm import arrows


def test_spread_join_gives_the_same_rows(spark):
    rows = spark.createDataFrame(
        [(i, None if i % 7 == 0 else "hot" if i % 3 else f"k{i}", [i]) for i in range(500)] + [(1, "hot", [1])] * 3,
        "id long, key string, more array<long>",
    )
    side = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "key string, value int")
    found = [
        sorted((str(r) for r in arrows.beside(rows.repartition(3), side, "key", 3, limit).collect()))
        for limit in (arrows.BROADCAST_ROWS, 0)
    ]
    assert found[0] == found[1] and len(found[0]) == 503


def test_spread_join_is_the_same_each_time(spark):
    rows = spark.range(2000).selectExpr("id", "'hot' AS key")
    side = spark.createDataFrame([("hot", 1)], "key string, value int")
    plan = arrows.beside(rows, side, "key", 1, 0)._jdf.queryExecution().toString()
    assert "rand(" not in plan
    assert plan.count("salt") > 0
