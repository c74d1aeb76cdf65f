import pytest
from helpers import rows

from millrace.operators import joins
from millrace.plans.inspect import estimated_bytes, physical_nodes


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.sql("select * from values (1, 1), (2, 1), (3, 2), (4, 9), (5, null) as t(l_id, lk)")
    right = spark.sql("select * from values (1, 'a', 10), (1, 'b', 11), (2, 'c', 12), (3, 'd', 13), (null, 'n', 14) as t(rk, v, pos)")
    return left, right


NODES = {"broadcast": "BroadcastHashJoin", "shuffle_hash": "ShuffledHashJoin", "merge": "SortMergeJoin", "nested_loop": "CartesianProduct", "radix": "ShuffledHashJoin"}


@pytest.mark.parametrize("strategy", [*joins.HINTS, *joins.STRATEGIES])
def test_strategies_agree_and_plan_as_asked(sides, strategy):
    out = joins.equi_join(*sides, "lk", "rk", strategy)
    assert rows(out.select("l_id", "v")) == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "c")]
    if node := NODES.get(joins.STRATEGIES.get(strategy, strategy)):
        assert node in physical_nodes(out)


@pytest.mark.parametrize(("keep", "v"), [("first", "a"), ("last", "b")])
def test_duplicate_policies(sides, keep, v):
    out = joins.equi_join(*sides, "lk", "rk", "broadcast", keep, ["pos"])
    assert rows(out.select("l_id", "v")) == [("1", v), ("2", v), ("3", "c")]
    with pytest.raises(ValueError, match="order"):
        joins.equi_join(*sides, "lk", "rk", duplicates=keep)


def test_large_build_side_is_not_broadcast(sides):
    out = joins.equi_join(*sides, "lk", "rk", "broadcast", most_broadcast=1)
    assert "BroadcastHashJoin" not in physical_nodes(out)
    assert "ShuffledHashJoin" in physical_nodes(out)


def test_sides_of_unknown_size_are_not_broadcast(spark, sides):
    right = spark.createDataFrame(sides[1].collect(), sides[1].schema)
    assert "ShuffledHashJoin" in physical_nodes(joins.equi_join(sides[0], right, "lk", "rk", "broadcast"))


def test_unknown_strategy(sides):
    with pytest.raises(ValueError, match="strategy"):
        joins.equi_join(*sides, "lk", "rk", "fast")


def test_nested_loop_refuses_large_sides(spark, sides):
    wide = spark.range(10_000_000).selectExpr("cast(id as int) as rk", "id as v", "id as pos")
    assert estimated_bytes(wide) > joins.MOST_NESTED
    with pytest.raises(ValueError, match="small"):
        joins.equi_join(sides[0], wide, "lk", "rk", "nested_loop")


def test_zip_pairs_the_lesser_count(spark):
    left = spark.createDataFrame([(7, i) for i in range(3)], "lk int, l int")
    right = spark.createDataFrame([(7, i) for i in range(2)], "rk int, r int")
    assert rows(joins.zip_join(left, right, "lk", "rk", ["l"], ["r"]).select("l", "r")) == [("0", "0"), ("1", "1")]
    assert joins.equi_join(left, right, "lk", "rk").count() == 6


def test_zip_begins_anew_in_each_chunk(spark):
    left = spark.createDataFrame([(7, i) for i in range(5)], "lk int, l int")
    right = spark.createDataFrame([(7, i) for i in range(2)], "rk int, r int")
    out = joins.zip_join_chunked(left, right, "lk", "rk", ["l"], ["r"], 2)
    assert rows(out.select("chunk", "l", "r")) == [("1", "0", "0"), ("1", "1", "1"), ("2", "3", "0"), ("2", "4", "1")]


def test_chunked_build_keeps_the_last_of_each_chunk(spark):
    left = spark.createDataFrame([(1,)], "lk int")
    right = spark.createDataFrame([(1, i) for i in range(6)], "rk int, pos int")
    assert rows(joins.chunked_build_join(left, right, "lk", "rk", ["pos"], 3).select("pos")) == [("1",), ("3",), ("5",)]


def test_range_pruning(spark):
    left = spark.createDataFrame([(i,) for i in range(100)], "lk int")
    right = spark.createDataFrame([(i,) for i in range(40, 50)], "rk int")
    assert joins.range_pruned_join(left, right, "lk", "rk").count() == 10
    assert joins.in_key_range(left, right, "lk", "rk").count() == 10
    none = spark.createDataFrame([(i,) for i in range(200, 210)], "rk int")
    assert joins.range_pruned_join(left, none, "lk", "rk").count() == 0
    assert joins.range_pruned_join(left, none.limit(0), "lk", "rk").count() == 0
