import random

from drydock.common import hot_keys, salted_join
from drydock.operators import ordered


def test_fill_forward_across_blocks(spark, rows):
    r = random.Random(1)
    data = [(k, i, i // 8, f"h{i}" if r.random() < 0.1 else None) for k in ("a", "b", None) for i in range(100)]
    df = spark.createDataFrame(data, "k string, i int, b int, v string")
    want = []
    for k in ("a", "b", None):
        last = None
        for kk, i, _, v in data:
            if kk == k:
                last = v or last
                want.append((k, i, last))
    assert rows(ordered.fill_forward(df, "k", ["i"], "v", "b", "o"), "k", "i", "o") == sorted(want, key=repr)


def test_numbered(spark, rows):
    df = spark.createDataFrame([(k, i, i // 7) for k in "ab" for i in range(50)], "k string, i int, b int")
    assert rows(ordered.numbered(df, "k", ["i"], "b", "n"), "k", "i", "n") == sorted(((k, i, i + 1) for k in "ab" for i in range(50)), key=repr)
    assert rows(ordered.numbered(df, None, ["i", "k"], "b", "n"), "n") == sorted(((n + 1,) for n in range(100)), key=repr)


def test_salted_join_with_a_hot_key(spark, rows):
    left = spark.range(30_000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 5 = 0 then null else concat('k', id % 5000) end as k")
    right = spark.createDataFrame([("hot", 1), ("k7", 2), (None, 3)], "k string, v int")
    assert hot_keys(left.select("k"), "k").count() == 1
    inner = salted_join(left, right, "k", "inner", "id")
    assert inner.groupBy("v").count().orderBy("v").collect()[0]["count"] == 10_000
    assert salted_join(left, right, "k", "left", "id").count() == 30_000
    assert salted_join(left, right, "k", "left_semi", "id").count() == inner.count()


def test_latest(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, o int, v string")
    assert rows(ordered.latest(df, "k", ["o"], ["v"])) == [("a", "y"), ("b", None)]
