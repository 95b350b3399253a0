"""Running values and neighbours over range parts against Spark's own windows: hot groups, null keys, empty tables."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netlex.operators.ranges import neighbours, running


@pytest.fixture(scope="module")
def rows(spark):
    # One group holds most rows, so it spans several parts; one key is null; order has nulls.
    data = [("hot", i if i else None, i * i % 7) for i in range(300)] + [(k, i, i) for k in ("a", "z", None) for i in range(5)]
    return spark.createDataFrame(data, "k string, o int, v long").repartition(5)


def test_running(spark, rows):
    for inclusive in (True, False):
        w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        values = {"total": (F.sum, F.col("v")), "mixed": (F.bit_xor, F.xxhash64("k", "o")), "n": (F.count, F.lit(1)), "most": (F.max, F.col("v"))}
        got = running(rows, ["k"], ["o"], values, inclusive)
        want = rows.withColumns({n: f(c).over(w) for n, (f, c) in values.items()})
        if not inclusive:
            want = want.withColumn("n", F.when(F.col("n") > 0, F.col("n")))
            got = got.withColumn("n", F.when(F.col("n") > 0, F.col("n")))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert running(rows.limit(0), ["k"], ["o"], values).count() == 0


def test_neighbours(rows):
    w = Window.partitionBy("k").orderBy("o")
    for ahead, f in ((False, F.lag), (True, F.lead)):
        got = neighbours(rows, ["k"], ["o"], {"v2": "v", "o2": "o"}, ahead)
        want = rows.withColumns({"v2": f("v").over(w), "o2": f("o").over(w)})
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_over_many_parts(spark, rows):
    # Small parts are merged by adaptive execution, so only without that does a group span several of them.
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("false", "23"), strict=True):
            spark.conf.set(n, v)
        test_running(spark, rows)
        test_neighbours(rows)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
