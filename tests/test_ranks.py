"""Places in a whole order against sorting in Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilewright.operators.ranks import numbered


@pytest.mark.parametrize("groups", [[None], ["a"], ["a", "a", "a", "b", None]])
def test_numbered(spark, groups):
    rng = random.Random(3)
    rows = [(rng.choice(groups), rng.randrange(40), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    got = {r["i"]: r["place"] for r in numbered(df, F.desc("v"), F.asc("i"), within=F.col("g")).collect()}
    want, seen = {}, Counter()
    for g, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        want[i] = seen[g]
        seen[g] += 1
    assert got == want
    got = {r["i"]: r["n"] for r in numbered(df, F.desc("v"), F.asc("i"), name="n").collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}


def test_numbered_of_no_rows(spark):
    assert numbered(spark.createDataFrame([], "v long"), F.asc("v")).count() == 0


def test_a_hot_group_is_spread_over_tasks(spark):
    df = spark.range(20000).selectExpr("id", "if(id % 3 = 0, id, 0) as g")
    sizes = df.withColumn("__group", F.col("g")).repartitionByRange(8, "__group", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2 * 20000 / 8
    assert numbered(df, F.asc("id"), within=F.col("g")).filter("g = 0").agg(F.max("place")).first()[0] == df.filter("g = 0").count() - 1
