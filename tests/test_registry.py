"""What a registered query's session takes written tables for."""

import pytest
from pyspark.sql import functions as F

from arborframe.operators.core import written
from arborframe.plans.registry import SIZE_FACTOR, Shelf


@pytest.fixture
def plain_factor(spark):
    before = spark.conf.get(SIZE_FACTOR)
    spark.conf.unset(SIZE_FACTOR)
    yield spark
    spark.conf.set(SIZE_FACTOR, before)


def joined(spark, n):
    """Keys of a few bytes a row: 500,000 of them are files of about 2 MB."""
    keys = spark.range(n).select((F.col("id") % 7).cast("string").alias("tree"), "id")
    left, right = (written(keys.withColumn(c, F.col("id") * 2), c) for c in "ab")
    return left.join(right, ["tree", "id"])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_many_small_rows_are_not_broadcast(plain_factor):
    shelf = Shelf()
    shelf.add("many")(lambda spark, sf: joined(spark, 500_000))
    shelf.add("few")(lambda spark, sf: joined(spark, 200))
    assert "Broadcast" in plan_of(joined(plain_factor, 500_000))  # by the files alone
    many = shelf.queries["many"](plain_factor, "")
    assert "Broadcast" not in plan_of(many)
    assert many.count() == 500_000
    assert "Broadcast" in plan_of(shelf.queries["few"](plain_factor, ""))


def test_a_given_factor_stays(plain_factor):
    plain_factor.conf.set(SIZE_FACTOR, "3.0")
    shelf = Shelf()
    shelf.add("few")(lambda spark, sf: spark.range(2))
    shelf.queries["few"](plain_factor, "")
    assert plain_factor.conf.get(SIZE_FACTOR) == "3.0"
