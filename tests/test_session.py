import pytest
from pyspark.sql import functions as F

from parcelwise.session import MEASURED_THRESHOLD, PLANNED_THRESHOLD, stored


@pytest.fixture
def small_broadcasts(spark):
    before = spark.conf.get(PLANNED_THRESHOLD)
    spark.conf.set(PLANNED_THRESHOLD, "300k")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    yield
    spark.conf.set(PLANNED_THRESHOLD, before)
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_exploded_rows_are_sized_before_they_are_broadcast(spark, small_broadcasts):
    few = stored(spark.range(1000), "few")
    many = few.select(F.explode(F.sequence(F.col("id") * 100, F.col("id") * 100 + 99)).alias("id"), F.lit("x" * 20).alias("x"))
    joined = stored(spark.range(2_000_000), "all").join(many, "id")
    with pytest.raises(Exception, match="(?i)broadcast"):
        stored(joined, "planned")
    assert stored(joined, "measured", measured=True).count() == 100_000
    assert spark.conf.get(PLANNED_THRESHOLD) == "300k" and spark.conf.get(MEASURED_THRESHOLD, None) is None
