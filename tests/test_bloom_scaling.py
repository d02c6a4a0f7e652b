import time

from pyspark.sql import functions as F

from graphloom.operators import bloom


def test_work_follows_the_values_not_the_number_of_large_filters(spark):
    """The same rows over 40 filters of the largest size, one after the other in turn, as over four."""

    def seconds(filters):
        i = F.col("id")
        v = spark.range(0, 400_000, 1, 1).select((i % filters).cast("string").alias("filter"), (i % 2000).cast("string").alias("value"))
        t = time.time()
        f = bloom.bloom_build(v, bloom.MOST_BITS, 7)
        assert f.agg(F.sum(F.bit_count("bits"))).first()[0] > 10_000
        return time.time() - t

    seconds(1)
    few, many = seconds(4), seconds(40)
    assert many < 3 * few + 2
