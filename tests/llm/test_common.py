"""Stored tables and who deletes them."""

import os
from threading import Thread

from pyspark.sql import functions as F

from pricegate.llm import common


def there(df):
    return os.path.isdir(df.stored_at.removeprefix("file:"))


def test_what_is_stored_on_the_way_goes(spark):
    held = []

    def make():
        held.append(common.stored(spark.range(5), "a"))
        return common.stored_alone(spark, lambda: held.append(common.stored(spark.range(3), "b")) or held[0].filter("id > 1"), "inner").select((F.col("id") * 2).alias("id"))

    out = common.stored_alone(spark, make, "outer")
    assert sorted(r["id"] for r in out.collect()) == [4, 6, 8]
    assert there(out) and not any(there(t) for t in held)
    common.discard(spark, out, spark.range(1))
    assert not there(out)


def test_two_at_a_time_leave_each_other_alone(spark):
    """A pipeline that ends in one thread deletes nothing that another one stored meanwhile."""
    other, seen = [], []

    def make():
        t = Thread(target=lambda: other.append(common.stored(spark.range(4), "other")))
        t.start()
        t.join()
        return spark.range(2)

    seen.append(common.stored_alone(spark, make, "own"))
    assert other[0].count() == 4 and seen[0].count() == 2
