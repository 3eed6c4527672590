"""One layout for all tables of hours: buckets by (hub, day), so that joins and groups by hub, day and hour move no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKET = ["hub", "day"]


def write_layout(rows: DataFrame, table: str, buckets: int) -> DataFrame:
    """``rows`` as a table of the catalog in ``buckets`` files by (hub, day), each sorted by hour; replaces one of that name.

    Tables that are to meet must have the same number of buckets: at 100 TB one that makes
    files of some hundred MB. Rows are dealt before they are written, so a bucket is one file.
    """
    spark = rows.sparkSession
    rows.repartition(buckets, *BUCKET).write.mode("overwrite").bucketBy(buckets, *BUCKET).sortBy(*BUCKET, "hour").saveAsTable(table)
    return read_layout(spark, table)


def read_layout(spark: SparkSession, table: str) -> DataFrame:
    """The table, to be joined and grouped in place by any keys that begin with hub and day.

    Spark asks by default that both sides are dealt by all keys of a join; buckets by some of
    them serve as well, and the session is told so.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(table)
