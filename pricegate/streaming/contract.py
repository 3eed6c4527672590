"""The contract and the retry rule on a stream of published rows, and revisions as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contract import Contract, with_reason
from ..operators.reconcile import KEY, VALUES
from ..sources.files import merge_days
from ..sources.folders import exists


def marked(rows: DataFrame, c: Contract = Contract()) -> DataFrame:
    """Rows of a stream with their reason; the contract looks at one row at a time, so it runs unchanged."""
    return with_reason(rows, c)


def without_retries(rows: DataFrame, arrived: str = "arrived", delay: str = "2 hours") -> DataFrame:
    """Exact copies of a row dropped while they arrive within ``delay``; state older than that goes."""
    return rows.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([*KEY, *VALUES])


def hourly_rate(rows: DataFrame, arrived: str = "arrived", delay: str = "2 hours") -> DataFrame:
    """published and quarantined by hour of arrival."""
    return rows.withWatermark(arrived, delay).groupBy(F.window(arrived, "1 hour")).agg(F.count("*").alias("published"), F.count("reason").alias("quarantined"))


def revise(path: str, log: str, arrived: str = "arrived"):
    """A foreachBatch function that merges each batch of revisions into the table at ``path``, which is partitioned by day.

    Only days that a batch touches are rewritten; files of others keep their names. A batch is
    committed by a row of the table ``log``; one that comes again, as after a restart, is left
    alone if it is committed, and else merged once more, to the same end.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if exists(spark, log):
            last = spark.read.schema("batch long").parquet(log).agg(F.max("batch")).first()[0]
            if last is not None and number <= last:
                return
        merge_days(path, batch.drop(arrived), f"batch-{number}")
        spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(log)

    return run
