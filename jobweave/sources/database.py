"""Tables of an outside database, read as snapshots over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, key: str | None = None, partitions: int = 8, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table as a DataFrame: only `columns`, in `partitions` ranges of the whole-number `key` if one is named.

    Column choice and filters that follow are pushed to the database; the ranges come from its own smallest and largest key,
    so the read is one bounded connection for each partition.
    """
    base = spark.read.format("jdbc").options(url=url, fetchsize=str(fetch), **options)
    whole = base.option("dbtable", table).load()
    if key is not None:
        low, high = whole.agg(F.min(key), F.max(key)).first()
        if low is not None:
            ranged = dict(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions))
            whole = base.options(dbtable=table, **ranged).load()
    return whole.select(*columns) if columns else whole
