"""Columns that are computed once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """df, if it comes from fewer files than there are cores, dealt to as many partitions as a shuffle has (at least one a core).

    For costly work a row: a file of one row group is read by one task, however
    many cores there are.
    """
    spark = df.sparkSession
    if len(df.inputFiles()) >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, computed once a row.

    They come out of a one-row generator, which the optimizer neither merges
    with later projections nor looks through for filters: costly expressions
    (dozens of regular expressions a rail) would be copied into each use else.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
