"""Ranks and row numbers of partitions that one task can't sort: by counts of smaller groups first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df with rank, dense_rank, percent_rank and cume_dist by one column. Rows that tie are counted before anything is sorted, so that a
    task sorts the different values of a partition, not its rows, and rows find their rank by a join on the value. Nulls come last and tie."""
    n = df.groupBy(*by, order).agg(F.count("*").alias("_n"))
    keys = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())
    before = F.sum("_n").over(keys) - F.col("_n")
    whole = F.sum("_n").over(Window.partitionBy(*by))
    n = n.select(*[F.col(c).alias(f"_{c}") for c in [*by, order]], (before + 1).alias("rank"), F.row_number().over(keys).cast("long").alias("dense_rank"), F.when(whole > 1, before / (whole - 1)).otherwise(0.0).alias("percent_rank"), ((before + F.col("_n")) / whole).alias("cume_dist"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, order]]
    return df.join(n, on).drop(*[f"_{c}" for c in [*by, order]])


def row_numbers(df: DataFrame, by: list[str], order: list[str], part: Column) -> DataFrame:
    """df with row_number and partition_rows. part cuts each partition into stretches that are in the order of the first order column, such as
    hours of a time: a task sorts one stretch, and the rows before it are a sum over the counts of stretches."""
    cut = df.withColumn("_part", part)
    n = cut.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.col("_part").asc_nulls_last())
    n = n.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("partition_rows"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_part").eqNullSafe(F.col("_p"))]
    return cut.withColumn("_own", own).join(n, on).withColumn("row_number", F.col("_before") + F.col("_own")).drop("_part", "_p", "_own", "_before", *[f"_{c}" for c in by])


def ntile(row_number: Column, rows: Column, n: int) -> Column:
    """The tile of a row: the first rows % n tiles have one more than the others."""
    small, large = F.floor(rows / n), rows % n
    first = large * (small + 1)
    return F.when(row_number <= first, F.ceil(row_number / (small + 1))).otherwise(large + F.ceil((row_number - first) / small)).cast("long")
