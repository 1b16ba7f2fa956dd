"""Joins that SQL's equality doesn't say: the last row before, and points in intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, time: str, right_time: str, by: list[str], columns: list[str]) -> DataFrame:
    """left with columns of the last row of right, by key, whose time is left's or earlier; nulls where there is none. Of right rows with
    equal times that with the largest columns counts. One union and one window by key, no pairs; keys that are null don't match."""
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in by]
    l = left.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(f"struct<{','.join(f'{c}:{right.schema[c].dataType.simpleString()}' for c in columns)}>").alias("_found"))
    row = F.lit(None).cast(l.schema["_row"].dataType).alias("_row")
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), row, F.struct(*columns).alias("_found"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_found").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_found", F.last("_found", ignorenulls=True).over(w)).where("_side = 1")
    known = F.lit(True)
    for k in by:
        known = known & F.col(f"_row.{k}").isNotNull()
    return both.select("_row.*", *[F.when(known, F.col(f"_found.{c}")).alias(c) for c in columns])


def in_range(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs with start <= point < end. Both sides are dealt out by stretches of width, an interval to each that it touches, and compared
    within these alone: width should be about an interval's length, so that an interval touches few."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    i = intervals.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(i, "_b").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_b")


def not_in(left: DataFrame, column: str, right: DataFrame, right_column: str) -> DataFrame:
    """The rows of left whose value isn't among right's, as SQL has it: none if right has a null, all if right is empty, and no row with a null
    unless right is empty. The null is looked for once; then it is an anti join on right's different values, and nothing is broadcast unasked."""
    values = right.select(F.col(right_column).alias("_v")).distinct()
    found = values.agg(F.count("*").alias("n"), F.count("_v").alias("known")).first()
    if found.n == 0:
        return left
    if found.known < found.n:
        return left.limit(0)
    return left.where(F.col(column).isNotNull()).join(values, F.col(column) == F.col("_v"), "left_anti")
