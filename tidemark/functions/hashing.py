"""The shard hash: CRC-32 over a value's little-endian bytes or its UTF-8 text, and what follows from it."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTHS = {"smallint": 4, "int": 8, "bigint": 16}


def little_endian(value: Column, kind: str) -> Column:
    """The bytes of a smallint, int or bigint, lowest first."""
    digits = WIDTHS[kind]
    text = F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(digits))
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(text, F.lit("(..)"), F.lit(1))), ""))


def crc(value: Column, kind: str) -> Column:
    """Unsigned, as a long."""
    if kind in WIDTHS:
        return F.crc32(little_endian(value, kind))
    if kind == "uuid":
        return F.crc32(F.unhex(F.replace(value, F.lit("-"), F.lit(""))))
    return F.crc32(value.cast("binary"))


def hash_value(value: Column, kind: str) -> Column:
    """The hash as a signed int."""
    h = crc(value, kind)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def shard_index(value: Column, kind: str, shards: int = 32) -> Column:
    return (crc(value, kind) % shards).cast("int")


def sharded(df: DataFrame, key: str, shards: int = 32) -> DataFrame:
    """df with its shard_id."""
    return df.withColumn("shard_id", shard_index(F.col(key), df.schema[key].dataType.simpleString(), shards))


def distribute(df: DataFrame, key: str, shards: int = 32) -> DataFrame:
    """One partition for each shard: rows with equal keys lie together, and joins of two tables so dealt out need no shuffle
    by anything else."""
    return sharded(df, key, shards).repartition(shards, "shard_id")


def balance(df: DataFrame, key: str, shards: int = 32) -> DataFrame:
    """One row: mean, stddev (population), least and most rows over all shards, empty ones too, and whether to rebalance."""
    counts = sharded(df, key, shards).groupBy("shard_id").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard_id")).join(counts, "shard_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    out = every.agg(F.avg("n").alias("mean_rows"), F.stddev_pop("n").alias("stddev_rows"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"))
    return out.withColumn("needs_rebalance", F.col("max_rows") > 1.2 * F.col("mean_rows"))


def shard_for_value(value: int | str, kind: str, shards: int = 32) -> int:
    """The shard_index of one value, without a job."""
    if kind in WIDTHS:
        data = int(value).to_bytes(WIDTHS[kind] // 2, "little", signed=True)
    else:
        data = bytes.fromhex(str(value).replace("-", "")) if kind == "uuid" else str(value).encode()
    return zlib.crc32(data) % shards
