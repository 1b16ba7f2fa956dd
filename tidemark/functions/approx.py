"""Approximate aggregates and sampling over built-in sketches; the t-digest as a mergeable struct."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

ERROR = 0.0081
DIGEST = "centroids array<struct<mean:double,weight:double>>, min double, max double, total double"


def approx_count_distinct(x: Column) -> Column:
    """0 for an empty group; nulls don't count."""
    return F.approx_count_distinct(x, ERROR)


def hll(x: Column, p: int = 14) -> Column:
    """A sketch to store and merge."""
    return F.hll_sketch_agg(x, F.lit(p))


hll_merge, hll_count = F.hll_union_agg, F.hll_sketch_estimate


def approx_percentile(x: Column, p: float, accuracy: int = 10_000) -> Column:
    """p above 1 is read as 0 to 100."""
    return F.percentile_approx(x, F.lit(p / 100 if p > 1 else p), F.lit(accuracy))


def approx_median(x: Column) -> Column:
    return approx_percentile(x, 0.5)


#: How far along a digest's scale a share q lies; centroids are joined within one unit of it. k0 to k3 by number.
def scale(q: np.ndarray, n: float, delta: float, kind: int = 1) -> np.ndarray:
    q = np.clip(q, 1e-15, 1 - 1e-15)
    if kind == 0:
        return delta / 2 * q
    if kind == 1:
        return delta / (2 * np.pi) * np.arcsin(2 * q - 1)
    norm = 4 * np.log(max(n / delta, 1)) + (24 if kind == 2 else 21)
    if kind == 2:
        return delta / norm * np.log(q / (1 - q))
    return delta / norm * np.where(q <= 0.5, np.log(2 * q), -np.log(2 * (1 - q)))


def compressed(means: np.ndarray, weights: np.ndarray, delta: float, kind: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sorted centroids joined as far as the scale function lets them."""
    order = np.argsort(means, kind="stable")
    m, w = means[order], weights[order]
    total = w.sum()
    k = scale((np.cumsum(w) - w / 2) / total, total, delta, kind)
    group = np.floor(k - k[0] if len(k) else k).astype(int)
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ws = np.add.reduceat(w, cut)
    return np.add.reduceat(m * w, cut) / ws, ws


def _digest(parts: list[tuple[np.ndarray, np.ndarray, float, float]], delta: float, kind: int = 1) -> dict:
    if not parts:
        return {"centroids": [], "min": None, "max": None, "total": 0.0}
    m, w = compressed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), delta, kind)
    return {"centroids": [{"mean": float(a), "weight": float(b)} for a, b in zip(m, w)], "min": min(p[2] for p in parts), "max": max(p[3] for p in parts), "total": float(w.sum())}


def _part(d: dict) -> tuple[np.ndarray, np.ndarray, float, float]:
    return np.array([c["mean"] for c in d["centroids"]]), np.array([c["weight"] for c in d["centroids"]]), d["min"], d["max"]


#: Keys whose digests a task holds before it hands them on; tasks whose digests are merged in one place, and how often that is done before
#: the last merge, which is then of a 4,096th as many digests of a key as there are tasks.
HELD, FAN_IN, LEVELS = 10_000, 64, 2


def tdigest(df: DataFrame, x: str, by: list[str], delta: float = 100, kind: int = 1) -> DataFrame:
    """by and `digest`. Each task has one digest for each key, over all of its batches (more if there are over HELD keys); these are merged
    as a tree, those of FAN_IN tasks at a time."""
    names = [f"k_{i}" for i in range(len(by))]
    kinds = [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, by)]

    def first(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def out():
            rows = [(*k, part, d) for k, d in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*names, "part", "digest"])

        for b in batches:
            b = b[b["x"].notna()]
            for k, g in b.groupby(names, dropna=False) if names else [((), b)]:
                if len(g):
                    # a missing key is one key, whatever stands for it
                    k = tuple(None if pd.isna(v) else v for v in (k if isinstance(k, tuple) else (k,)))
                    v = g["x"].to_numpy(float)
                    new = (v, np.ones(len(v)), float(v.min()), float(v.max()))
                    held[k] = _digest([_part(held[k]), new] if k in held else [new], delta, kind)
            if len(held) > HELD:
                yield out()
        yield out()

    parts = df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(x).cast("double").alias("x"))
    parts = parts.mapInPandas(first, ", ".join([*kinds, "part int", f"digest struct<{DIGEST.replace(' array', ':array').replace(' double', ':double')}>"]))
    for _ in range(LEVELS):
        parts = merged(parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")), [*names, "part"], delta, kind)
    return merged(parts, names, delta, kind).select(*[F.col(n).alias(c) for c, n in zip(by, names)], "digest")


def merged(digests: DataFrame, by: list[str], delta: float = 100, kind: int = 1) -> DataFrame:
    """The union of each group's digests, which should be few: each is of a few hundred numbers."""

    @F.pandas_udf(DIGEST)
    def merge(c: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_digest([_part({"centroids": x, "min": a, "max": b})] if len(x) else [], delta, kind) for x, a, b in zip(c, low, high)])

    lists = digests.groupBy(*by).agg(F.flatten(F.collect_list("digest.centroids")).alias("c"), F.min("digest.min").alias("lo"), F.max("digest.max").alias("hi"))
    return lists.select(*by, merge("c", "lo", "hi").alias("digest"))


def _places(d: Column) -> tuple[Column, Column]:
    """Of a digest that isn't empty: values, the least and largest too, and the weight up to each."""
    w = F.transform(d.centroids, lambda c: c.weight)
    upto = F.transform(w, lambda x, i: F.aggregate(F.slice(w, 1, i), F.lit(0.0), lambda a, y: a + y) + x / 2)
    return F.concat(F.array(d["min"]), F.transform(d.centroids, lambda c: c["mean"]), F.array(d["max"])), F.concat(F.array(F.lit(0.0)), upto, F.array(d["total"]))


def _between(xs: Column, ys: Column, x: Column) -> Column:
    """Linear between the last place at or below x and the next one."""
    i = F.greatest(F.size(F.filter(xs, lambda v: v <= x)), F.lit(1))
    at = lambda c, k: F.get(c, k)
    x0, x1, y0, y1 = at(xs, i - 1), at(xs, i), at(ys, i - 1), at(ys, i)
    return F.when(i >= F.size(xs), F.element_at(ys, -1)).when(x1 == x0, y1).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def digest_quantile(digest: Column, q: float) -> Column:
    """The least value at q <= 0, the largest at q >= 1, linear between centroids' middles; null if empty."""
    values, upto = _places(digest)
    return F.when(digest.total > 0, F.when(F.lit(q) <= 0, digest["min"]).when(F.lit(q) >= 1, digest["max"]).otherwise(_between(upto, values, F.lit(float(q)) * digest.total)))


def digest_percentile(digest: Column, p: float) -> Column:
    """The quantile at p of 100."""
    return digest_quantile(digest, p / 100)


def digest_cdf(digest: Column, x: Column | float) -> Column:
    """The share of values up to x: 0 at the least value and below, 1 at the largest and above; null if empty."""
    x = x if isinstance(x, Column) else F.lit(float(x))
    values, upto = _places(digest)
    return F.when(digest.total > 0, F.when(x <= digest["min"], 0.0).when(x >= digest["max"], 1.0).otherwise(_between(values, upto, x) / digest.total))


def digest_info(digest: Column) -> Column:
    """(count, centroids, min, max, mean)."""
    total = F.aggregate(digest.centroids, F.lit(0.0), lambda a, c: a + c["mean"] * c.weight)
    return F.struct(digest.total.alias("count"), F.size(digest.centroids).alias("centroids"), digest["min"].alias("min"), digest["max"].alias("max"), (total / F.when(digest.total > 0, digest.total)).alias("mean"))


def digest_trimmed_mean(digest: Column, low: float, high: float) -> Column:
    """The mean of what lies between two quantiles, by the share of each centroid's weight that does."""
    w = F.transform(digest.centroids, lambda c: c.weight)
    before = lambda i: F.aggregate(F.slice(w, 1, i), F.lit(0.0), lambda a, y: a + y)
    kept = F.transform(digest.centroids, lambda c, i: F.struct(c["mean"].alias("m"), F.greatest(F.lit(0.0), F.least(before(i) + c.weight, high * digest.total) - F.greatest(before(i), low * digest.total)).alias("w")))
    sums = F.aggregate(kept, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, x: F.struct((a.s + x.m * x.w).alias("s"), (a.w + x.w).alias("w")))
    return F.when(sums.w > 0, sums.s / sums.w)


def trimmed_mean(df: DataFrame, x: str, by: list[str], low: float, high: float) -> DataFrame:
    """The mean of what lies between two exact percentiles, both included."""
    bounds = df.groupBy(*by).agg(F.percentile(x, F.lit(low)).alias("_low"), F.percentile(x, F.lit(high)).alias("_high"))
    return df.join(bounds, by).where(F.col(x).between(F.col("_low"), F.col("_high"))).groupBy(*by).agg(F.avg(x).alias("trimmed_mean"))


def hash_sample(df: DataFrame, key: str, p: float, seed: int = 0) -> DataFrame:
    """A Bernoulli sample by the key's hash: the same rows for the same seed, whatever the partitions."""
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < int(p * (1 << 40)))


def sample_rows(df: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """A Bernoulli sample of rows by the hash of all their columns: equal rows are drawn together, the same ones at any partitioning."""
    return df.where(F.pmod(F.xxhash64(F.to_json(F.struct(*df.columns)), F.lit(seed)), F.lit(1 << 40)) < int(p * (1 << 40)))


def system_sample(df: DataFrame, p: float, seed: int = 0, block: str = "_block") -> DataFrame:
    """Whole blocks: a file's stretch that one task reads is drawn or left as one. Only of tables that are read from files."""
    at = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string"))
    return df.withColumn(block, at).where(F.pmod(F.xxhash64(block, F.lit(seed)), F.lit(1 << 40)) < int(p * (1 << 40))).drop(block)


def reservoir(df: DataFrame, x: str, k: int, by: list[str], seed: int = 0, key: str | None = None) -> DataFrame:
    """k values of each group, drawn evenly: those whose hash of key (by default the whole row) is least, so that a task that is run again
    draws the same. Spark limits each task to k rows of a group before rows move, so that no group is gathered whole."""
    draw = F.xxhash64(F.col(key).cast("string") if key else F.to_json(F.struct(*df.columns)), F.lit(seed))
    drawn = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("x"), draw.alias("d"))
    first = drawn.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("d", "x"))).where(F.col("rn") <= k)
    return first.groupBy(*by).agg(F.collect_list("x").alias("sample"))


def reservoir_rows(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows of the whole table: a top-k by hash in each task, then one merge."""
    return df.orderBy(F.xxhash64(F.to_json(F.struct(*df.columns)), F.lit(seed)), F.to_json(F.struct(*df.columns))).limit(k)


def quick_count_distinct(spark: SparkSession, table: str, column: str) -> int:
    return spark.table(table).agg(approx_count_distinct(F.col(column)).alias("x")).first().x


def quick_percentile(spark: SparkSession, table: str, column: str, p: float) -> float | None:
    return spark.table(table).agg(approx_percentile(F.col(column), p).alias("x")).first().x


def quick_median(spark: SparkSession, table: str, column: str) -> float | None:
    return quick_percentile(spark, table, column, 0.5)


def create_sample_view(spark: SparkSession, table: str, rate: float, name: str, seed: int = 0) -> DataFrame:
    """A view of a share of a table's rows."""
    sample_rows(spark.table(table), rate, seed).createOrReplaceTempView(name)
    return spark.table(name)


def table_stats(df: DataFrame) -> DataFrame:
    """column, distinct_count, median, p95 and p99 of each numeric column, in one pass."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")]
    one = df.agg(*[F.struct(F.lit(c).alias("column"), approx_count_distinct(F.col(c)).alias("distinct_count"), *[approx_percentile(F.col(c), p).cast("double").alias(n) for n, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))]).alias(c) for c in names])
    return one.select(F.explode(F.array(*names)).alias("s")).select("s.*")
