"""Distributed tables: bucketed by key so that tables of one group join without an exchange, reference tables, and plans of moves."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.sources.files import workspace

STRATEGIES = ("hash", "range", "list", "composite", "reference")


@dataclass
class Placement:
    """Where a table's rows lie. keys: one column; more of a composite."""

    table: str
    strategy: str
    keys: tuple[str, ...]
    shards: int
    path: str

    @property
    def group(self) -> tuple[str, int, int]:
        """Tables of one group are co-located if they are joined on their keys."""
        return self.strategy, len(self.keys), self.shards


@dataclass
class Cluster:
    spark: SparkSession
    placed: dict[str, Placement] = field(default_factory=dict)

    def create(self, name: str, df: DataFrame, keys: str | list[str], shards: int = 32, strategy: str = "hash", colocate_with: str | None = None) -> Placement:
        """Writes df dealt out by its keys. hash and composite: a bucketed table, so that a join on the keys needs no exchange and an equality
        prunes buckets. range: files of key ranges in order, which their statistics prune. list: a folder for each value."""
        keys = (keys,) if isinstance(keys, str) else tuple(keys)
        if strategy not in STRATEGIES or (strategy == "composite") != (len(keys) > 1) or name in self.placed:
            raise ValueError(f"{name} can't be placed by {strategy} of {keys}")
        if colocate_with:
            other = self.placed[colocate_with]
            if other.strategy != strategy or len(other.keys) != len(keys):
                raise ValueError(f"{name} can't be placed with {colocate_with}")
            shards = other.shards
        path, table = workspace(self.spark, name), f"{name}_{uuid.uuid4().hex}"
        if strategy in ("hash", "composite"):
            df.repartition(shards, *keys).write.bucketBy(shards, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        elif strategy == "range":
            df.repartitionByRange(shards, keys[0]).sortWithinPartitions(keys[0]).write.option("path", path).saveAsTable(table)
        elif strategy == "list":
            # a value's rows are spread over tasks, as one value may hold most of them
            df.repartition(shards, *keys, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy(keys[0]).option("path", path).saveAsTable(table)
        self.placed[name] = Placement(table, strategy, keys, shards, path)
        return self.placed[name]

    def create_reference(self, name: str, df: DataFrame) -> Placement:
        """A small table that is whole everywhere: joins broadcast it."""
        path, table = workspace(self.spark, name), f"{name}_{uuid.uuid4().hex}"
        df.write.option("path", path).saveAsTable(table)
        self.placed[name] = Placement(table, "reference", (), 1, path)
        return self.placed[name]

    def read(self, name: str) -> DataFrame:
        p = self.placed[name]
        df = self.spark.table(p.table)
        return F.broadcast(df) if p.strategy == "reference" else df

    def colocated(self, a: str, b: str) -> bool:
        p, q = self.placed[a], self.placed[b]
        return "reference" in (p.strategy, q.strategy) or (p.group == q.group and p.strategy in ("hash", "composite"))

    def join(self, a: str, b: str, how: str = "inner") -> DataFrame:
        """On the tables' keys; both sides' buckets are merged as they lie, unless one is a reference table."""
        p, q = self.placed[a], self.placed[b]
        if len(p.keys) != len(q.keys):
            raise ValueError(f"{a} and {b} have no common keys")
        l, r = self.read(a), self.read(b)
        if self.colocated(a, b) and "reference" not in (p.strategy, q.strategy):
            l, r = l.hint("merge"), r.hint("merge")
        on = [l[x] == r[y] for x, y in zip(p.keys, q.keys)]
        return l.join(r, on, how)

    def shard_for_value(self, name: str, value: int | str) -> int:
        p = self.placed[name]
        return hashing.shard_for_value(value, self.spark.table(p.table).schema[p.keys[0]].dataType.simpleString(), p.shards)

    def append(self, name: str, df: DataFrame) -> None:
        """Rows go to their places."""
        p = self.placed[name]
        w = (df.repartition(p.shards, *p.keys) if p.keys else df).write.mode("append")
        if p.strategy in ("hash", "composite"):
            w = w.bucketBy(p.shards, *p.keys).sortBy(*p.keys)
        (w.partitionBy(*p.keys) if p.strategy == "list" else w).saveAsTable(p.table)

    def reshard(self, name: str, shards: int) -> Placement:
        """Splits or merges shards: the table is written anew for another number of them."""
        old = self.placed.pop(name)
        new = self.create(name, self.spark.table(old.table), list(old.keys) if len(old.keys) > 1 else old.keys[0], shards, old.strategy)
        self.forget(old)
        return new

    def undistribute(self, name: str) -> DataFrame:
        """The rows as a plain table, which is written before the old one goes."""
        old = self.placed.pop(name)
        path = workspace(self.spark, name)
        self.spark.table(old.table).write.parquet(path)
        self.forget(old)
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        self.forget(self.placed.pop(name))

    def forget(self, old: Placement) -> None:
        self.spark.sql(f"DROP TABLE {old.table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(old.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def moves(rows: dict[int, int], nodes: dict[int, str], names: list[str], drain: str | None = None, slack: float = 0.1) -> list[tuple[int, str, str]]:
    """(shard, from, to) that even out nodes: from the fullest to the emptiest, the largest shard that makes neither worse, until the
    fullest has at most slack more than the mean. With drain that node is emptied. Only the counts of shards are looked at."""
    at, out = dict(nodes), []
    left = [n for n in names if n != drain]
    load = {n: sum(rows[s] for s in rows if at[s] == n) for n in names}

    def go(s: int, to: str) -> None:
        out.append((s, at[s], to))
        load[at[s]] -= rows[s]
        load[to] += rows[s]
        at[s] = to

    if drain is not None:
        for s in sorted((s for s in rows if at[s] == drain), key=lambda s: (-rows[s], s)):
            go(s, min(left, key=lambda n: (load[n], n)))
    mean = sum(load.values()) / max(1, len(left))
    while True:
        top, low = max(left, key=lambda n: (load[n], n)), min(left, key=lambda n: (load[n], n))
        fits = [s for s in rows if at[s] == top and 0 < rows[s] < load[top] - load[low]]
        if load[top] <= mean * (1 + slack) or not fits:
            return out
        go(max(fits, key=lambda s: (min(rows[s], load[top] - load[low] - rows[s]), -s)), low)
