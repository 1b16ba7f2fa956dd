"""Table services: hypertables in time chunks, continuous aggregates, policies, dynamic tables, tiers, encodings."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions import time as tm
from tidemark.operators.changes import matched


def refreshed(materialized: DataFrame, source: DataFrame, aggregate: Callable[[DataFrame], DataFrame], dirty: DataFrame, bucketed: Callable[[DataFrame], DataFrame], bucket: str = "bucket") -> DataFrame:
    """materialized with the dirty buckets computed anew from source: the same as computing all of it. Source rows of other
    buckets are left out before they are aggregated."""
    again = aggregate(matched(bucketed(source), dirty, [bucket], "left_semi").drop(bucket))
    return matched(materialized, dirty, [bucket], "left_anti").unionByName(again)


def dynamic_increment(materialized: DataFrame, source: DataFrame, query: Callable[[DataFrame], DataFrame], changed: DataFrame, keys: list[str]) -> DataFrame:
    """materialized with the changed keys' rows, null keys too, replaced by what the query gives for them now."""
    return matched(materialized, changed, keys, "left_anti").unionByName(query(matched(source, changed, keys, "left_semi")))


def dirty_buckets(changed: DataFrame, width: str, time: str, bucket: str = "bucket") -> DataFrame:
    """The invalidation log of a change set: the buckets that its rows fall into, those of null times too."""
    return changed.select(tm.time_bucket(width, F.col(time)).alias(bucket)).distinct()


def dirty_range(changed: DataFrame, width: str, time: str) -> DataFrame:
    """The same as one row: the first bucket's start and the last one's end."""
    c = changed.select(tm.chunk_range(width, F.col(time)).alias("c"))
    return c.agg(F.min("c.start").alias("start"), F.max("c.end").alias("end"))


#: Ages from which a chunk leaves a tier.
TIERS = (("hot", timedelta(hours=24)), ("warm", timedelta(days=7)), ("cold", timedelta(days=30)))


#: A tier's codec: the colder, the smaller.
TIER_CODECS = {"hot": "snappy", "warm": "lz4", "cold": "zstd", "frozen": "zstd"}


def tier(last: Column, now: datetime, tiers: tuple[tuple[str, timedelta], ...] = TIERS) -> Column:
    """By the time of a chunk's last row; the oldest are frozen."""
    out, at = F.lit("frozen"), F.lit(now).cast("timestamp_ntz")
    for name, age in reversed(tiers):
        out = F.when(last >= at - F.expr(f"INTERVAL {int(age.total_seconds())} SECOND"), name).otherwise(out)
    return out


def encoding_advice(df: DataFrame, ratio: float = 0.1, few: int = 256) -> DataFrame:
    """(column, encoding): integers and times delta, floats gorilla, booleans rle, text dictionary if its values are few for
    its rows, else zstd. One pass, with distinct counts by sketch."""
    kinds = {"byte": "delta", "short": "delta", "integer": "delta", "long": "delta", "timestamp": "delta", "timestamp_ntz": "delta", "date": "delta", "float": "gorilla", "double": "gorilla", "boolean": "rle"}
    text = [f.name for f in df.schema if f.dataType.typeName() not in kinds]
    one = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(c).alias(f"d_{c}") for c in text])
    fixed = {f.name: F.lit(kinds[f.dataType.typeName()]) for f in df.schema if f.name not in text}
    by_values = {c: F.when((F.col(f"d_{c}") < F.col("n") * ratio) | (F.col(f"d_{c}") < few), "dictionary").otherwise("zstd") for c in text}
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (fixed | by_values)[c].alias("encoding")) for c in df.columns])).alias("x")).select("x.*")


@dataclass
class Hypertable:
    """Rows in Parquet folders by chunk_start, and by a hash of `space` where that is set. Time filters on chunk_start prune
    folders; times within a chunk go down to row groups."""

    spark: SparkSession
    path: str
    time: str
    width: str = "1 day"
    space: str | None = None
    spaces: int = 4
    tiers: dict[str, str] = field(default_factory=dict)

    def placed(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("chunk_start", F.date_format(tm.time_bucket(self.width, F.col(self.time)), "yyyy-MM-dd'T'HHmmss"))
        if self.space:
            df = df.withColumn("space_id", hashing.shard_index(F.col(self.space), df.schema[self.space].dataType.simpleString(), self.spaces))
        return df

    @property
    def parts(self) -> list[str]:
        return ["chunk_start", *["space_id"] * bool(self.space)]

    def insert(self, df: DataFrame) -> None:
        """A chunk's rows are spread over tasks by the time within it, so that a busy chunk doesn't land in one."""
        placed = self.placed(df)
        placed.repartition(*self.parts, F.pmod(F.xxhash64(self.time), F.lit(16))).write.mode("append").partitionBy(*self.parts).parquet(self.path)

    def folders(self) -> list[str]:
        """The table's own folder and those of its tiers, as far as they have chunks."""
        self.recover()
        return [p for p in (self.path, *self.tiers.values()) if self.starts(p)]

    def whole(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in self.folders()])

    def read(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Rows with start <= time < end; only chunks that overlap are listed."""
        df = self.whole()
        key = lambda t: F.date_format(tm.time_bucket(self.width, F.lit(t).cast("timestamp_ntz")), "yyyy-MM-dd'T'HHmmss")
        if start:
            df = df.where((F.col("chunk_start") >= key(start)) & (F.col(self.time) >= F.lit(start).cast("timestamp_ntz")))
        if end:
            df = df.where((F.col("chunk_start") <= key(end)) & (F.col(self.time) < F.lit(end).cast("timestamp_ntz")))
        return df.drop(*self.parts)

    def having(self, value: int | str) -> DataFrame:
        """Rows whose space column has a value, from the folders of its hash alone."""
        if not self.space:
            raise ValueError("there is no space column")
        df = self.whole()
        at = hashing.shard_for_value(value, df.schema[self.space].dataType.simpleString(), self.spaces)
        return df.where((F.col("space_id") == at) & (F.col(self.space) == value)).drop(*self.parts)

    def chunks(self) -> DataFrame:
        return self.whole().groupBy("chunk_start").agg(F.count("*").alias("n"), F.min(self.time).alias("first"), F.max(self.time).alias("last"))

    def _folder(self, chunk: str, root: str | None = None):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{root or self.path}/chunk_start={chunk}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, root: str) -> list[str]:
        fs, _ = self._folder("", root)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(root)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def starts(self, root: str | None = None) -> list[str]:
        """The names of chunks, from their folders alone."""
        return [n.removeprefix("chunk_start=") for n in self._names(root or self.path) if n.startswith("chunk_start=")]

    def drop_chunks(self, older_than: datetime) -> list[str]:
        """Deletes chunks that end at or before the cutoff; one that straddles it stays."""
        width = timedelta(microseconds=tm.micros(self.width))
        gone = [(c, r) for r in (self.path, *self.tiers.values()) for c in self.starts(r) if datetime.strptime(c, "%Y-%m-%dT%H%M%S") + width <= older_than]
        for c, root in gone:
            fs, p = self._folder(c, root)
            fs.delete(p, True)
        return sorted({c for c, _ in gone})

    def compress_chunk(self, chunk: str, codec: str = "zstd", order: list[str] | None = None) -> None:
        """Writes a chunk anew, sorted within files, with Parquet's second writer (deltas for integers and times, dictionaries and runs for
        what repeats), and puts it in the old one's place. The old one is kept until the new one is there: what is cut short between the two
        renames is mended by whoever reads next (`recover`)."""
        self.recover()
        fs, p = self._folder(chunk)
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        new, old = f"{self.path}/_new_{chunk}", Path(f"{self.path}/_old_{chunk}")
        self._write(self.spark.read.parquet(p.toString()), new, codec, order)
        fs.rename(p, old)
        fs.rename(Path(new), p)
        fs.delete(old, True)

    def _write(self, df: DataFrame, path: str, codec: str, order: list[str] | None = None) -> None:
        w = df.sortWithinPartitions(*(order or [self.time])).write.mode("overwrite").option("compression", codec).option("parquet.writer.version", "PARQUET_2_0")
        (w.partitionBy("space_id") if self.space else w).parquet(path)

    def recover(self) -> None:
        """Ends swaps that were cut short: an old chunk comes back if the new one isn't in its place, and goes if it is."""
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in self._names(self.path):
            if name.startswith("_old_"):
                fs, p = self._folder(name.removeprefix("_old_"))
                old = Path(f"{self.path}/{name}")
                fs.delete(old, True) if fs.exists(p) else fs.rename(old, p)

    def move_chunk(self, chunk: str, to: str) -> None:
        """Writes a chunk to a tier's folder, in that tier's codec, and then deletes it here. While it is in both, the move is done again."""
        root = next(p for p in (self.path, *self.tiers.values()) if chunk in self.starts(p))
        if root != self.tiers[to]:
            self._write(self.spark.read.parquet(f"{root}/chunk_start={chunk}"), f"{self.tiers[to]}/chunk_start={chunk}", TIER_CODECS.get(to, "zstd"))
            fs, p = self._folder(chunk, root)
            fs.delete(p, True)

    def decompress_chunk(self, chunk: str) -> None:
        self.compress_chunk(chunk, "none")


@dataclass
class ContinuousAggregate:
    """A materialized aggregate of a hypertable by bucket. aggregate must keep sums and counts, not means.

    Rows lie in folders by the day of their bucket. A list of the folders that are current is written under a new number by one rename, so that
    readers see the state before a refresh or after it, and a refresh writes only the days that it touches."""

    source: Hypertable
    path: str
    width: str
    aggregate: Callable[[DataFrame], DataFrame]

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", tm.time_bucket(self.width, F.col(self.source.time)))

    def _fs(self):
        self._path = self.source.spark._jvm.org.apache.hadoop.fs.Path
        return self._path(self.path).getFileSystem(self.source.spark._jsc.hadoopConfiguration())

    def _lists(self) -> list[int]:
        fs = self._fs()
        at = self._path(f"{self.path}/lists")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> dict[str, str]:
        """Folder by day."""
        known = self._lists()
        if not known:
            raise ValueError(f"there is no aggregate at {self.path}")
        return dict(r.value.split(" ", 1) for r in self.source.spark.read.text(f"{self.path}/lists/{known[-1]}").collect() if r.value)

    def _publish(self, days: dict[str, str]) -> None:
        fs, number = self._fs(), (self._lists() or [0])[-1] + 1
        draft = self._path(f"{self.path}/lists/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray("\n".join(f"{d} {p}" for d, p in sorted(days.items())).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"{self.path}/lists/{number}")):
            raise RuntimeError(f"another refresh has written list {number}")

    def _stored(self, df: DataFrame) -> dict[str, str]:
        """df written by day; the folders it has made."""
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        df.withColumn("_day", F.coalesce(F.date_format("bucket", "yyyy-MM-dd"), F.lit("none"))).write.partitionBy("_day").parquet(at)
        found = self._fs().listStatus(self._path(at))
        return {n.removeprefix("_day="): f"{at}/{n}" for n in (s.getPath().getName() for s in found) if n.startswith("_day=")}

    def read(self, days: list[str] | None = None) -> DataFrame:
        """All rows, or those of some days."""
        at = [p for d, p in self.current().items() if days is None or d in days]
        return self.source.spark.read.parquet(*at) if at else self.aggregate(self.bucketed(self.source.read())).limit(0)

    def create(self) -> None:
        self._publish(self._stored(self.aggregate(self.bucketed(self.source.read()))))

    def refresh(self, start: datetime, end: datetime) -> None:
        """Computes the buckets from start's up to end's again, and no others."""
        spark = self.source.spark
        w = timedelta(microseconds=tm.micros(self.width))
        edge = lambda t: spark.range(1).select(tm.time_bucket(self.width, F.lit(t).cast("timestamp_ntz"))).first()[0]
        lo, hi = edge(start), edge(end) + w
        last = hi - timedelta(microseconds=1)
        inside = F.col("bucket").between(F.lit(lo).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
        touched = [f"{lo + timedelta(days=i):%Y-%m-%d}" for i in range((last.date() - lo.date()).days + 1)]
        again = self.aggregate(self.bucketed(self.source.read(lo, hi)))
        before = self.current()
        if any(d in before for d in touched):
            kept = self.read(touched).where(~inside)
            again = kept.unionByName(again.select(*kept.columns))
        self._publish({d: p for d, p in before.items() if d not in touched} | self._stored(again))

    def refresh_changed(self, changed: DataFrame) -> None:
        """Refreshes from the first to the last bucket of a change set's rows."""
        r = dirty_range(changed, self.width, self.source.time).first()
        if r.start is not None:
            self.refresh(r.start, r.end - timedelta(microseconds=1))

    def drop(self) -> None:
        self._fs().delete(self._path(self.path), True)


@dataclass
class Policy:
    kind: str  # retention, compression, refresh or tiering
    after: timedelta
    every: timedelta = timedelta(days=1)
    end_after: timedelta = timedelta(0)
    aggregate: ContinuousAggregate | None = None
    last_run: datetime | None = None
    done: list[str] = field(default_factory=list)


@dataclass
class Maintenance:
    """Policies of one hypertable, run when they are due."""

    table: Hypertable
    policies: list[Policy] = field(default_factory=list)

    def add(self, policy: Policy) -> Policy:
        self.policies.append(policy)
        return policy

    def remove(self, kind: str) -> None:
        self.policies = [p for p in self.policies if p.kind != kind]

    def tiered(self, now: datetime) -> list[str]:
        """Moves each chunk to the tier of its age, where the table has a folder for it."""
        width, did = timedelta(microseconds=tm.micros(self.table.width)), []
        for root in (self.table.path, *self.table.tiers.values()):
            for c in self.table.starts(root):
                age = now - (datetime.strptime(c, "%Y-%m-%dT%H%M%S") + width)
                name = next((n for n, most in TIERS if age <= most), "frozen")
                if name in self.table.tiers and root != self.table.tiers[name]:
                    self.table.move_chunk(c, name)
                    did.append(f"move {c} to {name}")
        return did

    def run(self, now: datetime) -> list[str]:
        """Runs the due policies and says what it did."""
        did = []
        for p in self.policies:
            if p.last_run and p.last_run + p.every > now:
                continue
            if p.kind == "retention":
                did += [f"drop {c}" for c in self.table.drop_chunks(now - p.after)]
            elif p.kind == "compression":
                width = timedelta(microseconds=tm.micros(self.table.width))
                for c in self.table.starts():
                    if c not in p.done and datetime.strptime(c, "%Y-%m-%dT%H%M%S") + width <= now - p.after:
                        self.table.compress_chunk(c)
                        p.done.append(c)
                        did.append(f"compress {c}")
            elif p.kind == "tiering":
                did += self.tiered(now)
            elif p.kind == "refresh" and p.aggregate:
                p.aggregate.refresh(now - p.after, now - p.end_after)
                did.append("refresh")
            p.last_run = now
        return did


@dataclass
class DynamicTable:
    """A query's stored result that may lag behind by target_lag. query gives it from the source tables by name.

    mode: full computes all again. incremental asks `changed` for the keys that have changed since the last refresh and computes only these;
    auto is incremental where there is `changed`. Each refresh writes a new version and the list of versions is what readers go by, so that the
    old result is there until the new one is whole."""

    spark: SparkSession
    path: str
    query: Callable[[SparkSession], DataFrame]
    target_lag: timedelta = timedelta(minutes=1)
    last_refresh: datetime | None = None
    suspended: bool = False
    mode: str = "auto"
    keys: list[str] = field(default_factory=list)
    source: Callable[[SparkSession], DataFrame] | None = None
    compute: Callable[[DataFrame], DataFrame] | None = None
    changed: Callable[[SparkSession, datetime], DataFrame] | None = None
    history: list[tuple[datetime, str]] = field(default_factory=list)

    def __post_init__(self):
        if self.target_lag < timedelta(seconds=60):
            raise ValueError("the least lag is a minute")
        if self.mode not in ("auto", "full", "incremental"):
            raise ValueError(f"no such mode: {self.mode}")
        self.incremental = self.mode != "full" and bool(self.changed and self.source and self.compute and self.keys)
        if self.mode == "incremental" and not self.incremental:
            raise ValueError("an incremental table needs its keys, its source, what to compute and what has changed")

    def sources(self) -> list[str]:
        """What the query reads, from its plan: files, and tables by name."""
        df = self.query(self.spark)
        plan = df._jdf.queryExecution().analyzed()
        leaves = [str(x) for x in _scala(plan.collectLeaves())]
        return sorted({*df.inputFiles(), *(m for x in leaves for m in re.findall(r"spark_catalog\.([\w.]+)", x))})

    def needs_refresh(self, now: datetime) -> bool:
        return not self.suspended and (self.last_refresh is None or now - self.last_refresh > self.target_lag)

    def next_refresh(self) -> datetime | None:
        return self.last_refresh and self.last_refresh + self.target_lag

    def version(self) -> str | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        whole = [n for n in names if n.startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(whole, default=None)

    def read(self) -> DataFrame:
        """The newest version that is whole."""
        return self.spark.read.parquet(f"{self.path}/{self.version()}")

    def refresh(self, now: datetime) -> bool:
        if not self.needs_refresh(now):
            return False
        old = self.version()
        if self.incremental and old and self.last_refresh:
            df, how = dynamic_increment(self.read(), self.source(self.spark), self.compute, self.changed(self.spark, self.last_refresh), self.keys), "incremental"
        else:
            df, how = self.query(self.spark), "full"
        number = int(old.removeprefix("v=")) + 1 if old else 0
        df.write.mode("overwrite").parquet(f"{self.path}/v={number:012d}")
        self.last_refresh = now
        self.history.append((now, how))
        return True


def _scala(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]
