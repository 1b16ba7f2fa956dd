"""Tables that change: differences of snapshots, merges, filters of change events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """df joined (left_semi or left_anti) with other on the keys, null being equal to null."""
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return df.alias("l").join(other.select(*keys).alias("r"), on, how)


def differing(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in names], F.lit(False))


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """event_type (insert, update, delete), the keys, before and after as structs, by one full outer join on the keys. Rows that
    are equal, nulls counted as equal, are left out."""
    names = [c for c in after.columns if c not in keys]
    b = before.withColumn("there", F.lit(True)).alias("b")
    a = after.withColumn("there", F.lit(True)).alias("a")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    joined = b.join(a, on, "full_outer")
    kind = F.when(F.col("b.there").isNull(), "insert").when(F.col("a.there").isNull(), "delete").when(differing(names), "update")
    image = lambda s: F.when(F.col(f"{s}.there"), F.struct(*[F.col(f"{s}.{c}").alias(c) for c in [*keys, *names]]))
    out = joined.select(kind.alias("event_type"), *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], image("b").alias("before"), image("a").alias("after"))
    return out.where(F.col("event_type").isNotNull())


def initial_rows(table: DataFrame, keys: list[str]) -> DataFrame:
    """A table as the changes that made it: an insert of every row, for streams that show initial rows."""
    every = F.struct(*[F.col(c) for c in [*keys, *[c for c in table.columns if c not in keys]]])
    return table.select(F.lit("insert").alias("event_type"), *keys, F.when(F.lit(False), every).alias("before"), every.alias("after"))


def stream_rows(changed: DataFrame, kind: str = "standard", mode: str = "default", keys: list[str] | None = None) -> DataFrame:
    """What a stream of a kind (standard, append, insert) shows in a mode (default, keys_only, full_before)."""
    if kind in ("append", "insert"):
        changed = changed.where("event_type = 'insert'")
    if mode == "keys_only":
        return changed.select("event_type", *(keys or []))
    return changed if mode == "full_before" else changed.drop("before")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """target with source's rows put in; rows whose key is there, nulls counted as equal, are replaced, or kept if update is off. Each side
    is joined once and no row is compared with more than its key's; source should have a key once."""
    source = source.select(*target.columns)
    if update:
        return matched(target, source, keys, "left_anti").unionByName(source)
    return target.unionByName(matched(source, target, keys, "left_anti"))


def apply_changes(target: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """target after all changes: what they delete or update goes, what they insert or update comes. Null keys are equal."""
    new = changed.where("event_type in ('insert', 'update')").select("after.*")
    return matched(target, changed, keys, "left_anti").unionByName(new.select(*target.columns))


def table_filter(name: Column, include: list[str], exclude: list[str]) -> Column:
    """Patterns match whole names, or prefixes up to the first `*`. Any exclusion wins; with inclusions one must match."""

    def any_of(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | (name.startswith(p.split("*")[0]) if "*" in p else name == p)
        return out

    return ~any_of(exclude) & (any_of(include) if include else F.lit(True))
