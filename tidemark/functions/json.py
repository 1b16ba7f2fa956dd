"""JSON documents held as text: paths, containment, typed comparison, path statistics, shredding."""

from __future__ import annotations

import re
from json import dumps, loads

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path(text: str) -> str:
    """$.a.b[0] from a.b[0], .a.b[0] or $.a.b[0]."""
    rest = text.removeprefix("$").removeprefix(".")
    if not re.fullmatch(r"(?:[^.\[\]]+|\[(?:\d+|\*)\])(?:\.[^.\[\]]+|\[(?:\d+|\*)\])*|", rest):
        raise ValueError(f"no such path: {text}")
    return ("$." if rest and not rest.startswith("[") else "$") + rest


def extract(doc: Column, at: str, kind: str | None = None) -> Column:
    """The value at a path as text, or cast to a type; null where it can't be."""
    v = F.get_json_object(doc, path(at))
    return v.try_cast(kind) if kind else v


def has_key(doc: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def has_any(doc: Column, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(doc), F.array(*map(F.lit, keys))), F.lit(False))


def has_all(doc: Column, keys: list[str]) -> Column:
    return F.forall(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.array_contains(F.json_object_keys(doc), k), F.lit(False)))


def contains(doc: Column, part: dict, at: str = "$") -> Column:
    """Whether doc holds every key and value of part, at every depth."""
    out = F.lit(True)
    for k, v in part.items():
        here = f"{at}.{k}"
        if isinstance(v, dict):
            out = out & contains(doc, v, here)
        elif v is None:
            out = out & has_key(F.get_json_object(doc, at) if at != "$" else doc, k) & F.get_json_object(doc, here).isNull()
        else:
            found = F.get_json_object(doc, here)
            out = out & F.coalesce(found == str(v).lower() if isinstance(v, bool) else (found.try_cast("double") == float(v) if isinstance(v, (int, float)) else found == str(v)), F.lit(False))
    return out


def contained(doc: Column, whole: dict) -> Column:
    """Whether whole holds every key and value of doc, at every depth; doc is an object. Arrays are compared as text without spaces."""
    out = F.forall(F.json_object_keys(doc), lambda k: k.isin(*whole) if whole else F.lit(False))
    for k, v in whole.items():
        here = F.get_json_object(doc, f"$.{k}")
        if isinstance(v, dict):
            same = here.startswith("{") & contained(here, v)
        elif v is None:
            same = here.isNull()
        elif isinstance(v, bool):
            same = here == str(v).lower()
        elif isinstance(v, (int, float)):
            same = here.try_cast("double") == float(v)
        else:
            same = here == (v if isinstance(v, str) else dumps(v, separators=(",", ":")))
        out = out & (~has_key(doc, k) | F.coalesce(same, F.lit(False)))
    return F.coalesce(out, F.lit(False))


def path_exists(doc: Column, at: str) -> Column:
    """Whether anything, a null too, stands at a path."""
    p = path(at)
    parent, _, key = p.rpartition(".")
    there = F.get_json_object(doc, p).isNotNull()
    return there | (has_key(F.get_json_object(doc, parent) if parent != "$" else doc, key) if parent and not key.endswith("]") else F.lit(False))


#: Comparisons of path predicates.
COMPARISONS = {"=": "=", "==": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def path_matches(doc: Column, predicate: str) -> Column:
    """A predicate such as `$.a.b >= 5` or `$.t == "x"`, false where the path is missing; numbers compare as numbers, text as text."""
    m = re.fullmatch(r"\s*(\$\S*)\s*(==|!=|<>|<=|>=|=|<|>)\s*(.+?)\s*", predicate)
    if not m:
        raise ValueError(f"no such predicate: {predicate}")
    value, found = loads(m[3]), F.get_json_object(doc, path(m[1]))
    if isinstance(value, bool):
        found, value = found, str(value).lower()
    elif isinstance(value, (int, float)):
        found, value = found.try_cast("double"), float(value)
    compare = {"=": found == value, "<>": found != value, "<": found < value, "<=": found <= value, ">": found > value, ">=": found >= value}
    return F.coalesce(compare[COMPARISONS[m[2]]], F.lit(False))


def explain(df: DataFrame, doc: str, at: str, shredded: dict[str, str] | None = None) -> dict:
    """How a path would be read: from a shredded column, which Parquet can skip by, or from the text; and the plan."""
    p = path(at)
    column = {path(k): c for k, c in (shredded or {}).items()}.get(p)
    found = df.where(F.col(column).isNotNull()) if column else query(df, doc, p)
    return {"path": p, "column": column, "pushed_down": column is not None, "plan": found._jdf.queryExecution().executedPlan().toString()}


def query_stats(df: DataFrame, doc: str, at: str) -> DataFrame:
    """(rows, present, distinct, share) of one path, in one pass."""
    v = F.get_json_object(F.col(doc), path(at))
    return df.agg(F.count("*").alias("rows"), F.count(v).alias("present"), F.approx_count_distinct(v).alias("distinct"), (F.count(v) / F.count("*")).alias("share"))


def query(df: DataFrame, doc: str, at: str) -> DataFrame:
    """The rows in which the path is present."""
    return df.where(F.get_json_object(doc, path(at)).isNotNull())


def extract_batch(docs: Column, at: str) -> Column:
    return F.transform(docs, lambda d: F.get_json_object(d, path(at)))


def depth_of(doc: Column) -> Column:
    """How many objects and arrays lie within each other, at most; by the brackets outside of strings."""
    brackets = F.regexp_replace(F.regexp_replace(doc, r'"(?:\\.|[^"\\])*+"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    deep = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, x: F.struct((a.now + x).alias("now"), F.greatest(a.most, a.now + x).alias("most")), lambda a: a.most)
    return F.coalesce(deep, F.lit(0))


def leaves(df: DataFrame, doc: str, depth: int | None = None) -> DataFrame:
    """(path, type) for every value of every document, arrays as [*], down to a depth or as deep as the documents go. A document is
    parsed once; each step puts the members of the objects and arrays that are new beside them. Text that isn't JSON has no values."""
    if depth is None:
        depth = df.agg(F.max(depth_of(F.col(doc))).alias("d")).first().d or 0
    level = df.select(F.lit("$").alias("path"), F.try_parse_json(F.col(doc)).alias("v"), F.lit(True).alias("new")).where("v is not null")
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        inside = F.when(F.col("new") & kind.startswith("OBJECT"), F.expr("transform(map_entries(cast(v as map<string, variant>)), e -> struct(path || '.' || e.key as path, e.value as v, true as new))"))
        inside = inside.when(F.col("new") & kind.startswith("ARRAY"), F.expr("transform(cast(v as array<variant>), x -> struct(path || '[*]' as path, x as v, true as new))"))
        own = F.array(F.struct("path", "v", F.lit(False).alias("new")))
        level = level.select(F.explode(F.concat(own, F.coalesce(inside, F.expr("slice(array(struct(path, v, true as new)), 1, 0)")))).alias("x")).select("x.*")
    kind = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
    name = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    return level.select("path", name.alias("type")).where("path <> '$'")


def path_stats(df: DataFrame, doc: str, depth: int | None = None) -> DataFrame:
    """(path, type, n, share): how many values each path and type has, for each document, at every depth unless one is given."""
    total = df.agg(F.count("*").alias("total"))
    return leaves(df, doc, depth).groupBy("path", "type").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("path", "type", "n", (F.col("n") / F.col("total")).alias("share"))


def shred(df: DataFrame, doc: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Typed columns, name: (path, type), instead of asking the text each time. What can't be cast is null."""
    return df.select("*", *[extract(F.col(doc), at, kind).alias(name) for name, (at, kind) in paths.items()])


#: The weight of an index kind in an advice's benefit.
BENEFIT = {"gin": 0.8, "btree": 1.0, "hash": 0.9, "expression": 0.7}


def advice(stats: DataFrame, accesses: int = 1) -> DataFrame:
    """Which paths to extract: by type a kind and by share a benefit; objects and arrays, and what nearly all rows share, stay."""
    kind = F.when(F.col("type").isin("object", "array"), "gin").when(F.col("type") == "number", "btree").when(F.col("type") == "string", "hash").otherwise("expression")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in BENEFIT.items() for x in kv]), F.col("kind"))
    return stats.withColumn("kind", kind).withColumn("benefit", (1 - F.least(F.col("share"), F.lit(1.0))) * accesses * weight).withColumn("extract", ~F.col("type").isin("object", "array") & (F.col("share") <= 0.9))


def auto_extract(stats: DataFrame, accesses: dict[str, int], top: int = 10) -> DataFrame:
    """The paths to shred: by accesses times the share that lack them, the largest first; no objects, arrays or paths that nearly all rows have."""
    counts = stats.sparkSession.createDataFrame([(path(k), v) for k, v in accesses.items()], "path string, accesses bigint")
    weighed = advice(stats.join(F.broadcast(counts), "path")).withColumn("benefit", F.col("accesses") * (1 - F.least(F.col("share"), F.lit(1.0))))
    return weighed.where("extract").orderBy(F.desc("benefit"), "path").limit(top)


def columnar_info(df: DataFrame, doc: str, shredded: dict[str, tuple[str, str]]) -> DataFrame:
    """(name, path, type, filled, share) of each shredded column: how far it stands for its path."""
    names = list(shredded)
    one = df.agg(F.count("*").alias("rows"), *[F.count(n).alias(f"f_{i}") for i, n in enumerate(names)])
    each = [F.struct(F.lit(n).alias("name"), F.lit(path(shredded[n][0])).alias("path"), F.lit(shredded[n][1]).alias("type"), F.col(f"f_{i}").alias("filled"), (F.col(f"f_{i}") / F.col("rows")).alias("share")) for i, n in enumerate(names)]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def refreshed(df: DataFrame, doc: str, shredded: dict[str, tuple[str, str]]) -> DataFrame:
    """The shredded columns made anew from the text."""
    return shred(df.drop(*shredded), doc, shredded)
