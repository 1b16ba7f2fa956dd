"""Records of pipelines: line protocol and CSV text as Column expressions, Debezium envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(entries: Column) -> Column:
    """A map of (key, value) entries; of a key that is there more than once the last value stays."""
    keys = F.transform(entries, lambda x: x.key)
    later = lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x.key)
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(F.filter(entries, later)))


def line_protocol(df: DataFrame, line: str = "value") -> DataFrame:
    """measurement, tags (map of text), fields (map of text as written), time in nanoseconds and the line of
    `name,tag=v field=1i,f2=2.0,f3="s" 123`; comments and empty lines are left out, escaped spaces and commas kept. A line that isn't
    in this form has a null measurement and empty maps. A tag or field that is repeated has its last value.

    Patterns are possessive, so that lines of any length are matched without recursion."""
    t = F.trim(F.col(line))
    df = df.where((t != "") & ~t.startswith("#"))
    part = lambda i: F.regexp_extract(t, r'^((?:\\.|[^\\ ])++) ((?:"(?:\\.|[^"\\])*+"|\\.|[^\\" ])++)(?: (-?\d+))?$', i)
    split = lambda c: F.regexp_extract_all(c, F.lit(r'((?:"(?:\\.|[^"\\])*+"|\\.|[^\\",])++)'), F.lit(1))
    plain = lambda c: F.regexp_replace(c, r"\\([ ,=])", "$1")

    def pair(x: Column) -> Column:
        return F.struct(plain(F.regexp_extract(x, r"^((?:\\.|[^=\\])++)=", 1)).alias("key"), plain(F.regexp_extract(x, r"^(?:\\.|[^=\\])++=(.*)$", 1)).alias("value"))

    # the head is named twice, so that it isn't split for each tag
    df = df.select(t.alias("line"), split(part(1)).alias("head"), split(part(2)).alias("body"), part(3).alias("at"))
    whole = F.forall(F.concat(F.slice("head", 2, F.greatest(F.size("head"), F.lit(1))), "body"), lambda x: x.rlike(r"^(?:\\.|[^=\\])++=."))
    df = df.withColumns({c: F.when(whole, F.col(c)).otherwise(F.array().cast("array<string>")) for c in ("head", "body")})
    return df.select(
        plain(F.get("head", F.lit(0))).alias("measurement"),
        last_wins(F.when(F.size("head") > 1, F.transform(F.slice("head", 2, F.size("head")), pair)).otherwise(F.array().cast("array<struct<key:string,value:string>>"))).alias("tags"),
        last_wins(F.transform("body", pair)).alias("fields"),
        F.when(F.col("at") != "", F.col("at")).try_cast("bigint").alias("time"),
        "line",
    )


def typed_field(value: Column) -> Column:
    """(long, double, text, boolean) of a field as it is written: 1i, 2.0, "s", t."""
    return F.struct(
        F.when(value.rlike(r"^-?\d+[iu]$"), F.regexp_extract(value, r"^(-?\d+)", 1).try_cast("bigint")).alias("long"),
        F.when(value.rlike(r"^[-+]?[\d.]"), value.try_cast("double")).alias("double"),
        F.when(value.startswith('"'), F.regexp_replace(value, r'^"|"$', "")).alias("text"),
        F.when(value.rlike("(?i)^(t|true|f|false)$"), value.rlike("(?i)^t")).alias("boolean"),
    )


#: Operation codes of the Debezium envelope.
OPERATIONS = {"insert": "c", "update": "u", "delete": "d", "truncate": "t", "snapshot": "r"}


def debezium(event_type: Column, before: Column, after: Column, schema: Column | str, table: Column | str, lsn: Column, ts_ms: Column) -> Column:
    """The envelope as JSON text; schema and table are columns, or names that all events share."""
    schema, table = (x if isinstance(x, Column) else F.lit(x) for x in (schema, table))
    code = F.element_at(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv]), event_type)
    source = F.struct(schema.alias("schema"), table.alias("table"), lsn.alias("lsn"))
    return F.to_json(F.struct(before.alias("before"), after.alias("after"), source.alias("source"), code.alias("op"), ts_ms.alias("ts_ms")), {"ignoreNullFields": "false"})
