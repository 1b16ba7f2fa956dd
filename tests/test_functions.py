"""Golden values of the function library."""

import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import approx, hashing, ingest, vector
from tidemark.functions import json as js
from tidemark.functions import time as tm


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_time_bucket(spark):
    def at(width, text, **how):
        return one(spark, tm.time_bucket(width, F.lit(text).cast("timestamp_ntz"), **how))

    assert at("1 hour", "2024-01-01 08:30:00") == datetime(2024, 1, 1, 8)
    assert at("5 minutes", "2024-01-01 08:07:00") == datetime(2024, 1, 1, 8, 5)
    assert at("1 hour", "2024-01-01 08:00:00", offset="30 minutes") == datetime(2024, 1, 1, 7, 30)
    assert at("7 days", "2024-01-03 00:00:00") == datetime(2023, 12, 30)
    assert at("1 day", "1999-12-31 12:00:00") == datetime(1999, 12, 31)
    assert [one(spark, tm.int_bucket(10, F.lit(v))) for v in (-1, 0, 9, 10)] == [-10, 0, 0, 10]
    for bad in ("0 days", "3 fortnights"):
        with pytest.raises(ValueError):
            tm.micros(bad)


def test_cron():
    t = datetime(2024, 1, 31, 23, 59, 30)
    assert tm.next_cron("* * * * *", t) == datetime(2024, 2, 1, 0, 0)
    assert tm.next_cron("*/15 9-17 * * 1-5", datetime(2024, 2, 2, 17, 50)) == datetime(2024, 2, 5, 9, 0)
    assert tm.next_cron("0 0 29 2 *", t) == datetime(2024, 2, 29)
    assert tm.next_cron("30 6 1,15 * 0", datetime(2024, 3, 1, 7)) == datetime(2024, 3, 3, 6, 30)
    with pytest.raises(ValueError):
        tm.next_cron("61 * * * *", t)


def test_vectors(spark):
    a, b, c = (vector.literal(v) for v in ([1, 2, 3], [4, 5, 6], [0, 0, 0]))
    assert one(spark, vector.norm(vector.literal([3, 4]))) == 5
    assert one(spark, vector.inner_product(a, b)) == 32
    assert one(spark, vector.cosine_distance(a, a)) == pytest.approx(0)
    assert one(spark, vector.cosine_distance(a, c)) == 1
    assert one(spark, vector.l2_distance(a, b)) == pytest.approx(27**0.5)
    assert one(spark, vector.normalize(vector.literal([3, 4]))) == [0.6, 0.8]
    assert one(spark, vector.normalize(c)) == [0, 0, 0]
    assert one(spark, vector.from_text(F.lit("[1,2.5]"))) == [1.0, 2.5]
    with pytest.raises(Exception, match="dimensions"):
        one(spark, vector.l2_distance(a, vector.literal([1])))


def test_shard_hash(spark):
    for kind, size in (("int", 4), ("bigint", 8)):
        for v in (0, 1, -1, 100, -100, 42, 123456789, -123456789, 2**31 - 1, -(2**31)):
            assert one(spark, hashing.crc(F.lit(v).cast(kind), kind)) == zlib.crc32(v.to_bytes(size, "little", signed=True))
    assert one(spark, hashing.crc(F.lit(42), "int")) == 4006318150
    assert one(spark, hashing.shard_index(F.lit(42), "int", 4)) == 2
    assert one(spark, hashing.hash_value(F.lit(-100), "int")) == 3597444882 - 2**32
    assert one(spark, hashing.hash_value(F.lit("é"), "string")) % 2**32 == zlib.crc32("é".encode())


def test_sketches(spark):
    for n in (100, 1000, 10_000, 100_000):
        got = spark.range(n).agg(approx.approx_count_distinct(F.col("id")).alias("x")).first().x
        assert abs(got - n) <= max(2, 3 * approx.ERROR * n)
    assert spark.range(0).agg(approx.approx_count_distinct(F.col("id")).alias("x")).first().x == 0
    df = spark.range(10_000).select((F.col("id") / 10).alias("v"), (F.col("id") % 2).alias("k"))
    d = approx.tdigest(df, "v", [])
    for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99):
        got = d.select(approx.digest_quantile(F.col("digest"), q).alias("x")).first().x
        assert abs(got - 1000 * q) < 10
    assert d.select(approx.digest_quantile(F.col("digest"), 0).alias("x")).first().x == 0
    assert {r.k for r in approx.tdigest(df, "v", ["k"]).collect()} == {0, 1}
    assert len(approx.reservoir(df, "v", 50, ["k"], 1).first().sample) == 50
    kept = approx.hash_sample(df, "v", 0.3, 5).count()
    assert 2700 < kept < 3300


def test_json(spark):
    doc = F.lit('{"a": {"b": [1, {"c": "x"}], "n": null}, "t": true, "k": 3}')
    assert js.path("a.b[0]") == js.path("$.a.b[0]") == "$.a.b[0]"
    assert one(spark, js.extract(doc, "a.b[1].c")) == "x"
    assert one(spark, js.contains(doc, {"t": True, "k": 3}))
    assert not one(spark, js.contains(doc, {"k": 4}))
    assert one(spark, js.has_any(doc, ["z", "k"])) and not one(spark, js.has_all(doc, ["z", "k"]))
    stats = js.path_stats(spark.range(1).select(doc.alias("d")), "d")
    got = {(r.path, r.type): r.n for r in stats.collect()}
    assert got[("$.a.b[*].c", "string")] == 1 and got[("$.a.b[*]", "number")] == 1 and got[("$.a.n", "null")] == 1
    deep = spark.createDataFrame([('{"a":{"b":{"c":{"d":{"e":[[1,"}]{{"],[{"f":null}]]}}}}}',), ('"text"',), ("[1, [2]]",), ("no json {",), (None,)], "d string")
    assert {(r.path, r.type, r.n) for r in js.path_stats(deep, "d").where("path like '%f' or path like '$[%' or path = '$.a.b.c.d.e[*][*]'").collect()} == {("$.a.b.c.d.e[*][*].f", "null", 1), ("$.a.b.c.d.e[*][*]", "number", 1), ("$.a.b.c.d.e[*][*]", "string", 1), ("$.a.b.c.d.e[*][*]", "object", 1), ("$[*]", "number", 1), ("$[*]", "array", 1), ("$[*][*]", "number", 1)}
    assert js.path_stats(deep.limit(0), "d").count() == 0
    picked = {r.path: r.extract for r in js.advice(stats.withColumn("share", F.lit(0.5))).collect()}
    assert picked["$.k"] and not picked["$.a"]


def test_line_protocol(spark):
    lines = [r'cpu\ load,host=a,re\,gion=eu usage=0.5,n=3i,ok=t,s="x, y=1" 170', "# note", "", "mem free=1"]
    rows = ingest.line_protocol(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.measurement for r in rows] == ["cpu load", "mem"]
    assert rows[0].tags == {"host": "a", "re,gion": "eu"} and rows[0].time == 170 and rows[1].time is None
    assert rows[0].fields == {"usage": "0.5", "n": "3i", "ok": "t", "s": '"x, y=1"'}
    long = "cpu" + "".join(f",t{i}={i}" for i in range(3000)) + " " + ",".join(f'f{i}="{i} a,b"' for i in range(3000)) + " 5"
    again = "cpu,a=1,b=2,a=3 x=1i,x=2i"
    odd = ingest.line_protocol(spark.createDataFrame([(long,), (again,), ('bad "line',), ("x" * 100_000,)], "value string")).collect()
    assert len(odd[0].tags) == 3000 and odd[0].fields["f2999"] == '"2999 a,b"' and odd[0].time == 5
    assert odd[1].tags == {"a": "3", "b": "2"} and odd[1].fields == {"x": "2i"}
    assert odd[2].measurement is None and odd[3].measurement is None and odd[3].tags == {} and odd[2].line == 'bad "line'
    f = lambda v: one(spark, ingest.typed_field(F.lit(v)))
    assert f("3i").long == 3 and f("0.5").double == 0.5 and f('"x"').text == "x" and f("t").boolean is True
