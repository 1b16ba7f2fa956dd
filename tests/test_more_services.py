"""Digests and samples, distributed tables, change streams, versions of tables, tiers, subscriptions, vector cells."""

import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import approx, hashing, vector
from tidemark.functions import json as js
from tidemark.functions import time as tm
from tidemark.operators import joins, sharding, streams, tables, workflow
from tidemark.streaming import cdc


def bag(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_digests(spark, kind):
    df = spark.range(0, 10_000, 1, 7).select((F.col("id") / 10).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    d = approx.tdigest(df, "v", [], kind=kind)
    info = d.select(approx.digest_info(F.col("digest")).alias("x")).first().x
    assert info["count"] == 10_000 and info["min"] == 0 and info["max"] == 999.9 and abs(info["mean"] - 499.95) < 1e-6 and info.centroids < 300
    got = d.select(*[approx.digest_cdf(F.col("digest"), x).alias(f"c{i}") for i, x in enumerate((-1.0, 0.0, 250.0, 999.9, 2000.0))], approx.digest_percentile(F.col("digest"), 75).alias("p"), approx.digest_trimmed_mean(F.col("digest"), 0.1, 0.5).alias("t")).first()
    assert got.c0 == 0 and got.c1 == 0 and abs(got.c2 - 0.25) < 0.01 and got.c3 == 1 and got.c4 == 1 and abs(got.p - 750) < 10 and abs(got.t - 300) < 15
    by = approx.tdigest(df, "v", ["k"], kind=kind).select("k", approx.digest_info(F.col("digest"))["count"].alias("n"))
    assert {(r.k, r.n) for r in by.collect()} == {(None, 3334.0), (1, 3333.0), (2, 3333.0)}
    assert approx.tdigest(df.limit(0), "v", ["k"]).count() == 0


def test_digest_tree(spark, monkeypatch):
    monkeypatch.setattr(approx, "FAN_IN", 2)
    monkeypatch.setattr(approx, "HELD", 1)
    df = spark.range(0, 9000, 1, 9).select((F.col("id") % 1000).cast("double").alias("v"), (F.col("id") % 5).alias("k"))
    got = approx.tdigest(df, "v", ["k"]).select("k", approx.digest_info(F.col("digest"))["count"].alias("n"), approx.digest_quantile(F.col("digest"), 0.5).alias("q")).collect()
    assert {r.k for r in got} == set(range(5)) and all(r.n == 1800 and abs(r.q - 500) < 20 for r in got)


def test_samples(spark, small, tmp_path):
    df = spark.range(10_000).withColumn("g", F.col("id") % 4)
    some = approx.sample_rows(df, 0.2, 3)
    assert 1700 < some.count() < 2300 and bag(some) == bag(approx.sample_rows(df.repartition(13), 0.2, 3))
    rows = approx.reservoir_rows(df, 50, 1)
    assert rows.count() == 50 and bag(rows) == bag(approx.reservoir_rows(df.repartition(5), 50, 1))
    a, b = (sorted((r.g, tuple(sorted(r.sample))) for r in approx.reservoir(x, "id", 20, ["g"], 2).collect()) for x in (df, df.repartition(9)))
    assert a == b and all(len(s) == 20 for _, s in a)
    df.repartition(40).write.parquet(f"{tmp_path}/b")
    files = spark.read.parquet(f"{tmp_path}/b")
    drawn = approx.system_sample(files, 0.5, 1)
    assert drawn.columns == files.columns and 0 < drawn.count() < 10_000
    df.createOrReplaceTempView("ten_thousand")
    assert abs(approx.quick_count_distinct(spark, "ten_thousand", "id") - 10_000) < 250 and abs(approx.quick_median(spark, "ten_thousand", "id") - 5000) < 50 and abs(approx.quick_percentile(spark, "ten_thousand", "id", 90) - 9000) < 50
    assert 800 < approx.create_sample_view(spark, "ten_thousand", 0.1, "tenth").count() < 1200 and spark.table("tenth").columns == ["id", "g"]
    # estimates against exact answers on the tables
    stats = {r.column: r for r in approx.table_stats(spark.read.parquet(f"{small}/lineitem.parquet")).collect()}
    exact = spark.read.parquet(f"{small}/lineitem.parquet").agg(*[F.countDistinct(c).alias(c) for c in stats]).first()
    assert all(abs(stats[c].distinct_count - exact[c]) <= max(2, 3 * approx.ERROR * exact[c]) for c in stats)
    values = np.sort([r.l_extendedprice for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_extendedprice").collect()])
    for name, q in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(np.searchsorted(values, stats["l_extendedprice"][name]) / len(values) - q) < 0.01


def test_time_series(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    df = spark.createDataFrame([("a", t(1), 10.0), ("a", t(4), 40.0), ("b", t(0), None), ("b", t(2), 5.0)], "k string, b timestamp_ntz, v double")
    full = tm.gapfill(df, "b", "1 hour", t(0), t(6), ["k"])
    assert full.count() == 12
    carried = {(r.k, r.b.hour): r.v for r in tm.locf(full, ["v"], "b", ["k"]).collect()}
    assert [carried["a", h] for h in range(6)] == [None, 10, 10, 10, 40, 40] and [carried["b", h] for h in range(6)] == [None, None, 5, 5, 5, 5]
    lines = {(r.k, r.b.hour): r.v for r in tm.interpolate(full, ["v"], "b", ["k"]).collect()}
    assert [lines["a", h] for h in range(6)] == [None, 10, 20, 30, 40, None]
    got = df.groupBy("k").agg(tm.first(F.col("v"), F.col("b")).alias("f"), tm.last(F.col("v"), F.col("b")).alias("l"), tm.histogram(F.col("v"), 0, 20, 2).alias("h")).orderBy("k").collect()
    assert [(r.f, r.l, r.h) for r in got] == [(10, 40, [0, 0, 1, 1]), (None, 5, [0, 1, 0, 0])]


def test_asof_and_ranges(spark):
    rng = np.random.default_rng(3)
    trades = [(int(k), int(t)) if k else (None, int(t)) for k, t in zip(rng.integers(0, 4, 60), rng.integers(0, 100, 60))]
    quotes = [(int(k) or None, int(t), int(v)) for k, t, v in zip(rng.integers(0, 4, 40), rng.integers(0, 100, 40), rng.permutation(40))]
    l, r = spark.createDataFrame(trades, "k int, t int"), spark.createDataFrame(quotes, "k int, u int, v int")
    want = [(k, t, max(((u, v) for q, u, v in quotes if q == k and u <= t), default=(None, None))[1] if k else None) for k, t in trades]
    assert sorted(map(repr, map(tuple, joins.asof(l, r, "t", "u", ["k"], ["v"]).collect()))) == sorted(map(repr, want))
    spans = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-20, 100, 50), rng.integers(0, 25, 50)))]
    got = joins.in_range(l, spark.createDataFrame(spans, "i int, a int, b int"), "t", "a", "b", 10).select("t", "i").collect()
    assert sorted(map(tuple, got)) == sorted((t, i) for _, t in trades for i, a, b in spans if a <= t < b)


def test_distributed_tables(spark):
    c = sharding.Cluster(spark)
    o = spark.range(2000).selectExpr("id o", "id % 7 g", "concat('k', id % 3) s")
    l = spark.range(9000).selectExpr("id % 2500 l", "id v")
    c.create("o", o, "o", 8)
    c.create("l", l, "l", colocate_with="o")
    assert c.colocated("o", "l") and c.placed["l"].shards == 8
    joined = c.join("o", "l")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == o.join(l, F.col("o") == F.col("l")).count()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    # the plan names the buckets that are read only while it doesn't leave bucketing out of scans without joins
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    pruned = c.read("o").where("o = 77")
    assert pruned.count() == 1 and "SelectedBucketsCount: 1 out of 8" in spark._jvm.PythonSQLUtils.explainString(pruned._jdf.queryExecution(), "formatted")
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert c.shard_for_value("o", 77) == o.select(hashing.shard_index(F.lit(77).cast("bigint"), "bigint", 8).alias("x")).first().x
    c.append("o", spark.range(2000, 2010).selectExpr("id o", "0 g", "'x' s"))
    assert c.read("o").count() == 2010
    c.create_reference("r", spark.range(7).selectExpr("id g", "id * 2 w"))
    assert c.colocated("o", "r") and "BroadcastHashJoin" in c.read("o").join(c.read("r"), "g")._jdf.queryExecution().executedPlan().toString()
    c.create("c", o, ["g", "s"], 4, "composite")
    c.create("f", o, "g", strategy="list")
    c.create("q", o, "o", 5, "range")
    assert all(bag(c.read(n).select(*o.columns)) == bag(o) for n in ("c", "f", "q")) and not c.colocated("o", "c")
    assert c.reshard("l", 3).shards == 3 and c.read("l").count() == 9000 and not c.colocated("o", "l")
    assert c.undistribute("l").count() == 9000 and "l" not in c.placed
    for n in list(c.placed):
        c.drop(n)
    for bad in (("z", o, ["o", "g"], 4, "hash"), ("z", o, "o", 4, "pile")):
        with pytest.raises(ValueError):
            c.create(*bad)
    rows, at = {i: 10 * (i + 1) for i in range(12)}, {i: "a" for i in range(12)}
    for drain in (None, "a"):
        end = dict(at)
        for s, a, b in sharding.moves(rows, at, ["a", "b", "c"], drain):
            assert end[s] == a
            end[s] = b
        load = [sum(rows[s] for s in rows if end[s] == n) for n in "abc"]
        assert sum(load) == 780 and (load[0] == 0 if drain else max(load) <= 286)


def test_change_streams(spark):
    rows = [(1, 0, "insert", 1), (1, 1, "insert", 2), (2, 0, "update", 1), (3, 0, "delete", 2)]
    log = []
    read = lambda: spark.createDataFrame([(*r[:3], r[3], (r[3],), (r[3],)) for r in log], "lsn long, sequence long, event_type string, k long, before struct<k:long>, after struct<k:long>")
    now = datetime(2024, 1, 1)
    every = streams.ChangeStreams(spark)
    log += rows[:1]
    s = every.create(streams.ChangeStream("s", read, ["k"]), now)
    first = every.create(streams.ChangeStream("f", read, ["k"], "append", "keys_only"), now, show_initial_rows=True)
    assert not s.has_data() and first.count() == 1
    log += rows[1:]
    assert s.has_data() and s.count() == 3 and s.count() == 3 and first.count() == 2 and first.pending().columns == ["event_type", "k"]
    s.advance(now, streams.Offset(2, 0))
    assert s.count() == 1 and s.advance(now) == streams.Offset(3, 0) and not s.has_data()
    with pytest.raises(ValueError):
        s.advance(now, streams.Offset(1, 1))
    late = now + timedelta(days=15)
    assert every.status(late) == [("f", streams.Offset(), True), ("s", streams.Offset(3, 0), False)]
    every.drop("f")
    assert list(every.known) == ["s"]


def hours(spark, days, first=0):
    return spark.range(first * 24, days * 24).select(F.timestamp_seconds(1704067200 + F.col("id") * 3600).cast("timestamp_ntz").alias("time"), (F.col("id") % 3).cast("int").alias("device"), F.col("id").cast("double").alias("v"))


def test_aggregate_versions(spark, tmp_path):
    t = tables.Hypertable(spark, f"{tmp_path}/h", "time")
    agg = lambda df: df.groupBy("bucket", "device").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    t.insert(hours(spark, 5))
    c = tables.ContinuousAggregate(t, f"{tmp_path}/c", "1 hour", agg)
    c.create()
    before = c.current()
    late = hours(spark, 3, 2).where("hour(time) < 5")
    t.insert(late)
    t.insert(hours(spark, 5, 4))
    c.refresh_changed(late)
    after = c.current()
    assert [d for d in before if before[d] != after[d]] == ["2024-01-03"] and before.keys() == after.keys()
    whole = agg(c.bucketed(t.read()))
    same = F.col("bucket") < F.lit(datetime(2024, 1, 5)).cast("timestamp_ntz")
    assert bag(c.read().where(same)) == bag(whole.where(same)) and bag(c.read()) != bag(whole)
    c.refresh(datetime(2024, 1, 5, 3), datetime(2024, 1, 5, 4))
    new = {(r.bucket.hour, r.n) for r in c.read(["2024-01-05"]).collect()}
    assert {h for h, n in new if n == 2} == {3, 4}
    c.drop()
    with pytest.raises(ValueError):
        c.read()


def test_chunk_swaps_and_tiers(spark, tmp_path):
    t = tables.Hypertable(spark, f"{tmp_path}/h", "time", space="device", spaces=2, tiers={"warm": f"{tmp_path}/w", "cold": f"{tmp_path}/c"})
    t.insert(hours(spark, 12))
    want = bag(t.read().select("time", "device", "v"))
    for cut in ("old", "both"):
        t.compress_chunk("2024-01-02T000000")
        chunk, old = tmp_path / "h" / "chunk_start=2024-01-02T000000", tmp_path / "h" / "_old_2024-01-02T000000"
        chunk.rename(old)
        if cut == "both":
            import shutil

            shutil.copytree(old, chunk)
        assert bag(t.read().select("time", "device", "v")) == want and not old.exists()
    one = t.having(1)
    assert one.count() == 96 and one.where("device <> 1").isEmpty() and "space_id" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    m = tables.Maintenance(t)
    m.add(tables.Policy("tiering", timedelta(0)))
    did = m.run(datetime(2024, 1, 13))
    assert "move 2024-01-01T000000 to cold" in did and "move 2024-01-10T000000 to warm" in did and len(t.starts()) == 2
    assert bag(t.read().select("time", "device", "v")) == want and t.chunks().count() == 12
    assert t.read(datetime(2024, 1, 3), datetime(2024, 1, 11)).count() == 8 * 24
    assert t.drop_chunks(datetime(2024, 1, 3)) == ["2024-01-01T000000", "2024-01-02T000000"] and t.read().count() == 240


def test_dynamic_tables(spark, tmp_path):
    spark.range(10).selectExpr("id % 3 k", "id v", "0 at").write.parquet(f"{tmp_path}/s")
    source = lambda s: s.read.parquet(f"{tmp_path}/s")
    compute = lambda df: df.groupBy("k").agg(F.sum("v").alias("s"))
    d = tables.DynamicTable(spark, f"{tmp_path}/d", lambda s: compute(source(s)), keys=["k"], source=source, compute=compute, changed=lambda s, since: source(s).where("at > 0").select("k").distinct())
    now = datetime(2024, 1, 1)
    assert d.refresh(now) and not d.refresh(now + timedelta(seconds=30)) and d.next_refresh() == now + timedelta(minutes=1)
    spark.createDataFrame([(2, 100, 1), (None, 5, 1)], "k bigint, v bigint, at int").write.mode("append").parquet(f"{tmp_path}/s")
    assert d.refresh(now + timedelta(hours=1)) and [h for _, h in d.history] == ["full", "incremental"]
    assert bag(d.read()) == bag(compute(source(spark)))
    assert len(d.sources()) > 0 and all("/s/" in p for p in d.sources())
    d.suspended = True
    assert not d.refresh(now + timedelta(days=1))
    for mode in ("incremental", "sometimes"):
        with pytest.raises(ValueError):
            tables.DynamicTable(spark, "x", source, mode=mode)


def test_tasks_and_pools(spark):
    w = workflow.Scheduler(spark)
    now = datetime(2024, 1, 1)
    t = w.add(workflow.Task("t", lambda s: 1 / 0, timedelta(days=9), error_limit=1))
    assert w.execute("t", now).startswith("failed") and t.suspended and not w.tick(now + timedelta(days=99))
    w.resume("t")
    t.work, t.when = (lambda s: None), (lambda: 1 / 0)
    assert w.execute("t", now).startswith("skipped") and t.errors == 0
    t.when = None
    assert w.execute("t", now) == "done" and w.status()["t"]["runs"] == 3 and len(w.runs("t", 2)) == 2
    w.suspend("t")
    w.drop("t")
    load = workflow.Workload(spark)
    load.create("p", 3, memory_mb=100)
    assert load.submit("p", "a", memory_mb=60) and not load.submit("p", "b", "low", 50) and not load.submit("p", "c", "high", 30)
    with pytest.raises(ValueError):
        load.submit("p", "d", memory_mb=101)
    assert load.finished("p", "a") == "c" and set(load.pools["p"].running) == {"c", "b"}
    load.create("one", 1)
    order = []
    go = [threading.Thread(target=lambda i=i: load.run("one", str(i), lambda: order.append(spark.range(i + 1).count()))) for i in range(4)]
    [g.start() for g in go]
    [g.join(60) for g in go]
    assert sorted(order) == [1, 2, 3, 4] and not load.pools["one"].running


def test_subscriptions(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, HTTPServer

    schema = "event_type string, schema string, table string, lsn long, ts_ms long, before struct<id:int>, after struct<id:int>"
    put = lambda *ids: spark.createDataFrame([("insert", "public", "a", i, 5, None, (i,)) for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    put(1)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/e")
    every = cdc.Subscriptions()
    s = every.create(cdc.Subscription("s"), lambda s: s.to_folder(stream(), f"{tmp_path}/o", f"{tmp_path}/k", max_files=2))
    assert every.list() == {"s": {"status": "created", "lag": None}}
    for i in range(3):
        every.restart("s").awaitTermination()
        put(i + 2)
    assert len(list((tmp_path / "o").glob("batch=*"))) == 2 and every.list()["s"]["status"] == "stopped"
    with pytest.raises(ValueError):
        every.create(s, None)
    every.drop("s")
    got = []

    class Hook(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    q = cdc.Subscription("w").to_url(stream(), f"http://127.0.0.1:{server.server_port}/", f"{tmp_path}/wk")
    q.processAllAvailable()
    q.stop()
    server.shutdown()
    assert len(got) == 4 and all(b'"event_type":"insert"' in g for g in got)


def test_json_operators(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "n": null}, "t": "x"}'), (2, '{"a": {"b": 2}}'), (3, "{}"), (4, None), (5, '{"z": [1, 2]}')], "i int, d string")
    d = F.col("d")
    ids = lambda c: {r.i for r in df.where(c).collect()}
    assert ids(js.contained(d, {"a": {"b": 1, "n": None, "c": 0}, "t": "x", "u": True})) == {1, 3} and ids(js.contained(d, {"z": [1, 2]})) == {3, 5} and ids(js.contained(d, {})) == {3}
    assert ids(js.path_exists(d, "$.a.n")) == {1} and ids(js.path_exists(d, "a.b")) == {1, 2} and ids(js.path_exists(d, "z[1]")) == {5}
    assert ids(js.path_matches(d, "$.a.b >= 2")) == {2} and ids(js.path_matches(d, '$.t == "x"')) == {1} and ids(js.path_matches(d, "$.a.b != 1")) == {2}
    with pytest.raises(ValueError):
        js.path_matches(d, "a.b > 1")
    shredded = js.shred(df, "d", {"b": ("a.b", "int")})
    assert js.explain(shredded, "d", "$.a.b", {"a.b": "b"})["pushed_down"] and not js.explain(shredded, "d", "$.t", {"a.b": "b"})["pushed_down"]
    assert tuple(js.query_stats(df, "d", "a.b").first()) == (5, 2, 2, 0.4)
    assert [tuple(r) for r in js.columnar_info(shredded, "d", {"b": ("a.b", "int")}).collect()] == [("b", "$.a.b", "int", 2, 0.4)]
    assert js.refreshed(shredded.withColumn("b", F.lit(9)), "d", {"b": ("a.b", "int")}).agg(F.sum("b")).first()[0] == 3
    top = js.auto_extract(js.path_stats(df, "d"), {"a.b": 10, "t": 9, "a": 99}, 5).collect()
    assert [r.path for r in top] == ["$.t", "$.a.b"]


def test_vector_cells(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 50 = 0")
    exact = {(r.q, r.n) for r in vector.nearest(e, "vec_id", "embedding", q, 5).collect()}
    assert exact == {(r.q, r.n) for r in vector.nearest(e, "vec_id", "embedding", q, 5, block=3).collect()}
    cells = vector.Cells(e, "vec_id", "embedding", lists=20)
    index = cells.indexed(e)
    assert index.count() == e.count() and index.where("cell is null").isEmpty()
    found = {(r.q, r.n) for r in cells.search(index, q, 5, probe=15).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert {(r.q, r.n) for r in cells.search(index, q, 5, probe=20, block=2).collect()} == exact
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id int, embedding array<double>")
    assert {r.vec_id: r.cell for r in vector.Cells(odd, "vec_id", "embedding").indexed(odd).collect()} == {1: 0, 2: None}
    assert vector.Cells(odd.limit(0), "vec_id", "embedding").indexed(odd.limit(0)).count() == 0
    assert odd.where("vec_id = 1").select(vector.typed(F.col("embedding"), 2).alias("x")).first().x == [1.0, 2.0]
    with pytest.raises(Exception, match="3 dimensions"):
        odd.select(vector.typed(F.col("embedding"), 3)).collect()
