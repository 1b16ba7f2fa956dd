"""Tables in chunks, refreshes, workflows, tasks, pools, streams and subscriptions."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes, tables, workflow
from tidemark.sources import files
from tidemark.streaming import cdc, pipeline


def events(spark, days=6):
    return spark.range(days * 24).select((F.timestamp_seconds(1704067200 + F.col("id") * 3600)).cast("timestamp_ntz").alias("time"), (F.col("id") % 3).cast("int").alias("device"), F.col("id").cast("double").alias("v"))


def test_hypertable(spark, tmp_path):
    t = tables.Hypertable(spark, f"{tmp_path}/h", "time", "1 day", space="device", spaces=2)
    t.insert(events(spark))
    assert t.read().count() == 144 and t.chunks().count() == 6
    part = t.read(datetime(2024, 1, 2, 12), datetime(2024, 1, 3, 6))
    assert part.count() == 18
    assert "PartitionFilters: [isnotnull(chunk_start" in part._jdf.queryExecution().executedPlan().toString()
    t.compress_chunk("2024-01-02T000000")
    assert t.read().count() == 144
    assert t.drop_chunks(datetime(2024, 1, 3, 12)) == ["2024-01-01T000000", "2024-01-02T000000"]
    assert t.read().count() == 96


def test_continuous_aggregate_and_maintenance(spark, tmp_path):
    t = tables.Hypertable(spark, f"{tmp_path}/h", "time")
    agg = lambda df: df.groupBy("bucket", "device").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    t.insert(events(spark))
    c = tables.ContinuousAggregate(t, f"{tmp_path}/c", "1 day", agg)
    c.create()
    t.insert(events(spark).limit(5))
    c.refresh(datetime(2024, 1, 1), datetime(2024, 1, 1, 23))
    whole = sorted(map(tuple, agg(c.bucketed(t.read())).collect()))
    assert sorted(map(tuple, c.read().collect())) == whole
    m = tables.Maintenance(t)
    m.add(tables.Policy("compression", timedelta(days=2)))
    m.add(tables.Policy("retention", timedelta(days=4)))
    assert m.run(datetime(2024, 1, 7))[-2:] == ["drop 2024-01-01T000000", "drop 2024-01-02T000000"]
    assert m.run(datetime(2024, 1, 7, 1)) == []
    d = tables.DynamicTable(spark, f"{tmp_path}/d", lambda s: agg(c.bucketed(t.read())), timedelta(hours=1))
    assert d.refresh(datetime(2024, 1, 7)) and not d.refresh(datetime(2024, 1, 7, 0, 30)) and d.refresh(datetime(2024, 1, 7, 2))
    with pytest.raises(ValueError):
        tables.DynamicTable(spark, "x", lambda s: None, timedelta(seconds=5))


def test_changes(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (None, "n")], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d"), (None, "m")], "k int, v string")
    got = {(r.k, r.event_type) for r in changes.changes(before, after, ["k"]).collect()}
    assert got == {(2, "update"), (3, "delete"), (4, "insert"), (None, "update")}
    c = changes.changes(before, after, ["k"])
    bag = lambda df: sorted(map(repr, df.collect()))
    assert bag(changes.apply_changes(before, c, ["k"])) == bag(after)
    assert bag(changes.upsert(before, after, ["k"])) == bag(after.unionByName(before.where("k = 3")))
    assert bag(changes.upsert(before, after, ["k"], update=False)) == bag(before.unionByName(after.where("k = 4")))
    assert bag(changes.apply_changes(before.limit(0), changes.initial_rows(before, ["k"]), ["k"])) == bag(before)
    total = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    more = before.unionByName(before)
    assert bag(tables.dynamic_increment(total(before), more, total, more.select("k").distinct(), ["k"])) == bag(total(more))
    by = lambda df: df.groupBy(F.col("k").alias("bucket")).agg(F.count("*").alias("n"))
    assert bag(tables.refreshed(by(before), more, by, more.select(F.col("k").alias("bucket")).distinct(), lambda d: d.withColumn("bucket", F.col("k")))) == bag(by(more))
    assert changes.stream_rows(c, "append").count() == 1 and changes.stream_rows(c, mode="keys_only", keys=["k"]).columns == ["event_type", "k"]


def test_workflow_and_tasks(spark):
    S = workflow.Step
    flow = workflow.Workflow([S("stage", "a", lambda s, t: s.range(5)), S("validate", "some", lambda s, t: t["a"].count() == 5), S("custom", "bad", lambda s, t: 1 / 0, retries=1, continue_on_error=True), S("transform", "b", lambda s, t: t["a"].where("id > 2"), when=lambda t: t["a"].count() > 1), S("notify", "never", lambda s, t: 1 / 0, when=lambda t: False)])
    run = flow.run(spark)
    assert run.tables["b"].count() == 2 and [x[2][:7] for x in run.log] == ["done", "done", "failed:", "done", "skipped"]
    with pytest.raises(ValueError):
        workflow.Workflow([S("validate", "no", lambda s, t: False)]).run(spark)
    ran = []
    w = workflow.Scheduler(spark)
    w.add(workflow.Task("a", lambda s: ran.append("a"), "*/5 * * * *"))
    w.add(workflow.Task("b", lambda s: ran.append("b"), "a"))
    w.add(workflow.Task("c", lambda s: 1 / 0, timedelta(minutes=1)))
    for m in range(4):
        w.tick(datetime(2024, 1, 1, 0, m + 2))
    assert ran == ["a", "b"] and w.tasks["c"].suspended
    load = workflow.Workload(spark)
    load.create("p", 1)
    assert load.submit("p", "1") and not load.submit("p", "2", "low") and not load.submit("p", "3", "high")
    assert load.finished("p") == "3" and load.finished("p") == "2" and load.finished("p") is None


def test_pipeline(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": 1, "name": "x"}\n[{"id": 2}, {"name": "lost"}]\nnot json\n{"id": "x"}\n')
    fields = [pipeline.Field("id", "id", required=True), pipeline.Field("name", "name", "upper(name)", default="NONE")]

    def go():
        p = pipeline.Pipeline("p", "file", f"{tmp_path}/out", f"{tmp_path}/ck", schema="id bigint,name string", options={"path": f"{tmp_path}/in"}, fields=fields, rejects=f"{tmp_path}/bad")
        p.start(spark, available_now=True).awaitTermination()
        return p

    assert go().status()["state"] == "stopped"
    (tmp_path / "in" / "2.json").write_text('{"id": 3, "name": "z"}\n')
    p = go()
    assert sorted(map(tuple, p.read(spark).collect())) == [(1, "X"), (2, "NONE"), (3, "Z")]
    assert sorted(map(tuple, p.read(spark, rejected=True).collect())) == [("not json", "not a record"), ('{"id": "x"}', "not of the schema"), ('{"name":"lost"}', "a required value is missing")]
    again = spark.createDataFrame([('{"id": 4}',)], "value string")
    p.write(again, 77)
    p.write(again, 77)  # a repeated batch
    assert p.read(spark).where("id = 4").count() == 1
    every = pipeline.Pipelines(spark)
    every.create(p)
    with pytest.raises(ValueError):
        every.create(p)
    assert list(every.status()) == ["p"] and every.drop("p") is None and not every.known
    with pytest.raises(ValueError):
        pipeline.Pipeline("q", "pigeon", "", "")


def test_pipeline_formats(spark, tmp_path):
    P = pipeline.Pipeline
    text = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = P("c", "file", "", "", "csv", "a int, b string", {"header": "true", "delimiter": ";"}).parsed(text("a;b", '1;"x;y"', "2;", "z;w"))
    assert sorted(map(tuple, good.collect())) == [(1, "x;y"), (2, None)] and [tuple(r) for r in bad.collect()] == [("z;w", "not of the schema")]
    good, _ = P("c", "file", "", "", "csv", options={"columns": "2"}).parsed(text("p,q"))
    assert [r.asDict() for r in good.collect()] == [{"col0": "p", "col1": "q"}]
    good, bad = P("l", "file", "", "", "line").parsed(text("m,h=a v=1 5", "oh no", "# c"))
    assert [r.measurement for r in good.collect()] == ["m"] and [tuple(r) for r in bad.collect()] == [("oh no", "not line protocol")]
    spark.range(5).write.parquet(f"{tmp_path}/p")
    p = P("p", "file", f"{tmp_path}/o", f"{tmp_path}/c", "parquet", "id bigint", {"path": f"{tmp_path}/p"}, [pipeline.Field("id", "n", "nullif(id, 3)", required=True)], f"{tmp_path}/r")
    p.resume(spark, available_now=True).awaitTermination()
    assert {r.n for r in p.read(spark).collect()} == {0, 1, 2, 4} and p.read(spark, rejected=True).first().record == '{"id":3}'
    r = P("r", "rate", f"{tmp_path}/ro", f"{tmp_path}/rc", "rate", options={"rowsPerSecond": "100"}, delivery="at_least_once")
    q = r.start(spark)
    import time

    for _ in range(60):
        time.sleep(0.5)
        if q.lastProgress and q.lastProgress["numInputRows"]:
            break
    r.stop()
    assert r.read(spark).columns == ["timestamp", "value"] and r.read(spark).count() > 0


def test_stream_joins_and_state(spark, tmp_path):
    spark.range(20).selectExpr("timestamp_seconds(1700000000 + id * 60) t", "id % 4 k", "id v").write.parquet(f"{tmp_path}/l")
    spark.range(20).selectExpr("timestamp_seconds(1700000030 + id * 60) u", "id % 4 k", "id w").write.parquet(f"{tmp_path}/r")
    left = lambda: spark.readStream.schema("t timestamp, k bigint, v bigint").parquet(f"{tmp_path}/l")
    right = spark.readStream.schema("u timestamp, k bigint, w bigint").parquet(f"{tmp_path}/r")

    def done(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    names = spark.createDataFrame([(0, "zero"), (1, "one")], "k bigint, name string")
    assert done(pipeline.enriched(left(), names, ["k"]), "static_join", "append").groupBy("name").count().count() == 3
    got = done(pipeline.paired(left(), right, ["k"], "t", "u", "5 minutes", "1 hour"), "stream_join", "append")
    assert {(r.v, r.w) for r in got.collect()} == {(v, w) for v in range(20) for w in range(20) if v % 4 == w % 4 and 0 <= w * 60 + 30 - v * 60 <= 300}
    got = done(pipeline.running_totals(left(), "k", "v"), "state", "update")
    assert {(r.k, r.n, r.total) for r in got.collect()} == {(k, 5, float(sum(range(k, 20, 4)))) for k in range(4)}


def test_windowed_stream(spark, tmp_path):
    events(spark, 1).write.parquet(f"{tmp_path}/e")
    s = spark.readStream.schema("time timestamp, device int, v double").parquet(f"{tmp_path}/e")
    q = pipeline.windowed(s, "time", "6 hours", "1 hour", ["device"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 24


def test_cdc(spark, tmp_path):
    rows = [("insert", "public", "a", 1, 5, None, {"id": 1}), ("delete", "public", "b", 2, 6, {"id": 2}, None), ("update", "audit", "a", 3, 7, {"id": 3}, {"id": 3})]
    spark.createDataFrame(rows, "event_type string, schema string, table string, lsn long, ts_ms long, before struct<id:int>, after struct<id:int>").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e").schema).parquet(f"{tmp_path}/e")
    sub = cdc.Subscription("s", include=["public.*"], exclude=["public.b"], format="debezium")
    sub.to_files(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    (line,) = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert json.loads(line)["op"] == "c" and json.loads(line)["before"] is None and json.loads(line)["after"] == {"id": 1}
    assert json.loads(line)["source"]["schema"] == "public" and json.loads(line)["source"]["table"] == "a"


def test_sources(spark, tmp_path):
    assert files.kind("s3://b/x.csv") == "s3" and files.kind("orders") == "table" and files.file_format("a/b.ndjson.gz") == "json" and files.file_format("a/b") == "parquet"
    files.save(spark.range(3), f"{tmp_path}/x.json")
    assert files.load(spark, f"{tmp_path}/x.json").count() == 3
