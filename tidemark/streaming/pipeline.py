"""Ingestion pipelines on Structured Streaming: a source, a format, field transforms, a table; and windowed streams."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.ingest import line_protocol


@dataclass
class Field:
    source: str
    target: str
    expression: str | None = None
    default: Any = None
    required: bool = False


def transform(df: DataFrame, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """The transformed rows, and the rows of df that lack a required value."""
    value = {f.target: F.coalesce(F.expr(f.expression) if f.expression else F.col(f.source), F.lit(f.default)) for f in fields}
    lacking = F.lit(False)
    for f in fields:
        if f.required:
            lacking = lacking | value[f.target].isNull()
    return df.where(~lacking).select(*[v.alias(k) for k, v in value.items()]), df.where(lacking)


#: What a rejected record is kept as.
REJECTED = "record string, reason string"


@dataclass
class Pipeline:
    """source: kafka, file, table or rate, with Spark's options. format: json, csv or line, of the source's text; parquet of files; rate has
    its own rows. A CSV format has the options delimiter, header (lines equal to the header are left out) and columns (their number, when no
    schema is given: they are col0, col1, ... as text).

    Each micro-batch is written to a folder of its own number, which a repeated batch writes anew: each record arrives once. With delivery
    `at_least_once` batches append instead. Records that don't parse, don't fit the schema or lack a required value go to the `rejects` folder
    as they came, with the reason."""

    name: str
    source: str
    target: str
    checkpoint: str
    format: str = "json"
    schema: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    fields: list[Field] = field(default_factory=list)
    rejects: str | None = None
    delivery: str = "exactly_once"
    query: StreamingQuery | None = None

    OWN = ("path", "delimiter", "header", "columns", "table")

    def __post_init__(self):
        if self.source not in ("kafka", "file", "table", "rate") or self.format not in ("json", "csv", "line", "parquet", "rate") or self.delivery not in ("exactly_once", "at_least_once"):
            raise ValueError(f"no such source, format or delivery: {self.source}, {self.format}, {self.delivery}")
        if self.format == "csv" and not self.schema:
            self.schema = ", ".join(f"col{i} string" for i in range(int(self.options["columns"])))

    def texts(self, spark: SparkSession) -> DataFrame:
        """The source as a stream: of text in `value`, or of rows that have their columns already."""
        r = spark.readStream.options(**{k: v for k, v in self.options.items() if k not in self.OWN})
        if self.source == "kafka":
            return r.format("kafka").load().select(F.col("value").cast("string").alias("value"))
        if self.source == "rate":
            return r.format("rate").load()
        if self.source == "table":
            return r.table(self.options["table"])
        if self.format == "parquet":
            return r.schema(self.schema).parquet(self.options["path"])
        return r.format("text").load(self.options["path"])

    def parsed(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows, rejected records) of a batch of the source."""
        if "value" not in texts.columns or self.format in ("parquet", "rate"):
            return self.checked(texts, [])
        if self.format == "line":
            df = line_protocol(texts).withColumn("_why", F.when(F.col("measurement").isNull(), "not line protocol")).withColumnRenamed("line", "_record")
            return self.checked(df, ["_record", "_why"])
        known = f"{self.schema}, _corrupt string"
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        if self.format == "csv":
            sep = self.options.get("delimiter", ",")
            df = texts.where(F.trim("value") != "")
            if self.options.get("header") == "true":
                df = df.where(F.col("value") != sep.join(f.name for f in _fields(self.schema)))
            df = df.select(F.col("value").alias("_record"), F.from_csv("value", known, options | {"sep": sep}).alias("r"))
        else:
            # one record, or an array of them; each is held against the schema by itself
            wrapped = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
            df = texts.where(F.trim("value") != "").select("value", F.explode_outer(F.from_json(wrapped, "array<string>")).alias("e"))
            df = df.select(F.when(F.trim("value").startswith("["), F.coalesce("e", "value")).otherwise(F.col("value")).alias("_record"), F.when(F.col("e").isNotNull(), F.from_json("e", known, options)).alias("r"))
        why = F.when(F.col("r").isNull(), "not a record").when(F.col("r._corrupt").isNotNull(), "not of the schema")
        return self.checked(df.select("_record", why.alias("_why"), "r.*").drop("_corrupt"), ["_record", "_why"])

    def checked(self, df: DataFrame, marks: list[str]) -> tuple[DataFrame, DataFrame]:
        good, bad = (df.where("_why is null"), df.where("_why is not null").select(F.col("_record").alias("record"), F.col("_why").alias("reason"))) if marks else (df, None)
        if self.fields:
            good, lacking = transform(good, self.fields)
            record = F.col("_record") if marks else F.to_json(F.struct("*"))
            lacking = lacking.select(record.alias("record"), F.lit("a required value is missing").alias("reason"))
            bad = lacking if bad is None else bad.unionByName(lacking)
        return good.drop(*marks), bad if bad is not None else df.sparkSession.createDataFrame([], REJECTED)

    def write(self, batch: DataFrame, number: int) -> None:
        good, bad = self.parsed(batch)
        for df, where in ((good, self.target), (bad, self.rejects)):
            if where and self.delivery == "exactly_once":
                df.write.mode("overwrite").parquet(f"{where}/batch={number}")
            elif where:
                df.write.mode("append").parquet(where)

    def start(self, spark: SparkSession, available_now: bool = False) -> StreamingQuery:
        w = self.texts(spark).writeStream.queryName(self.name).foreachBatch(self.write).option("checkpointLocation", self.checkpoint)
        self.query = (w.trigger(availableNow=True) if available_now else w).start()
        return self.query

    def read(self, spark: SparkSession, rejected: bool = False) -> DataFrame:
        return spark.read.parquet(self.rejects if rejected else self.target).drop("batch")

    def stop(self) -> None:
        if self.query:
            self.query.stop()

    pause = stop

    def resume(self, spark: SparkSession, available_now: bool = False) -> StreamingQuery:
        """Goes on where the checkpoint says."""
        return self.query if self.query and self.query.isActive else self.start(spark, available_now)

    def status(self) -> dict:
        if not self.query:
            return {"state": "created"}
        p = self.query.lastProgress
        return {"state": "running" if self.query.isActive else "stopped", "rows": p["numInputRows"] if p else 0}


def _fields(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


@dataclass
class Pipelines:
    """Pipelines by name."""

    spark: SparkSession
    known: dict[str, Pipeline] = field(default_factory=dict)

    def create(self, pipeline: Pipeline) -> Pipeline:
        if pipeline.name in self.known:
            raise ValueError(f"there is a pipeline {pipeline.name}")
        self.known[pipeline.name] = pipeline
        return pipeline

    def drop(self, name: str) -> None:
        """The table and the checkpoint stay."""
        self.known.pop(name).stop()

    def status(self) -> dict[str, dict]:
        return {n: p.status() for n, p in self.known.items()}


def windowed(stream: DataFrame, time: str, width: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts by window and key of a stream; rows later than the watermark are dropped, as its state is."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def enriched(stream: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A stream joined with a table as it stands when each micro-batch is read."""
    return stream.join(table, on, how)


def paired(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Rows of two streams with equal keys, the right one's time from the left one's on and at most `within` after it. Both watermarks and the
    bound on time let state go. The right keys are dropped."""
    l, r = left.withWatermark(left_time, late).alias("l"), right.withWatermark(right_time, late).alias("r")
    cond = (F.col(f"r.{right_time}") >= F.col(f"l.{left_time}")) & (F.col(f"r.{right_time}") <= F.col(f"l.{left_time}") + F.expr(f"INTERVAL {within}"))
    for k in on:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, cond).select("l.*", *[F.col(f"r.{c}").alias(c if c not in left.columns else f"right_{c}") for c in right.columns if c not in on])


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) of each key that a micro-batch has rows of: counts and sums over all its rows so far, held as state by key."""
    import pandas as pd

    kind = stream.schema[key].dataType.simpleString()

    def step(k, parts, state):
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p["v"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    df = stream.select(F.col(key), F.col(value).cast("double").alias("v"))
    return df.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n bigint, total double", "n bigint, total double", "update", "NoTimeout")
