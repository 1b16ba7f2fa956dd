"""Tables from URLs: kind by prefix, format by extension."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Prefixes of places, and formats by file extension.
KINDS = {"s3://": "s3", "s3a://": "s3", "gs://": "gcs", "az://": "azure", "abfss://": "azure", "http://": "http", "https://": "http", "file://": "file", "/": "file"}
FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "avro": "avro", "orc": "orc"}


def kind(url: str) -> str:
    return next((k for p, k in KINDS.items() if url.startswith(p)), "table")


def file_format(url: str) -> str:
    name = url.split("?")[0].rstrip("/")
    return FORMATS.get(name.removesuffix(".gz").rpartition(".")[2].lower(), "parquet")


def load(spark: SparkSession, url: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table by name, or files; csv has a header and multi-line JSON is asked for by an option."""
    if kind(url) == "table":
        return spark.table(url)
    f = file_format(url)
    r = spark.read.format(f).options(**({"header": "true"} if f == "csv" else {}) | options)
    return (r.schema(schema) if schema else r).load(url)


def save(df: DataFrame, url: str, mode: str = "append", partition_by: tuple[str, ...] = (), **options: str) -> None:
    w = df.write.format(file_format(url)).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(url)


def new_files(spark: SparkSession, path: str, schema: str, pattern: str = "*", fmt: str = "json", per_trigger: int = 1000) -> DataFrame:
    """A stream of the files of a folder whose names match; its checkpoint remembers what has been read."""
    return spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs on one machine, a
    temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; set it to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
