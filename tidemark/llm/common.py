"""What the operators for training data share: table access, word splitting, scratch folders."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: ASCII white space; or ASCII that is neither letter nor digit.
SPACES = r"[\x20\x09-\x0D]+"
NON_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, between: str) -> Column:
    """The words of a text in order; null and empty texts have none. Only the first and last part can be empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def weight(df: DataFrame) -> Column:
    """About how many bytes a row takes: 16, and 8 for each number, the length of each text, and that of each list by its elements."""

    def of(c: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(kind, ArrayType):
            each = kind.elementType
            fields = [f.dataType for f in each.fields] if isinstance(each, StructType) else [each]
            if not any(isinstance(f, (StringType, BinaryType, ArrayType, StructType)) for f in fields):
                return F.coalesce(F.size(c), F.lit(0)) * (8 * len(fields) + 8)
            return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + of(x, each)), F.lit(0))
        if isinstance(kind, StructType):
            return sum((of(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields), F.lit(16).cast("long"))


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a hint to broadcast it, if all its rows together have no more than so many bytes; else no side is broadcast by
    this. df is computed once for that, so it's best a stored one."""
    return F.broadcast(df) if (df.agg(F.sum(weight(df)).alias("b")).first().b or 0) <= most else df


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is 0 modulo folds; a null id counts as held out, so nothing is learnt from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share. The session's spark.checkpoint.dir is used as it is;
    only where it is unset, as in tests on one machine, a temporary folder becomes the checkpoint folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset; set it to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            found = context._jsc.sc().getCheckpointDir()
        base = found.get()
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a scratch folder and read again: cuts lineage, and survives lost executors."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.parquet(path)


def fresh(parts: Iterator) -> Iterator:
    """parts, once the memory that this Python worker has freed is back with the system: workers live on from stage to stage,
    and what one stage has used and freed would count beside what the next one needs."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
    yield from parts
