"""From documents to packed sequences: toxic texts go, one of each group of near copies stays, every text in which a window of a benchmark
text stands goes, exactly or nearly and however long the text is, secrets are replaced, and what is left is packed. Each stage works on all that the stage before it kept, written as Parquet and read again.

Rows may have nulls in any column, be repeated, and have more columns than documents; all but the last stage keep the columns
they are given. An empty table passes through. Clean documents are kept by every stage that filters.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, neardup, packing, secrets, toxicity
from tidemark.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers come here with what earlier stages have left in memory: smaller stretches of texts, fewer cached ids
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), at_once=4_000_000, cached=50_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", replace_secrets),
    ("packing", pack),
]
#: A trained classifier, fingerprints and a tokenizer: no SQL says this. tests/llm holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
