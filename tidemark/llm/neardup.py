"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Texts with an equal hash are one item from here on.
2. SimHash, by simhash's own steps: a bit of the fingerprint is set if more than half of the shingles have it. At so wide a radius
   64 bits and bands that are exact choose nothing, so the fingerprint is BANDS pieces of BITS bits, and two texts that agree in one
   piece are compared bit-sliced in the first WORDS words and linked within RADIUS. Links become coarse components.
   Two bits differ with probability 0.15 to 0.16 in texts at similarity 0.8 (0.188 in those of 4 and 5 shingles, the most there is): a
   pair at 0.8 itself is missed with probability 1 in 10^6, or 5 in 100,000 of those; others of a component join them besides.
3. The shingle sets of each coarse component come together once, in chunks of at most CHUNK, every pair of chunks in a task of its
   own. Every pair of texts there is compared exactly; a spanning forest of the pairs at 0.8 or more goes on.
4. These links become components.

Defined results: as in simhash, of which the words are. Null, empty and blank texts are alike, and a text of fewer words than a
shingle is one shingle. A component keeps the row of its smallest doc_id; null ids come last, and ties go to the smallest hash of the text.
Whole texts are compared, however long; an empty table gives an empty one; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, fresh, stored
from tidemark.llm.simhash import components, firsts_only, forest, links_in_keys, named_by_root, space_words

BANDS, BITS, WORDS, RADIUS, CHUNK = 117, 12, 3, 60, 512
#: Columns, shingles, that are multiplied at once.
BLOCK = 4096
_RNG = np.random.default_rng(42)
#: For each word of the fingerprint, what makes its bits of a shingle's hash.
TIMES = _RNG.integers(0, 1 << 63, -(-BANDS * BITS // 64), np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _RNG.integers(0, 1 << 63, len(TIMES), np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    w = space_words(text or "")
    ends = range(words, len(w) + 1) if len(w) > words else [len(w)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(w[max(0, e - words) : e]), 42) for e in ends], np.uint64))


def shingle_bits(found: np.ndarray) -> np.ndarray:
    """(n, bits) of 0 and 1: the fingerprint of each shingle alone."""
    x = (found[:, None] ^ FLIP) * TIMES
    x = (x ^ (x >> np.uint64(32))) * MIX
    x ^= x >> np.uint64(29)
    return np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The bits that more than half of the shingles have; where it is just half, those of the least shingle."""
    votes = np.zeros(64 * len(TIMES), np.int64)
    for at in range(0, len(found), 255):  # so many add up in a byte
        votes += np.add.reduce(shingle_bits(found[at : at + 255]), axis=0, dtype=np.uint8)
    return (2 * votes + shingle_bits(found[:1])[0] > len(found)).astype(np.uint8)


def print_keys(bits: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The words of a fingerprint that are compared, as signed longs, and its key in each band."""
    words = np.packbits(bits[: 64 * WORDS], bitorder="little").view("<i8")
    return words.tolist(), bits[: BANDS * BITS].reshape(BANDS, BITS) @ (1 << np.arange(BITS, dtype=np.int16))


def alike(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the sets whose Jaccard similarity is percent or more; where both sides 0 and 1 occur, only between them."""
    size = np.array([len(s) for s in sets])
    doc, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    doc, flat = doc[order], flat[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # what one text has alone counts in its size only
    doc, column = doc[shared], column[shared]
    if not len(doc):
        return np.zeros(0, int), np.zeros(0, int)
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    both = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(column[-1]) + 1, BLOCK):
        lo, hi = np.searchsorted(column, [at, at + BLOCK])
        x = np.zeros((len(sets), min(BLOCK, int(column[-1]) + 1 - at)), np.float32)
        x[doc[lo:hi], column[lo:hi] - at] = 1
        both += (x @ x.T).astype(np.int64)
    near = 100 * both >= percent * (size[:, None] + size - both)
    a, b = np.nonzero(np.triu(near, 1))
    ok = (side[a] != side[b]) | (side[a] < 0)
    return a[ok], b[ok]


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a > b: a spanning forest of the pairs at percent or more within each root of sets (root, mark, shingles)."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("mark"), F.col("c")).cast("int")
    # with c chunks, chunk m meets each other chunk once, and itself
    pairs = F.when(F.col("c") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda x: F.struct(F.least(x, "m").alias("i"), F.greatest(x, "m").alias("j"), F.when(x == F.col("m"), -1).when(x < F.col("m"), 1).otherwise(0).alias("side")))
    )
    dealt = sets.withColumn("c", chunks).withColumn("m", mine).select("root", "mark", "shingles", F.explode(pairs).alias("x"))
    group = ["root", "i", "j"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(rows: list[tuple]) -> pd.DataFrame:
            marks = np.array([r[1] for r in rows], np.int64)
            a, b = alike([np.frombuffer(r[3], "<u8") for r in rows], np.array([r[2] for r in rows]), percent)
            root = forest(a, b, len(rows))
            moved = np.flatnonzero(root != np.arange(len(rows)))
            x, y = marks[moved], marks[root[moved]]
            return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})

        rows: list[tuple] = []
        for x in fresh(parts):
            for r in zip(x["group"], x["mark"], x["side"], x["shingles"]):
                if rows and rows[0][0] != r[0]:
                    yield out(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield out(rows)

    ready = dealt.select("root", "x.i", "x.j", "x.side", "mark", "shingles").repartition(*group).sortWithinPartitions(*group)
    return ready.select(F.concat_ws(",", *group).alias("group"), "mark", "side", "shingles").mapInPandas(run, "a bigint, b bigint").distinct()


def coarsely(firsts: DataFrame) -> DataFrame:
    """(mark, root), stored, for firsts (mark, words, keys): the same root for what links of fingerprints join."""
    word = [F.col("words")[i].alias(f"word{i}") for i in range(WORDS)]
    banded = firsts.select(*word, F.posexplode("keys").alias("band", "key")).select((F.col("band") * (1 << BITS) + F.col("key")).alias("key"), *(f"word{i}" for i in range(WORDS)))
    large = stored(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bands")  # at most BANDS << BITS rows
    found = components(links_in_keys(banded.join(bounded(large), "key"), ["key"], [f"word{i}" for i in range(WORDS)], RADIUS))
    nodes = firsts.select("mark", word[0])
    return stored(nodes.join(bounded(found), F.col("word0") == F.col("node"), "left").select("mark", F.coalesce("root", "word0").alias("root")), "coarse")


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, first) for each row of docs, first as in simhash.near_duplicates."""

    @F.pandas_udf("words array<bigint>, keys array<smallint>")
    def keys(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in fresh(parts):
            yield pd.DataFrame([print_keys(fingerprint(shingles(t, words))) for t in x], columns=["words", "keys"])

    @F.pandas_udf("binary")
    def sets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in fresh(parts):
            yield pd.Series([shingles(t, words).astype("<u8").tobytes() for t in x], dtype="object")

    mark = F.xxhash64(text)
    prints = stored(docs.select(F.col(doc_id).alias("id"), mark.alias("mark"), keys(F.col(text)).alias("print")), "prints")
    firsts = stored(prints.groupBy("mark").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"), F.first("print").alias("print")).select("mark", "first", "print.*"), "firsts")
    coarse = coarsely(firsts)
    wanted = coarse.join(bounded(stored(coarse.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "sizes")), "root").join(firsts.select("mark", "first.id"), "mark").select("root", "n", F.col("mark").alias("wanted"), "id")
    wanted = bounded(stored(wanted, "wanted"))
    # of docs these columns alone, as others may have any name
    texts = docs.select(F.col(doc_id).alias("own"), mark.alias("h"), F.col(text).alias("t")).join(wanted, (F.col("h") == F.col("wanted")) & F.col("own").eqNullSafe(F.col("id")))
    texts = texts.select("root", "n", F.col("wanted").alias("mark"), sets(F.col("t")).alias("shingles")).dropDuplicates(["mark"])
    found = components(links(stored(texts, "shingles"), percent))
    return prints.select("id", "mark").join(bounded(named_by_root(firsts.select("mark", "first"), "mark", found)), "mark")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id."""
    return firsts_only(docs, stored(near_copies(docs, words, percent, doc_id, text), "found"), doc_id, text)
