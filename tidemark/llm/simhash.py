"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared bit-sliced, linked within a Hamming radius.

1. A fingerprint bit is set if more than half of the text's shingle hashes (XXH64, seed 42) have it.
2. Equal fingerprints are one item from here on; copies cost nothing more.
3. Cut into radius + extra pieces, two fingerprints within the radius agree in at least `extra` pieces: each choice of
   `extra` pieces is a band, and only fingerprints with equal keys in a band are compared. `extra` grows with the count of
   fingerprints, so that a key holds about as many of them at every size. A key of more than CHUNK fingerprints is dealt
   out as pairs of chunks: no task ever holds more than two chunks of one key.
4. Comparison is bit-sliced: 64 fingerprints form a block of bit planes, one for each bit (plane p has bit p of each). A fingerprint is
   held against a block by XOR with its own bit, spread over the plane; the 64 distances are kept in carry-save counters
   that saturate beyond the radius, and a block is abandoned once all 64 have. From what is left only a spanning forest
   goes on, so that a group of m near copies gives fewer than m links for each task.
5. Links become components by alternating large-star and small-star steps until nothing changes.

Defined results: null, empty and blank texts have no shingles and the fingerprint zero, linked like any other. doc_id may
repeat: rows are judged by their text, and a component's name is its smallest doc_id. A row with a null doc_id takes part
in linking, but never names a component unless all its ids are null. One row out for each row in, and none of an empty table. Whole
texts count, however long; other columns are ignored, or kept as they are by `deduplicated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, bounded, fresh, stored

BITS, CHUNK = 64, 4096
#: How many (fingerprint, block) pairs are compared at once, and how many links a task gathers before it makes one forest of them.
PAIRS, LINKS = 1 << 15, 1 << 20


def space_words(text: str) -> list[bytes]:
    """Words between \\x20 and \\x09-\\x0D, A-Z lower-cased, in UTF-8: on bytes, split() knows just these spaces and lower() just these letters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, words: int = 4) -> int:
    w = space_words(text or "")
    if not w:
        return 0
    ends = range(words, len(w) + 1) if len(w) > words else [len(w)]
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(BITS, np.int64), len(ends)
    at = 0
    while at < n:  # by stretches, so that a very long text needs no more memory than a shorter one
        part = [digest(b" ".join(w[max(0, e - words) : e]), 42) for e in ends[at : at + 100_000]]
        votes += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        at += 100_000
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, fp): a hash of the text, and the fingerprint as a signed long."""

    @F.pandas_udf("bigint")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in fresh(parts):
            yield pd.Series(np.array([fingerprint(t, words) for t in x], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark"), fp(F.col(text)).alias("fp"))


def pieces(radius: int, n: int) -> int:
    """`extra`: enough agreeing pieces for keys to be about as many as a quarter of the fingerprints."""
    extra = 1
    while 2 ** (BITS * extra // (radius + extra)) * 1024 < n:
        extra += 1
    return extra


def bands(fp: Column, radius: int, extra: int) -> list[Column]:
    """The key of each band."""
    k = radius + extra
    cuts = [BITS * i // k for i in range(k + 1)]
    part = [F.shiftrightunsigned(F.shiftleft(fp, BITS - b), BITS - b + a) for a, b in zip(cuts, cuts[1:])]
    widths = [b - a for a, b in zip(cuts, cuts[1:])]
    keys = []
    for chosen in combinations(range(k), extra):
        key = part[chosen[0]]
        for i in chosen[1:]:
            key = F.shiftleft(key, widths[i]).bitwiseOR(part[i])
        keys.append(key)
    return keys


def planes(fps: np.ndarray) -> np.ndarray:
    """(64 w, blocks) for fingerprints of w words, (n, w): word b of plane p has bit p of fingerprints 64 b to 64 b + 63. n is a multiple of 64."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def compared(sliced: np.ndarray, fps: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each i, fps[i] against block[i]: the i and the word of bits within the radius, where there are any.

    As many counter planes as the radius has bits hold each distance; `over` marks what went beyond the radius or them."""
    at = np.arange(len(fps))
    over, *counts = np.zeros((1 + radius.bit_length(), len(fps)), np.uint64)
    for p in range(len(sliced)):
        carry = sliced[p][block] ^ (np.uint64(0) - ((fps[:, p // BITS] >> np.uint64(p % BITS)) & np.uint64(1)))
        for k, c in enumerate(counts):
            counts[k], carry = c ^ carry, c & carry
        over |= carry
        if p % 8 == 7:
            above = np.zeros_like(over)
            equal = ~above
            for k in range(len(counts) - 1, -1, -1):
                if not radius >> k & 1:
                    above |= equal & counts[k]
                    equal &= ~counts[k]
                else:
                    equal &= counts[k]
            over |= above
            if p > 8 and not (keep := over != ~np.uint64(0)).all():
                at, fps, block, over = at[keep], fps[keep], block[keep], over[keep]
                counts = [c[keep] for c in counts]
                if not len(at):
                    break
    return at, ~over


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of 0 to n-1's component under links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def spanned(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(a, b), a > b: a spanning forest of the links between nodes, each to the least node of its component."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*found) if found else ((), ())))
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root = forest(at[: len(a)], at[len(a) :], len(nodes))
    moved = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})


def linked(group: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to), as positions, that span what is within the radius in each group. Rows of a group lie together, fps is (n, words);
    where both sides 0 and 1 occur, only links between them are sought."""
    order = np.arange(len(fps))
    first = np.r_[True, group[1:] != group[:-1]]
    g = np.cumsum(first) - 1
    start = order[first]
    size = np.diff(np.r_[start, len(fps)])
    n_blocks = -(-size // 64)
    base = np.r_[0, np.cumsum(n_blocks)]  # first block of each group
    slot = base[g] * 64 + (order - start[g])
    padded, owner = np.zeros((base[-1] * 64, fps.shape[1]), np.uint64), np.full(base[-1] * 64, -1)
    padded[slot], owner[slot] = fps, order
    sliced = planes(padded)
    used = np.packbits(owner >= 0, bitorder="little").view("<u8")
    todo = n_blocks[g] - (order - start[g]) // 64  # blocks from its own on
    cum = np.r_[0, np.cumsum(todo)]
    root, a, b = order.copy(), [], []
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + PAIRS, "right")) - 1)
        q = np.repeat(order[at:to], todo[at:to])
        block = base[g[q]] + (order[q] - start[g[q]]) // 64 + (np.arange(len(q)) - np.repeat(cum[at:to] - cum[at], todo[at:to]))
        i, word = compared(sliced, fps[q], block, radius)
        word = word & used[block[i]]
        bits = np.unpackbits(word.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, c = np.nonzero(bits)
        x, y = q[i[r]], owner[block[i[r]] * 64 + c]
        ok = (x < y) & ((side[x] != side[y]) | (side[x] < 0))
        a, b = x[ok], y[ok]
        if len(a):  # what earlier rounds have joined stays joined
            root = forest(np.r_[order, a], np.r_[root, b], len(fps))
        at = to
    moved = order[root != order]
    return moved, root[moved]


def links(prints: DataFrame, radius: int, extra: int) -> DataFrame:
    """(a, b): for distinct fingerprints `fp`, links that join whatever is within the radius, a > b."""
    banded = prints.select("fp", F.posexplode(F.array(*bands(F.col("fp"), radius, extra))).alias("band", "key"))
    large = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return links_in_keys(banded.join(large, ["band", "key"]), ["band", "key"], ["fp"], radius)


def links_in_keys(banded: DataFrame, keys: list[str], fp: list[str], radius: int) -> DataFrame:
    """(a, b), a > b: of rows (keys, fp, n), n of them with these keys, links that join what has equal keys and is within the radius.
    fp names the words of a fingerprint; the first one is its node."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64(fp[0]), chunks).cast("int")
    # with c chunks, chunk m meets each other chunk once, and itself
    pairs = F.when(chunks == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda x: F.struct(F.least(x, "m").alias("i"), F.greatest(x, "m").alias("j"), F.when(x == F.col("m"), -1).when(x < F.col("m"), 1).otherwise(0).alias("side")))
    )
    dealt = banded.select(*keys, *fp, chunks.alias("c"), mine.alias("m"), "n").select(*keys, *fp, F.explode(pairs).alias("x")).select(*keys, "x.i", "x.j", "x.side", *fp)
    group = [*keys, "i", "j"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def out(x: pd.DataFrame, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            fps = np.ascontiguousarray(x[fp].to_numpy(np.int64))
            a, b = linked(g, x["side"].to_numpy(), fps.view(np.uint64), radius)
            return fps[a, 0], fps[b, 0]

        found: list[tuple[np.ndarray, np.ndarray]] = []
        for x in fresh(parts):
            x = x if rest is None else pd.concat([rest, x], ignore_index=True)
            by = x[group].to_numpy(np.int64)
            g = np.cumsum(np.r_[False, (by[1:] != by[:-1]).any(1)])
            whole = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            if whole:
                found.append(out(x[:whole], g[:whole]))
            rest = x[whole:]
            if sum(len(a) for a, _ in found) > LINKS:
                yield spanned(found)
                found = []
        if rest is not None and len(rest):
            found.append(out(rest, np.zeros(len(rest), int)))
        # what keys have in common is linked once for all the keys of a task
        yield spanned(found)

    ready = dealt.repartition(*group).sortWithinPartitions(*group).select(*group, "side", *fp)
    # tasks link a node to different ones: it keeps its least, and that has the others, which many nodes have in common
    stars = ready.mapInPandas(run, "a bigint, b bigint").groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("to"))
    least = F.element_at("to", 1)
    pairs = F.transform("to", lambda b: F.struct(F.when(b == least, F.col("a")).otherwise(b).alias("a"), least.alias("b")))
    return stars.select(F.explode(pairs).alias("x")).select("x.a", "x.b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b), a > b, reaches. Alternates large-star and
    small-star steps; each step is an aggregation for the least neighbour and a join, and its result is written out.

    A node may have most edges, the smallest one of a large component: the least neighbours, one row for each node, are
    broadcast while the count of edges says that they are small, and beyond that AQE splits the node's edges."""
    edges, before = stored(edges.select("a", "b").distinct(), "edges"), None
    n = edges.count()
    while True:
        small_enough = F.broadcast if 2 * n * 32 <= BROADCAST_BYTES else lambda df: df
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(small_enough(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_enough(least), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a > b").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, n = now, now.n


def named_by_root(firsts: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, first), stored: for each row (key, first) of firsts the least first of its component in found (node, root). A component
    may hold most rows: the least of each is aggregated partly before it is dealt out, and broadcast by its measured bytes."""
    df = stored(firsts.join(found, F.col(key) == F.col("node"), "left").select(key, F.coalesce("root", key).alias("root"), "first"), "named")
    names = stored(df.groupBy("root").agg(F.min("first").alias("first")), "names")
    return stored(df.drop("first").join(bounded(names), "root").select(key, "first"), "named")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, fp, first) for each row of docs. first is the row of its component with the smallest id, as a struct
    (none, id, mark): ties between equal ids go to the smallest hash of the text."""
    prints = stored(fingerprints(docs, words, doc_id, text), "prints")
    # equal fingerprints are partly aggregated before they are dealt out
    firsts = stored(prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")), "firsts")
    found = components(links(firsts.select("fp"), radius, pieces(radius, firsts.count())))
    return prints.join(bounded(named_by_root(firsts, "fp", found)), "fp").select("id", "mark", "fp", "first")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id."""
    return firsts_only(docs, stored(near_duplicates(docs, words, radius, doc_id, text), "found"), doc_id, text)


def firsts_only(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs that are first in found (id, mark, first). Texts stay where they are unless the rows to drop
    are more than can be broadcast; only rows that are equal in id and text are dealt out, to keep one of each."""
    gone = found.where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")))).select("id", "mark").distinct()
    twice = found.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("id", "mark")
    mark = F.xxhash64(text)

    def on(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return df.join(bounded(keys), df[doc_id].eqNullSafe(keys["id"]) & (mark == keys["mark"]), how)

    left = on(docs, gone, "left_anti")
    if twice.isEmpty():
        return left
    return on(left, twice, "left_anti").unionByName(on(left, twice, "left_semi").dropDuplicates([doc_id, text]))
