"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone.

1. Every benchmark text is cut into windows of 13 words (a shorter text is one window), which are numbered.
2. The corpus frequency of each benchmark term is counted over all documents; each window's `probes` rarest terms are
   its probe terms.
3. The index stores postings (term, document, position) of the whole corpus as Parquet: of the probe terms alone, or of
   every term, for more than one benchmark.
4. A window's posting lists, each moved back by the term's offset in the window, are intersected as bits: a group is a document,
   a window and a stretch of places, and has a mask of places for each probe term. Masks that meet within `slop` places of each
   other are where the window may stand.
5. All words of a window are then compared in place. It stands *exactly* where they stand one after another, and *nearly* where
   a place s has each word o of it at one of s + o to s + o + slop: with up to slop words put in, say. Only windows of all 13 words
   can stand nearly, and what stands exactly stands nearly too.

The index has terms of `lower(word)`, which also folds letters beyond A-Z: that only adds candidates, as both sides are folded
word by word; the comparison has the contract's words. What grows with the benchmark or with the contaminated texts is broadcast up to a measured number of
bytes (`common.bounded`), beyond that it is joined by shuffle.

Defined results: null and empty texts have no words, no windows and are never contaminated. A row is known by its doc_id
and its text, so ids may be null or repeated: equal rows get equal results, one row out for each row in. Items with a null
item_id still mark words and windows but can't be listed; they aren't counted in n_items or n_near. An empty benchmark marks nothing,
and an empty table of documents gives an empty one. Very long texts are one row each, and only the words around a place leave it.
Other columns of the input are ignored, whatever their names, but for those named in keep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NON_WORDS, ascii_lower, bounded, split_words, stored

#: NON_WORDS for texts that aren't lower-cased yet.
CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N, PROBES, SLOP = 13, 2, 2
#: Places in one mask; with slop on both sides they must fit 64 bits.
WIDTH = 48
KEY = ("key", "mark")


def folded(text: Column) -> Column:
    """The words as the index has them, each lower-cased by itself. A capital sigma is the one letter whose lower case depends on
    what stands around it; texts without one are lower-cased as a whole."""
    return F.when(F.contains(text, F.lit("Σ")), F.transform(split_words(text, CASED), F.lower)).otherwise(split_words(F.lower(text), NON_WORDS))


def indexed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, mark, words); mark is a hash of the text."""
    return docs.select(F.col(doc_id).alias("key"), F.xxhash64(text).alias("mark"), folded(F.col(text)).alias("words"))


def windows(items: DataFrame, n: int = N, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, window): the distinct windows of each item, words joined by spaces."""
    df = items.select(F.col(item_id).cast("string").alias("item"), split_words(ascii_lower(F.col(text)), NON_WORDS).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    return df.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("window")).distinct()


def numbered(wins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wid, window), stored so that a number stays with its window, and (wid, item)."""
    texts = stored(wins.select("window").distinct().select(F.monotonically_increasing_id().alias("wid"), "window"), "windows")
    return texts, stored(wins.join(bounded(texts), "window").select("wid", "item"), "items")


def probe_terms(postings: DataFrame, texts: DataFrame, probes: int = PROBES) -> DataFrame:
    """(wid, n_probes, rank, term, offset): the rarest different terms of each window that can occur at all. postings: anything
    with a row (term, ...) for each occurrence of a term."""
    terms = stored(texts.select("wid", F.posexplode(F.split("window", " ")).alias("offset", "term")).withColumn("term", F.lower("term")), "terms")
    counts = stored(postings.select("term").join(bounded(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")), "counts")
    # a window has few terms, so that gathering them is bounded
    ranked = terms.join(bounded(counts), "term", "left").groupBy("wid").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("t")).where("least > 0")
    first = F.filter("t", lambda x, i: (i == 0) | (x.term != F.get("t", i - 1).term))
    picked = ranked.select("wid", F.slice(first, 1, probes).alias("t"))
    return picked.select("wid", F.size("t").alias("n_probes"), F.posexplode("t").alias("rank", "x")).select("wid", "n_probes", "rank", "x.term", "x.offset")


def index(docs: DataFrame, terms: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored postings (key, mark, pos, term): of every term, or of those in terms (term) alone."""
    df = indexed(docs, doc_id, text).select(*KEY, F.posexplode("words").alias("pos", "term"))
    return stored(df if terms is None else df.join(bounded(terms.distinct()), "term", "left_semi"), "postings")


def candidates(postings: DataFrame, probed: DataFrame, probes: int = PROBES, slop: int = SLOP) -> DataFrame:
    """(key, mark, places): places (start, wid) where the moved lists of all probe terms of a window meet within slop of each other;
    start is that of the rarest term. Lists are intersected as masks of WIDTH places and slop more on both sides."""
    if WIDTH + 2 * slop > 64:
        raise ValueError("slop is too wide for a mask")
    at = postings.join(bounded(probed), "term").select(*KEY, "wid", "n_probes", "rank", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    # the rarest term's places stand in one stretch, the others' also in the next one that they are close to
    stretch = lambda x: F.floor(x / WIDTH).cast("int")
    start = F.col("start")
    at = at.withColumn("b", F.explode(F.when(F.col("rank") == 0, F.array(stretch(start))).otherwise(F.array_distinct(F.array(stretch(start - slop), stretch(start + slop))))))
    at = at.withColumn("bit", F.expr(f"shiftleft(1L, cast(start - b * {WIDTH} + {slop} as int))"))
    masks = at.groupBy(*KEY, "wid", "b").agg(F.max("n_probes").alias("of"), *[F.bit_or(F.when(F.col("rank") == r, F.col("bit")).otherwise(0)).alias(f"m{r}") for r in range(probes)])
    wide = [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(f"m{r}", d) for d in range(slop + 1)] + [F.shiftrightunsigned(f"m{r}", d) for d in range(1, slop + 1)]) for r in range(1, probes)]
    met = reduce(lambda a, b: a.bitwiseAND(b), [F.when(F.col("of") > r + 1, w).otherwise(-1) for r, w in enumerate(wide)], F.col("m0"))
    masks = masks.select(*KEY, "wid", "b", met.alias("met")).where("met <> 0")
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("met", i) == 1)
    places = masks.select(*KEY, F.transform(places, lambda i: F.struct((F.col("b") * WIDTH + i - slop).alias("start"), F.col("wid").alias("wid"))).alias("places"))
    # a text has no more places than words, for each window length and item
    return stored(places.groupBy(*KEY).agg(F.flatten(F.collect_list("places")).alias("places")), "places")


def compared(docs: DataFrame, places: DataFrame, texts: DataFrame, n: int = N, slop: int = SLOP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, wid, size, starts, exact): windows that stand in a text nearly, or exactly from starts on."""
    df = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    df = df.join(bounded(places), F.col("id").eqNullSafe(F.col("key")) & (F.col("h") == F.col("mark"))).select(*KEY, "places", split_words(F.col("t"), CASED).alias("w"))
    low = lambda x: F.greatest(x.start - slop, F.lit(0))
    # only the words around a place go on with it
    around = F.transform("places", lambda x: F.struct(x.wid.alias("wid"), x.start.alias("start"), (x.start - low(x)).alias("before"), F.transform(F.slice("w", low(x) + 1, n + 2 * slop), ascii_lower).alias("near")))
    # w is named twice, so that Catalyst doesn't split the text for each place
    df = df.select(*KEY, F.explode(F.when(F.size("w") > 0, around)).alias("x")).select(*KEY, "x.*")
    df = df.distinct().join(bounded(texts), "wid").withColumn("words", F.split("window", " "))
    df = df.withColumn("exact", F.array_join(F.slice("near", F.col("before") + 1, F.size("words")), " ") == F.col("window"))
    stands = F.exists(F.sequence(F.lit(0), F.col("before")), lambda s: F.forall(F.transform("words", lambda x, o: F.array_contains(F.slice("near", s + o + 1, slop + 1), x)), lambda y: y))
    df = df.where(F.col("exact") | ((F.size("words") == n) & stands))
    return df.groupBy(*KEY, "wid").agg(F.first(F.size("words")).alias("size"), F.collect_set(F.when(F.col("exact"), F.col("start"))).alias("starts"), F.max("exact").alias("exact"))


def marked(docs: DataFrame, items: DataFrame, n: int = N, probes: int = PROBES, slop: int = SLOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", postings: DataFrame | None = None) -> DataFrame:
    """(key, mark, n_hit, items, near_items), stored, for each different row of docs in which a window stands. postings: an index of every
    term of docs, which is then read instead of being built."""
    texts, of = numbered(windows(items, n, item_id))
    terms = indexed(docs, doc_id, text).select(F.explode("words").alias("term")) if postings is None else postings
    probed = stored(probe_terms(terms, texts, probes), "probes")
    found = candidates(index(docs, probed.select("term"), doc_id, text) if postings is None else postings, probed, probes, slop)
    found = stored(compared(docs, found, texts, n, slop, doc_id, text), "found")
    listed = found.select(*KEY, "wid", "exact").join(bounded(of), "wid").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.array_sort(F.collect_set("item")).alias("near_items"))
    hits = F.flatten(F.collect_list(F.transform("starts", lambda s: F.sequence(s, s + F.col("size") - 1))))
    hits = found.groupBy(*KEY).agg(F.size(F.array_distinct(F.flatten(hits))).cast("long").alias("n_hit"))
    same = F.col("h.key").eqNullSafe(F.col("l.key")) & (F.col("h.mark") == F.col("l.mark"))
    return stored(hits.alias("h").join(listed.alias("l"), same, "left").select("h.key", "h.mark", "n_hit", "items", "near_items"), "marked")


def contamination(docs: DataFrame, items: DataFrame, n: int = N, probes: int = PROBES, slop: int = SLOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", keep: tuple[str, ...] = (), postings: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, n_near, near_items (ids as strings, sorted) and keep's columns, for each row of docs."""
    found = bounded(marked(docs, items, n, probes, slop, doc_id, text, item_id, postings))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.size(split_words(F.col(text), CASED)).cast("long").alias("n_words"), *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)])
    out = rows.join(found, F.col("id").eqNullSafe(F.col("key")) & (F.col("h") == F.col("mark")), "left")
    none = F.array().cast("array<string>")
    of = lambda c: F.coalesce(F.size(F.coalesce(c, none)), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), of("items").alias("n_items"), F.coalesce("items", none).alias("items"), of("near_items").alias("n_near"), F.coalesce("near_items", none).alias("near_items"), *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in which no window stands, neither exactly nor nearly, with all their columns. Texts stay where they are
    unless the rows to drop are more than can be broadcast."""
    gone = bounded(marked(docs, items, doc_id=doc_id, text=text).select(F.col("key").alias("gone_id"), F.col("mark").alias("gone_mark")))
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs[text]) == gone["gone_mark"]), "left_anti")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    df = contamination(docs, items)
    return df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "n_near")
