"""Quality rules: a table of thresholds compiled into one chain of Spark projections, without user functions.

Defined results: a null or empty text has no words, so it fails the base rule and isn't kept; doc_id is carried through,
null or repeated as it may be, one row out for each row in and none of an empty table; whole texts are judged, however long; other columns of the input are ignored, whatever their names.
Nothing is shuffled: each text is judged in the task that read it.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, split_words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was with as be on by at this from are or an a "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des du et en un une que qui est pour dans par sur au pas plus "
    "el los las y del se con por una su para es al lo como más o"
).split()


class Rule(NamedTuple):
    """measure must lie within low and high, both included; None is no bound."""

    name: str
    measure: str
    low: float | None
    high: float | None


#: The threshold table. Measures are SQL expressions over the columns of `measured`.
RULES = (
    Rule("words", "n_words", 50, None),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 2, 20),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", None, 0.25),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", 0.01, None),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", None, 0.5),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines / greatest(n_lines, 1)", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines / greatest(n_lines, 1)", None, 0.3),
)


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and the counts that rules use.

    Words in repeated 3-word windows: the windows' 64-bit hashes are compared first as a set. Only a text with a repeat
    sorts its (hash, position) pairs; equal neighbours are the repeated windows, whose words are then counted once each."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], t.alias("t"), split_words(t, SPACES).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "*",
        F.size("w").alias("n_words"),
        lines.alias("lines"),
        F.when(F.size("w") >= 3, F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), 1, F.size("w") - 2)).alias("h"),
    )
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    again = F.filter("s", lambda x, i: (x.h == F.get("s", i - 1).h) | (x.h == F.get("s", i + 1).h))
    df = df.withColumn("p", F.sort_array(F.transform(again, lambda x: x.p)))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("n_words").cast("long"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: x.isin(STOP_WORDS + [w.capitalize() for w in STOP_WORDS]))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*(?:[-*]|•)"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09\r]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of `measured` breaks, as one array expression."""
    broken = []
    for r in rules:
        x = F.expr(r.measure)
        out = [x < r.low] * (r.low is not None) + [x > r.high] * (r.high is not None)
        broken.append(F.when(reduce(lambda a, b: a | b, out), F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, the counts, base_failed, kept and broken_rules (comma-joined, in the table's order)."""
    df = measured(docs, text, keep)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("*", base.alias("base_failed"), verdict(rules).alias("b")).select("*", (~F.col("base_failed") & (F.size("b") == 0)).alias("kept"), F.array_join("b", ",").alias("broken_rules")).drop("b")
