"""Personal data, natively: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Splitting a text by a pattern and extracting the pattern's matches give the same matches in the same order, so each
span's position is a prefix sum over the lengths of parts and matches. Nothing is shuffled and no Python runs.

Patterns are written for linear time on any text: possessive, and tried only where a run of their characters starts.
The rewritten ones match what the plain forms match, leftmost and non-overlapping.

Defined results: a null or empty text has no spans, an empty table gives an empty one. Whole texts are searched, however long. Spans
of one kind don't overlap, spans of different kinds may; those that tie in start are in the order of kinds. One row out for each row in;
ids may be null or repeated; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


class Kind(NamedTuple):
    """trigger: a cheap test of the whole text. A span counts if its checksum holds and its score reaches least: weight, and near
    more if one of the context words stands as a word of its own within 40 code points, up to the spans of its kind before and after."""

    name: str
    pattern: str
    trigger: str
    weight: float
    near: float
    context: str
    least: float = 0.0


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 0.1, "e-?mail|mail|contact|write|kontakt|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]+\.[0-9]", 0.6, 0.3, "host|server|address|adresse|ip"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", 0.7, 0.3, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, 0.3, "phone|telephone|call|tel|mobile|fax|anruf"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", 0.8, 0.2, "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.3, 0.5, "ssn|social security|tax id", 0.5),
)
#: Kinds whose spans a score never drops.
BASE = ("email", "ip", "card", "phone")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Of up to 19 digits; zeros put before a number don't change its sum."""
    n, total = F.lpad(number, 19, "0"), F.lit(0)
    for i in range(1, 20):
        x = F.substring(n, i, 1).cast("int")
        total = total + (x if i % 2 else F.when(x > 4, 2 * x - 9).otherwise(2 * x))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """The remainder of an IBAN without spaces, its first four characters moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.substr(moved, i, F.lit(1))), F.lit(0), lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97)


def confirmed(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "ip": lambda: m.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": lambda: n.between(16, 19) & luhn(digits(m)),
        "phone": lambda: n.between(8, 15),
        "iban": lambda: F.length(F.translate(m, " ", "")).between(15, 34) & (mod97(F.translate(m, " ", "")) == 1),
        "ssn": lambda: ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$"),
    }.get(kind, lambda: F.lit(True))()


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """keep's columns and found: an array of (kind, start, end, score) by kind as listed, then start. Positions count code
    points, the end excluded."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], t.alias("t"))
    df = df.select("*", *[F.when(F.contains("t", F.lit(k.trigger)) if k.name == "email" else F.col("t").rlike(k.trigger), F.struct(F.split("t", k.pattern, -1).alias("gaps"), F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0)).alias("m"))).alias(k.name) for k in kinds])
    df = df.select("*", *[steps(k.name).alias(f"steps_{k.name}") for k in kinds])
    df = df.select("*", *[blocks(f"steps_{k.name}").alias(f"blocks_{k.name}") for k in kinds])
    df = df.select("*", *[blocks(f"blocks_{k.name}").alias(f"many_{k.name}") for k in kinds])

    def spans(k: Kind) -> Column:
        gaps = F.col(f"{k.name}.gaps")

        def one(m: Column, i: Column) -> Column:
            before, many = F.floor(i / BLOCK).cast("int"), F.floor(i / BLOCK**2).cast("int")
            start = added(F.slice(f"many_{k.name}", 1, many)) + added(F.slice(f"blocks_{k.name}", many * BLOCK + 1, before - many * BLOCK)) + added(F.slice(f"steps_{k.name}", before * BLOCK + 1, i - before * BLOCK)) + F.length(F.get(gaps, i))
            around = F.concat(F.right(F.get(gaps, i), F.lit(40)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(40)))
            score = k.weight + F.when(F.lower(around).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{k.context})(?![\p{{L}}\p{{N}}])"), k.near).otherwise(0.0)
            return F.when(confirmed(k.name, m), F.struct(F.lit(k.name).alias("kind"), start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), score.alias("score")))

        made = F.filter(F.transform(f"{k.name}.m", one), lambda x: x.isNotNull() & (F.lit(k.name in BASE) | (x.score >= k.least)))
        return F.when(F.size(f"{k.name}.m") > 0, made)

    df = df.select("*", *[spans(k).alias(f"found_{k.name}") for k in kinds])
    none = F.expr("array()").cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return df.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], F.concat(*[F.coalesce(f"found_{k.name}", none) for k in kinds]).alias("found"))


def steps(kind: str) -> Column:
    """From the end of the match before to the end of each match."""
    return F.transform(f"{kind}.m", lambda m, i: F.length(m) + F.length(F.get(f"{kind}.gaps", i)))


def blocks(xs: str) -> Column:
    """The sum of each BLOCK of elements: a prefix sum then adds some blocks of blocks, some blocks and the rest of one."""
    return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.expr(f"cast((size({xs}) - 1) div {BLOCK} as int)")), lambda b: added(F.slice(xs, b * BLOCK + 1, BLOCK))))


def added(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def kind_is(*names: str):
    return lambda x: x.kind.isin(*names)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 over the base spans, spans with all of them, and their scores in the same order."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    df = personal_data(docs)
    return df.select(
        "doc_id",
        *[F.size(F.filter("found", kind_is(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("found", kind_is(*BASE))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda x: F.round(x.score, 2).cast("string")), ",").alias("scores"),
    )
