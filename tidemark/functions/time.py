"""Time buckets as Column expressions, and cron schedules."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets are aligned to 2000-01-01 UTC.
ORIGIN_US = 946_684_800_000_000
UNITS = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6, "month": 30 * 86400 * 10**6, "year": 365 * 86400 * 10**6}


def micros(width: str | int) -> int:
    """Microseconds of "1 hour", "7 days", "1 day 12 hours", ...; a month counts 30 days. A number is seconds."""
    if isinstance(width, int):
        total = width * 10**6
    else:
        found = re.findall(r"(\d+)\s*([a-z]+?)s?\b", width.lower())
        if not found or any(u not in UNITS for _, u in found):
            raise ValueError(f"no such interval: {width}")
        total = sum(int(n) * UNITS[u] for n, u in found)
    if total <= 0:
        raise ValueError("a bucket's width must be positive")
    return total


def unix_micros(ts: Column) -> Column:
    """Of a timestamp with or without time zone, the latter read as UTC in a UTC session."""
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(width: str | int, ts: Column, origin: datetime | None = None, offset: str | None = None) -> Column:
    """The start of ts's bucket, as a timestamp without time zone. Floors on both sides of the origin."""
    w = micros(width)
    start = ORIGIN_US if origin is None else int((origin - datetime(1970, 1, 1)).total_seconds()) * 10**6
    start += micros(offset) if offset else 0
    return F.timestamp_micros((unix_micros(ts) - start) - F.pmod(unix_micros(ts) - start, F.lit(w)) + start).cast("timestamp_ntz")


def int_bucket(width: int, value: Column) -> Column:
    if width <= 0:
        raise ValueError("a bucket's width must be positive")
    return value - F.pmod(value, F.lit(width))


def chunk_range(width: str | int, ts: Column) -> Column:
    """(start, end) of the chunk that holds ts, the end excluded."""
    start = time_bucket(width, ts)
    return F.struct(start.alias("start"), F.timestamp_micros(unix_micros(start) + micros(width)).cast("timestamp_ntz").alias("end"))


def gapfill(df: DataFrame, bucket: str, width: str, start: datetime, end: datetime, by: list[str]) -> DataFrame:
    """df, a row for each key and bucket, with rows of nulls for the buckets from start on, before end, that a key lacks. Rows outside go."""
    w = micros(width)
    at = F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end - timedelta(microseconds=1)).cast("timestamp_ntz"), F.expr(f"INTERVAL {w / 10**6:f} SECOND")))
    every = df.select(*by).distinct().select(*by, at.alias(bucket)) if by else df.sparkSession.range(1).select(at.alias(bucket))
    return every.join(df, [*by, bucket], "left").select(*df.columns)


def locf(df: DataFrame, columns: list[str], order: str, by: list[str]) -> DataFrame:
    """Nulls replaced by the last value before them in their key."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def interpolate(df: DataFrame, columns: list[str], order: str, by: list[str]) -> DataFrame:
    """Nulls between two values of their key replaced by the straight line between these; others stay."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    at = unix_micros(F.col(order)) if df.schema[order].dataType.typeName().startswith("timestamp") else F.col(order)
    out = {}
    for c in columns:
        point = F.when(F.col(c).isNotNull(), F.struct(at.alias("t"), F.col(c).cast("double").alias("v")))
        lo, hi = F.last(point, ignorenulls=True).over(before), F.first(point, ignorenulls=True).over(after)
        out[c] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).otherwise(lo.v + (hi.v - lo.v) * (at - lo.t) / (hi.t - lo.t))
    return df.withColumns(out)


def first(value: Column, order: Column) -> Column:
    """The value where order is least."""
    return F.min_by(value, order)


def last(value: Column, order: Column) -> Column:
    return F.max_by(value, order)


def histogram(value: Column, low: float, high: float, n: int) -> Column:
    """An array of counts: below low, n equal parts from low on, and high and above."""
    i = F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(n))
    return F.array(*[F.count(F.when(i == k, 1)) for k in range(n + 2)])


def _field(text: str, low: int, high: int) -> set[int]:
    """The values of a cron field: *, */n, a, a-b, a-b/n and lists of them."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        else:
            first, _, last = span.partition("-")
            a = int(first)
            b = int(last) if last else (high if step else a)
        if not low <= a <= b <= high:
            raise ValueError(f"{part} lies outside {low} to {high}")
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def next_cron(schedule: str, after: datetime) -> datetime:
    """The first minute after a time that five cron fields allow. If both day fields are restricted, either is enough."""
    fields = schedule.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    minutes, hours, days, months = (_field(f, *r) for f, r in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12))))
    weekdays = {d % 7 for d in _field(fields[4], 0, 7)}
    t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    last = t + timedelta(days=366 * 8)
    while t < last:
        by_day, by_week = t.day in days, (t.isoweekday() % 7) in weekdays
        day = (by_day or by_week) if fields[2] != "*" and fields[4] != "*" else (by_day and by_week)
        if t.month not in months or not day:
            t = (t + timedelta(days=1)).replace(hour=0, minute=0)
        elif t.hour not in hours:
            t = (t + timedelta(hours=1)).replace(minute=0)
        elif t.minute not in minutes:
            t += timedelta(minutes=1)
        else:
            return t
    raise ValueError(f"{schedule} never comes")
