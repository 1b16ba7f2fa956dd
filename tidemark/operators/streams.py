"""Streams on a log of changes: what has come since an offset, and whether the stream has gone stale."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.changes import stream_rows

#: How long a stream may go unread.
STALE = timedelta(days=14)


@dataclass(order=True, frozen=True)
class Offset:
    """A place in the log: by lsn, then by sequence within it."""

    lsn: int = -1
    sequence: int = -1


def after(offset: Offset) -> Column:
    """Of rows (lsn, sequence): those that the offset hasn't passed. The first comparison is one that Parquet's statistics prune by."""
    return (F.col("lsn") >= offset.lsn) & ((F.col("lsn") > offset.lsn) | (F.col("sequence") > offset.sequence))


@dataclass
class ChangeStream:
    """log: rows (lsn, sequence, event_type, the keys, before, after), read by a function so that new rows are seen."""

    name: str
    log: object
    keys: list[str]
    kind: str = "standard"
    mode: str = "default"
    offset: Offset = Offset()
    read_at: datetime | None = None
    stale_after: timedelta = STALE
    stale: bool = False
    history: list[tuple[datetime, Offset]] = field(default_factory=list)

    def pending(self) -> DataFrame:
        """The rows that the stream shows now. Without an advance they are shown again."""
        return stream_rows(self.log().where(after(self.offset)), self.kind, self.mode, self.keys)

    def has_data(self) -> bool:
        return not self.pending().isEmpty()

    def count(self) -> int:
        return self.pending().count()

    def end(self) -> Offset:
        """The last place of the log."""
        last = self.log().where(after(self.offset)).agg(F.max(F.struct("lsn", "sequence")).alias("x")).first().x
        return Offset(last.lsn, last.sequence) if last else self.offset

    def advance(self, now: datetime, to: Offset | None = None) -> Offset:
        """Marks what has been read; never goes back."""
        to = to or self.end()
        if to < self.offset:
            raise ValueError(f"{to} lies before {self.offset}")
        self.offset, self.read_at = to, now
        self.history.append((now, to))
        return to

    def is_stale(self, now: datetime) -> bool:
        """Marked stale, or not read for stale_after while there is something to read."""
        self.stale = self.stale or (self.read_at is not None and now - self.read_at > self.stale_after and self.has_data())
        return self.stale


@dataclass
class ChangeStreams:
    spark: SparkSession
    known: dict[str, ChangeStream] = field(default_factory=dict)

    def create(self, stream: ChangeStream, now: datetime, show_initial_rows: bool = False) -> ChangeStream:
        """From the end of the log on, or from its beginning."""
        stream.read_at = now
        if not show_initial_rows:
            stream.offset = stream.end()
        self.known[stream.name] = stream
        return stream

    def drop(self, name: str) -> None:
        del self.known[name]

    def status(self, now: datetime) -> list[tuple[str, Offset, bool]]:
        return [(n, s.offset, s.is_stale(now)) for n, s in sorted(self.known.items())]
