"""Secret scans with a decoding worklist: nested URL, Unicode, base64 and compressed layers are unwrapped until nothing new
comes, each layer is scanned again, and what is found there is mapped back to the span of the text that carries it.

A layer text is opened once for each text, so that cycles end; what it holds is mapped to every place that carries it. Compressed
data that inflates to compressed data is followed until it doesn't or comes back to what it was. An inflated layer of more than
`max_layer` bytes, and any that comes after a text's layers have inflated to `max_total` together, isn't opened: it is reported as a
span of kind `oversize`, so that memory and time are bounded and nothing passes unseen.

Kinds: assign, access and hex in the text itself; decoded_assign, decoded_access, decoded_hex and oversize by the method.
Defined results: null and empty texts have no spans, an empty table gives an empty one. Spans that tie in start are in the order of
kinds, then by end. One row out for each row in, null or repeated ids carried through; other columns are ignored, whatever their
names, unless they are named in keep. Whole texts are scanned, however long.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: One of these stands in any text that ASSIGN matches, once lower-cased.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ESCAPED = re.compile(r"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
TOKEN = re.compile(r"\S+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 characters that go on from line to line.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:\r\n|\n|\r)[A-Za-z0-9+/_-]++)+")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
KINDS = ("assign", "access", "hex", "decoded_assign", "decoded_access", "decoded_hex", "oversize")
BASE = KINDS[:3]
MAX_LAYER, MAX_TOTAL = 1 << 24, 1 << 26
#: First bytes of compressed data.
MAGIC = {b"\x1f\x8b": "zlib", b"\x78\x01": "zlib", b"\x78\x5e": "zlib", b"\x78\x9c": "zlib", b"\x78\xda": "zlib", b"BZh": "bz2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}


class Oversize(Exception):
    pass


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base kinds in one layer."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def stream(raw: bytes, how: str, most: int) -> tuple[bytes, bytes]:
    """What the first stream of raw holds, up to most bytes or little more, and what follows it."""
    if how == "zstd":
        out, d = bytearray(), zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
        for at in range(0, len(raw), 256):  # a block of 4 bytes may hold 128 KB
            out += d.decompress(raw[at : at + 256])
            if d.eof:
                return bytes(out), d.unused_data + raw[at + 256 :]
            if len(out) >= most:
                break
        return bytes(out), b""
    d = zlib.decompressobj(47) if how == "zlib" else bz2.BZ2Decompressor() if how == "bz2" else lzma.LZMADecompressor()
    return d.decompress(raw, most), d.unused_data


def inflated(raw: bytes, most: int) -> bytes | None:
    """What compressed data holds, in all of its streams; None if it isn't any. Padding between streams is skipped, and
    what follows the last one ignored."""
    out = None
    while how := next((v for k, v in MAGIC.items() if raw.startswith(k)), None):
        try:
            more, raw = stream(raw, how, most + 1 - len(out or b""))
        except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError):
            break
        out = (out or b"") + more
        if len(out) > most:
            raise Oversize
        raw = raw.lstrip(b"\0")
    return out


class Room:
    """How much a text's layers may still inflate to."""

    def __init__(self, layer: int, total: int):
        self.layer, self.total = layer, total
        self.known: dict[bytes, bytes | None] = {}

    def inflated(self, raw: bytes) -> bytes | None:
        if not raw.startswith(tuple(MAGIC)):
            return None
        if raw not in self.known:
            most = min(self.layer, self.total)
            try:
                self.known[raw] = out = inflated(raw, most)
            except Oversize:
                self.total -= most
                raise
            self.total -= len(out or b"")
        return self.known[raw]


class Layer:
    """A text, and for each of its code points the start and end in the text that carries it: arrays, one number for all of them, or None
    for the original itself."""

    def __init__(self, text: str, lo: np.ndarray | int | None = None, hi: np.ndarray | int | None = None):
        self.text, self.lo, self.hi = text, lo, hi

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.lo is None or isinstance(self.lo, int):
            return (a, b) if self.lo is None else (self.lo, self.hi)
        return int(self.lo[a:b].min()), int(self.hi[a:b].max())

    def below(self, raw: bytes, lo: np.ndarray, hi: np.ndarray, sure: bool, room: Room) -> Layer | None:
        """The layer of bytes whose places are known; compressed bytes all stand for the whole of their carrier."""
        seen = set()
        while (more := room.inflated(raw)) is not None:
            if more in seen:
                return None  # what it inflates to has been opened: it holds nothing but itself
            seen.add(more)
            raw, sure = more, True
            lo, hi = int(np.min(lo)) if np.size(lo) else 0, int(np.max(hi)) if np.size(hi) else 0
        try:
            text = raw.decode()
            if not isinstance(lo, int):
                first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                last = np.r_[first[1:], len(raw)] - 1 if len(raw) else first
                lo, hi = lo[first], hi[last]
        except UnicodeDecodeError:
            if not sure:
                return None
            text = raw.decode("latin-1")
        if not sure and not all(c.isprintable() or c in "\t\r\n" for c in text):
            return None
        return Layer(text, lo, hi) if text else None

    def unescaped(self, a: int, b: int, room: Room) -> Layer | None:
        raw, at, to, pos = bytearray(), [], [], a
        part = self.text[a:b]
        for m in [*ESCAPED.finditer(part), None]:
            for i in range(pos, a + m.start() if m else b):
                c = self.text[i].encode("utf-8", "surrogatepass")
                raw += c
                at += [i] * len(c)
                to += [i + 1] * len(c)
            if m:
                c = chr(int(m[2], 16)).encode("utf-8", "surrogatepass") if m[2] else bytes([int(m[1] or m[3], 16)])
                raw += c
                at += [a + m.start()] * len(c)
                to += [a + m.end()] * len(c)
                pos = a + m.end()
        return self.below(bytes(raw), np.array(at), np.array(to), True, room)

    def unbased(self, a: int, b: int, room: Room) -> Layer | None:
        """Base64 from a to b, over line breaks."""
        at = np.array([i for i in range(a, b) if self.text[i] not in "\r\n"])
        body = "".join(self.text[a:b].split()).rstrip("=")
        if len(body) % 4 == 1:
            return None
        raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
        i = np.arange(len(raw))
        return self.below(raw, at[i * 4 // 3], at[np.minimum((i * 4 + 4) // 3, len(at) - 1)] + 1, False, room)


def wrapped(text: str) -> set[tuple[int, int]]:
    """Stretches of base64 lines to join: runs of them with and without the last line, which may be a word of prose, and in
    each run every block of lines of one length, with and without a shorter line at the end."""
    out = set()
    for run in WRAPPED.finditer(text) if "\n" in text or "\r" in text else ():
        lines = [m.span() for m in LINE.finditer(text, *run.span())]
        blocks, first = {(0, len(lines)), (0, len(lines) - 1)}, 0
        length = [b - a for a, b in lines]
        for i in range(1, len(lines) + 1):
            if i == len(lines) or length[i] != length[first]:
                blocks.add((first, i))
                if i < len(lines) and length[i] < length[first]:
                    blocks.add((first, i + 1))
                first = i
        for i, j in blocks:
            if j - i > 1 and sum(length[i:j]) >= 16:
                a, b = lines[i][0], lines[j - 1][1]
                out.add((a, b + next(k for k in (2, 1, 0) if text.startswith("=" * k, b))))
    return out


def spans(text: str | None, max_layer: int = MAX_LAYER, max_total: int = MAX_TOTAL) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed. Each different layer text is opened once; what is found in it goes to
    every place that carries it, and from there on to the carriers of that text, until nothing is added."""
    if not text:
        return []
    found: dict[str, set[tuple[str, int, int]]] = {}
    carriers: dict[str, list[tuple[str, Layer]]] = {text: []}
    work, news, room = [text], [], Room(max_layer, max_total)

    def add(where: str, what: tuple[str, int, int]) -> None:
        if what not in (here := found.setdefault(where, set())):
            here.add(what)
            news.append((where, what))

    while work:
        at = work.pop()
        layer = Layer(at)
        for x in scan(at):
            add(at, x)
        todo: list[tuple[Callable, int, int]] = []
        if "%" in at or "\\" in at:
            todo += [(layer.unescaped, *m.span()) for m in TOKEN.finditer(at) if ESCAPED.search(m[0])]
        todo += [(layer.unbased, a, b) for a, b in sorted({m.span() for m in BASE64.finditer(at)} | wrapped(at))]
        for how, a, b in todo:
            try:
                below = how(a, b, room)
            except Oversize:
                add(at, ("oversize", a, b))
                continue
            if below:
                if below.text not in carriers:
                    carriers[below.text] = []
                    work.append(below.text)
                carriers[below.text].append((at, below))
    while news:
        at, (kind, a, b) = news.pop()
        for above, layer in carriers[at]:
            add(above, (f"decoded_{kind}" if kind in BASE else kind, *layer.span(a, b)))
    return sorted(found.get(text, ()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str | None, found: list[tuple[str, int, int]], instead: str = "[SECRET]") -> str | None:
    """text with every stretch that spans cover replaced."""
    if not found or text is None:
        return text
    out, pos = [], 0
    for _, a, b in found:
        if a >= pos:
            out += [text[pos:a], instead]
        pos = max(pos, b)
    return "".join(out) + text[pos:]


def secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_layer: int = MAX_LAYER, redact: bool = False) -> DataFrame:
    """keep's columns and found, an array of (kind, start, end) in code points, the end excluded; with redact, also
    `redacted`, the text without what was found."""
    names = [f"k_{i}" for i in range(len(keep))]

    @F.pandas_udf("found array<struct<kind:string,start:bigint,end:bigint>>" + ", redacted string" * redact)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in fresh(parts):
            found = [spans(t, max_layer) for t in x]
            out = pd.DataFrame({"found": [[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found]})
            if redact:
                out["redacted"] = [redacted(t, f) for t, f in zip(x, found)]
            yield out

    df = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], run(F.col(text)).alias("x"))
    return df.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "x.found", *["x.redacted"] * redact)


def clean(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with every secret in the texts replaced, and n_chars, where there is such a column, counted anew."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in fresh(parts):
            yield pd.Series([redacted(t, spans(t)) for t in x], dtype="object")

    df = docs.withColumn(text, run(F.col(text)))
    return df.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else df


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def counted(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")


def digest(docs: DataFrame) -> DataFrame:
    base = F.filter("found", lambda x: x.kind.isin(*BASE))
    return secrets(docs).select("doc_id", *map(counted, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
