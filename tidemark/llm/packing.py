"""Packing by concatenate and cut: all documents' tokens are one long row of tokens, cut every `length` of them.

First pass: each task tokenizes its documents and writes their tokens with its own number and the tokens it wrote before.
The tasks' totals, one number for each task, are summed up on the driver: that gives each document its global offset.
Second pass: each document is cut at the multiples of `length`. Each piece is a boundary record: its document and start
there, its sequence and offset there. Only the last sequence has padding, so that less than one sequence is lost in all.

The tokens are read again as they were written, so that a lost executor can't change an offset. Nothing is shuffled.

Defined results: a null or empty text is the end id alone. Ids may be null or repeated; each row is a document of its own.
An empty table gives no pieces. Whole texts are packed, however long; a text is held whole in memory. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, scratch

LENGTH, END = 2048, 1
#: Distinct parts of texts whose ids a worker keeps, and the longest part that it keeps.
CACHED, LONGEST = 500_000, 64
ENDS = (".", ",")
#: Marks that can join an ASCII letter, which need not do so alike in both cases.
MARKS = r"[\x{300}-\x{36f}]"
#: Bytes of texts that are encoded at once, a longer text alone; new parts that go to the tokenizer at once and in one text; parts whose ids are
#: gathered at once.
BYTES, BATCH, JOINED, GATHERED = 16_000_000, 20_000, 200, 1 << 18


class Encoder:
    """Ids of texts as plain `tokenizers` gives them, with add_special_tokens=False. The vocabulary's pre-tokenizer drops white space
    and no token crosses it, so texts are cut at spaces and line ends, and each different part is encoded once. The vocabulary lower-cases
    all but its added tokens, and what it does besides leaves words of a-z as they are: those go to the bare model."""

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: In such texts the case of ASCII letters is left to the tokenizer; all others are lower-cased before they are cut.
        self.cased = "|".join([MARKS, *(f"(?i:{t})" for t in added)])
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.cached = cached
        self.known: dict[str, int] = {}  # which stretch of ids a part has
        self.passing: dict[str, int] = {}  # the same for parts that aren't kept
        self.start, self.size, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint16)
        self.add(["", *ENDS], self.known)

    def listed(self, parts: list[str], size: np.ndarray, ids: np.ndarray, into: dict[str, int]) -> None:
        into.update(zip(parts, range(len(self.size), len(self.size) + len(parts))))
        self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])

    def add(self, parts: list[str], into: dict[str, int]) -> None:
        """Parts of letters alone are one pre-token each, and the last id of a pre-token says so: many are encoded as one text."""
        plain, letters, other = [], [], []
        for p in parts:
            (other if not p.isalpha() else plain if p.isascii() and p.islower() else letters).append(p)
        for tokenizer, words in ((self.model, plain), (self.tokenizer, letters)):
            for i in range(0, len(words), BATCH):
                some = words[i : i + BATCH]
                joined = tokenizer.encode_batch_fast([" ".join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)], add_special_tokens=False)
                ids = np.concatenate([np.array(e.ids, np.uint16) for e in joined])
                upto = np.flatnonzero(self.ends[ids]) + 1
                if len(upto) == len(some):
                    self.listed(some, np.diff(upto, prepend=0).astype(np.int32), ids, into)
                else:  # letters to Python and not to the pre-tokenizer
                    other += some
        for i in range(0, len(other), BATCH):
            some = other[i : i + BATCH]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int32, len(found))
            self.listed(some, size, np.fromiter(chain.from_iterable(found), np.uint16, int(size.sum())), into)

    def stretch(self, slots: np.ndarray) -> np.ndarray:
        """The ids of slots one after another."""
        out = []
        for i in range(0, len(slots), GATHERED):
            n = self.size[some := slots[i : i + GATHERED]]
            upto = np.cumsum(n, dtype=np.int32)
            out.append(self.ids[np.arange(upto[-1], dtype=np.int32) + np.repeat(self.start[some] - (upto - n), n)])
        return np.concatenate(out) if out else np.zeros(0, np.uint16)

    def learn(self, parts: list[str], into: dict[str, int]) -> None:
        """Lists the ids of parts that aren't known. Letters and one stop or comma are two pre-tokens: only the letters are encoded."""
        ended = [p for p in parts if p[-1:] in ENDS and p[:-1].isalpha()]
        words = set(parts).difference(ended)
        words.update(p[:-1] for p in ended)
        self.add(sorted(words.difference(self.known)), into)
        known, here = self.known, into
        both = np.array([(known[w] if (w := p[:-1]) in known else here[w], known[p[-1]]) for p in ended], np.int32).ravel()
        self.listed(ended, self.size[both].reshape(-1, 2).sum(1, dtype=np.int32), self.stretch(both), into)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and how many each text has."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        low = pc.ascii_lower(texts)
        cased = pc.match_substring_regex(low, self.cased)
        split = pc.split_pattern(pc.if_else(cased, texts, low) if pc.any(cased).as_py() else low, " ")
        of_text, coded = np.diff(split.offsets.to_numpy()), split.flatten().dictionary_encode()
        del split, low
        parts, at, before = coded.dictionary.to_pylist(), coded.indices.to_numpy(), (len(self.size), len(self.ids))
        full = len(self.known) > self.cached
        slots = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int32, len(parts))
        lacking = np.flatnonzero(slots < 0)
        new = [parts[k] for k in lacking.tolist()]
        del parts
        # frequent parts are met early: once there are enough, what is new is let go
        if not full:
            self.learn([p for p in new if len(p) <= LONGEST], self.known)
            before = (len(self.size), len(self.ids))
        self.learn([p for p in new if p not in self.known], self.passing)
        slots[lacking] = [self.known[p] if p in self.known else self.passing[p] for p in new]
        del new
        slots = slots[at]
        ids, upto = self.stretch(slots), np.r_[0, np.cumsum(self.size[slots], dtype=np.int64)]
        n = np.diff(upto[np.r_[0, np.cumsum(of_text, dtype=np.int64)]])
        self.passing.clear()
        self.start, self.size, self.ids = self.start[: before[0]], self.size[: before[0]], self.ids[: before[1]]
        return ids, n


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cached: int) -> Encoder:
    """One for each worker process."""
    if (path, cached) not in _encoders:
        _encoders[path, cached] = Encoder(path, cached)
    return _encoders[path, cached]


def stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows whose sizes add up to at most `most`, or one row."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def tokenized(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END, at_once: int = BYTES, cached: int = CACHED) -> DataFrame:
    """(id, task, before, n, ids), stored: ids end with the end id; before: tokens that the task wrote before. at_once and cached trade memory for
    time, and change nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, done = TaskContext.get().partitionId(), 0
        for x in fresh(batches):
            for a, b in stretches(pc.fill_null(pc.binary_length(x["t"]), 0).to_numpy(), at_once):
                ids, n = encoder(path, cached).encode(x["t"].slice(a, b - a))
                ids, n = np.insert(ids, np.cumsum(n), end).astype("<u2"), n + 1
                upto = np.cumsum(n)
                body = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * np.r_[0, upto]).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([x["id"].slice(a, b - a), pa.array(np.full(len(n), task, np.int32)), pa.array(done + upto - n), pa.array(n), body], ["id", "task", "before", "n", "ids"])
                done += int(upto[-1])
                del ids, n, upto, body
                pa.default_memory_pool().release_unused()

    # ids travel as text: pandas, which reads them later, would turn numbers with nulls into floats
    df = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "id string, task int, before bigint, n bigint, ids binary")
    df.write.option("compression", "zstd").parquet(at := scratch(docs.sparkSession, "tokens"))
    return docs.sparkSession.read.parquet(at)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text", ids: bool = False, at_once: int = BYTES, cached: int = CACHED) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    tokens = tokenized(docs, path, doc_id, text, end, at_once, cached)
    totals = tokens.groupBy("task").agg(F.max(F.col("before") + F.col("n")).alias("n")).orderBy("task").collect()  # one number for each task
    base = np.zeros(max((r.task for r in totals), default=0) + 1, np.int64)
    at = 0
    for r in totals:
        base[r.task] = at
        at += r.n

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in fresh(parts):
            for i in range(0, len(x), 500):
                y = x.iloc[i : i + 500]
                n, first = y["n"].to_numpy(), base[y["task"].to_numpy()] + y["before"].to_numpy()
                pieces = (first + n - 1) // length - first // length + 1
                row = np.repeat(np.arange(len(y)), pieces)
                k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = first[row] // length + k
                a = np.maximum(sequence * length, first[row])
                b = np.minimum((sequence + 1) * length, first[row] + n[row])
                start = a - first[row]
                wide = [np.frombuffer(e, "<u2").astype("<u4") for e in y["ids"]]
                cut = [wide[r][s : s + m] for r, s, m in zip(row, start, b - a)]
                out = {"id": y["id"].to_numpy()[row], "start": start, "length": b - a, "ids_crc32": [zlib.crc32(c.tobytes()) for c in cut], "doc_tokens": n[row], "sequence_id": sequence, "offset": a - sequence * length}
                yield pd.DataFrame(out | ({"ids": cut} if ids else {}))

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = "id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * ids
    return tokens.mapInPandas(run, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", doc_id)
