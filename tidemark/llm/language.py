"""Language identification by segmentation-marginalised unigrams.

Over the pieces of a fixed public vocabulary each language has its own probabilities. A word's probability is the sum over all
its segmentations, by the forward algorithm; a text's is the product over its words, and the score is the best language's
share under equal priors. Training is expectation maximisation by forward and backward sums over the words of a sample.

The sample is drawn by the hash of id and text, `per_lang` texts expected of each of the `most_langs` most frequent languages, equal texts
once and at most twice as many in all, only from rows with a lang that `held_out` leaves. Of their words those of at most LONGEST letters train. That is
the fitting bound; it is counted over all documents. Every whole text is scored, by every word of it.

Pieces of all words of a batch are found in one pass of an Aho-Corasick automaton; the sums run over all words at once, one
step for each end position. Words of more than LONGEST letters, whose probabilities floats can't hold, are summed as logarithms, and
those of more than STREAMED one position after another, in memory that doesn't grow. Each worker keeps the vectors of shorter words it has met.

Defined results: a null text or one without a letter is `und` with score 0. Without anything to learn from, every text is
`und`. Equal scores go to the language that sorts first. An empty table gives an empty one. Ids may be null or repeated; a null id counts as
held out. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out

WORD = re.compile(r"[^\W\d_]+")
START, BETWEEN = "▁", "\n"
#: Letters of a word up to which no sum underflows; letters of words that are summed side by side, and of one that isn't.
LONGEST, TOGETHER, STREAMED = 32, 100_000, 20_000
UNKNOWN, ROUNDS, PER_LANG, MOST_LANGS, CACHED = 1e-7, 4, 500, 200, 500_000
UND = "und"


class Model(NamedTuple):
    langs: list[str]
    pieces: list[str]
    probs: np.ndarray  # (pieces, langs)


def vocabulary(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p.lower() for p in every if (p.replace(START, "", 1).isalpha() or p == START)})


def automaton(pieces: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        found.add_word(p, (i, len(p)))
    found.make_automaton()
    return found


class Lattice:
    """All pieces of a list of words, by the position they end at."""

    def __init__(self, machine: ahocorasick.Automaton, words: list[str]):
        marked = [START + w for w in words]
        self.sizes = np.array([len(w) for w in marked], np.int64)
        first = np.cumsum(self.sizes + 1) - self.sizes - 1
        hits = [(e, i, n) for e, (i, n) in machine.iter(BETWEEN.join(marked))]
        end, self.piece, size = np.array(hits, np.int64).reshape(-1, 3).T
        self.word = np.searchsorted(first, end, "right") - 1
        self.end = end - first[self.word] + 1
        self.start = self.end - size
        order = np.lexsort((self.word, self.end))
        self.word, self.end, self.start, self.piece = (x[order] for x in (self.word, self.end, self.start, self.piece))
        self.longest = int(self.sizes.max(initial=0))
        self.cuts = np.searchsorted(self.end, np.arange(self.longest + 2))

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """(words, positions, langs): the sum over segmentations of what stands before each position."""
        a = np.zeros((len(self.sizes), self.longest + 1, probs.shape[1]))
        a[:, 0] = 1
        for e in range(1, self.longest + 1):
            a[:, e] = a[:, e - 1] * UNKNOWN
            s = slice(self.cuts[e], self.cuts[e + 1])
            if s.start < s.stop:
                w = self.word[s]
                at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                a[w[at], e] += np.add.reduceat(a[w, self.start[s]] * probs[self.piece[s]], at)
        return a

    def totals(self, probs: np.ndarray) -> np.ndarray:
        """(words, langs): log probabilities."""
        return np.log(self.forward(probs)[np.arange(len(self.sizes)), self.sizes])

    def log_totals(self, probs: np.ndarray) -> np.ndarray:
        """totals for words of any length: the same sums, of logarithms."""
        logs, out = np.log(probs), np.full((len(self.sizes), self.longest + 1, probs.shape[1]), -np.inf)
        out[:, 0] = 0
        for e in range(1, self.longest + 1):
            now = out[:, e - 1] + np.log(UNKNOWN)
            s = slice(self.cuts[e], self.cuts[e + 1])
            if s.start < s.stop:
                w = self.word[s]
                at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                x, own = out[w, self.start[s]] + logs[self.piece[s]], now[w[at]]
                top = np.maximum(np.maximum.reduceat(x, at), own)
                rest = np.exp(x - np.repeat(top, np.diff(np.r_[at, len(w)]), 0))
                now[w[at]] = top + np.log(np.add.reduceat(rest, at) + np.exp(own - top))
            out[:, e] = now
        return out[np.arange(len(self.sizes)), self.sizes]

    def expected(self, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected, words weighed by counts, for one language."""
        a = self.forward(probs[:, None])[:, :, 0]
        z = a[np.arange(len(self.sizes)), self.sizes]
        b = np.zeros_like(a)
        b[np.arange(len(self.sizes)), self.sizes] = 1
        out = np.zeros(len(probs))
        for e in range(self.longest, 0, -1):
            s = slice(self.cuts[e], self.cuts[e + 1])
            w, p, at = self.word[s], self.piece[s], self.start[s]
            through = probs[p] * b[w, e]
            np.add.at(out, p, counts[w] * a[w, at] * through / z[w])
            np.add.at(b, (w, at), through)
            b[:, e - 1] += b[:, e] * UNKNOWN
        return out


def streamed(machine: ahocorasick.Automaton, word: str, probs: np.ndarray, longest: int) -> np.ndarray:
    """log_totals of one word, with the last positions alone in memory; longest: of the pieces."""
    logs, unknown = np.log(probs), np.log(UNKNOWN)
    last = np.zeros((longest + 1, probs.shape[1]))
    done = 0

    def go_on(to: int) -> None:
        nonlocal done
        while done < to:
            done += 1
            last[done % len(last)] = last[(done - 1) % len(last)] + unknown

    for end, hits in groupby(machine.iter(START + word), key=lambda x: x[0]):
        go_on(end + 1)
        each = [last[done % len(last)], *(last[(done - n) % len(last)] + logs[i] for _, (i, n) in hits)]
        last[done % len(last)] = np.logaddexp.reduce(each)
    go_on(len(word) + 1)
    return last[done % len(last)].copy()


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_totals(machine: ahocorasick.Automaton, words: list[str], probs: np.ndarray, longest: int) -> np.ndarray:
    """(words, langs): log probabilities of words of any length."""
    out = np.zeros((len(words), probs.shape[1]))
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    short = int(np.searchsorted(size[order], LONGEST, "right"))
    for i in range(0, short, 20_000):
        some = order[i : min(short, i + 20_000)]
        out[some] = Lattice(machine, [words[k] for k in some]).totals(probs)
    at = short
    while at < len(words):
        if size[order[at]] > STREAMED:
            out[order[at]] = streamed(machine, words[order[at]], probs, longest)
            at += 1
            continue
        to = at + 1
        while to < len(words) and size[order[to]] <= STREAMED and size[order[to]] * (to + 1 - at) <= TOGETHER:
            to += 1
        out[order[at:to]] = Lattice(machine, [words[k] for k in order[at:to]]).log_totals(probs)
        at = to
    return out


def fit(texts: list[str | None], langs: list[str], pieces: list[str], rounds: int = ROUNDS) -> Model | None:
    counts: dict[str, Counter] = {}
    for t, l in zip(texts, langs):
        counts.setdefault(l, Counter()).update(w for w in words_of(t) if w.isalpha() and len(w) <= LONGEST)
    names = sorted(l for l, c in counts.items() if c)
    if not names:
        return None
    machine, columns = automaton(pieces), []
    for l in names:
        words = list(counts[l])
        n = np.array([counts[l][w] for w in words], float)
        p = np.full(len(pieces), 1 / len(pieces))
        lattices = [(Lattice(machine, words[i : i + 20_000]), n[i : i + 20_000]) for i in range(0, len(words), 20_000)]
        for _ in range(rounds):
            e = sum(x.expected(p, m) for x, m in lattices) + 0.01
            p = e / e.sum()
        columns.append(p)
    return Model(names, pieces, np.stack(columns, 1))


def sample(docs: DataFrame, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> pd.DataFrame:
    df = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = df.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most_langs)
    drawn = F.pmod(F.xxhash64("id", "t"), F.lit(1 << 40)) * F.col("n") < F.lit(float(1 << 40)) * per_lang
    drawn = df.join(F.broadcast(counts), "l").where(drawn).select("l", "t").distinct()
    return drawn.orderBy(F.xxhash64("t"), "l").limit(2 * per_lang * most_langs).toPandas()


def predicted(docs: DataFrame, model: Model | None, text: str = "text"):
    """A column (lang, score) for each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        machine, longest = (automaton(m.pieces), max(map(len, m.pieces))) if m else (None, 0)
        known: dict[str, int] = {}
        table = np.zeros((0, len(m.langs) if m else 0))
        for x in batches:
            out = []
            for at in range(0, len(x), 200):
                split = [words_of(t) for t in x.iloc[at : at + 200]]
                if len(known) > CACHED:
                    known, table = {}, table[:0]
                new = sorted((w for w in set().union(*split).difference(known) if m and any(map(str.isalpha, w))), key=len)
                known |= {w: len(table) + k for k, w in enumerate(new)}
                if new:
                    table = np.concatenate([table, word_totals(machine, new, m.probs, longest)])
                for words in split:
                    ids = [known[w] for w in words if w in known]
                    if not ids:
                        out.append((UND, 0.0))
                        continue
                    s = table[ids].sum(0)
                    p = np.exp(s - s.max())
                    best = int(s.argmax())
                    out.append((m.langs[best], float(p[best] / p.sum())))
                long = [w for w in new if len(w) > LONGEST]  # they come last
                for w in long:
                    del known[w]
                table = table[: len(table) - len(long)]
            yield pd.DataFrame(out, columns=["lang", "score"])

    return run(F.col(text))


def identify(docs: DataFrame, train: DataFrame, path: str, per_lang: int = PER_LANG, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep's columns, lang_pred and score, by a model that is trained on `train` first."""
    drawn = sample(train, per_lang)
    model = fit(drawn["t"].tolist(), drawn["l"].tolist(), vocabulary(path))
    df = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], predicted(docs, model, text).alias("x"))
    return df.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    return identify(docs, docs, path).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
