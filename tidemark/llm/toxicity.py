"""Toxicity by a convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling.

Words are hashed to 32 bits and never listed as words; of the 2^32 rows only those of hashes that LEAST_TEXTS training texts have are
kept, the others share one untrained row. Each width has its own
filters, a filter's feature is its largest response anywhere in the text, and a logistic layer weighs the features. As a
response is a sum of one product for each word of the filter, the products are tabulated once for each row, and scoring adds
up table rows. Whole texts are scored, in stretches that overlap by the widest filter.

Training takes at most `per_class` ids of each label, those with the smallest hashes, and only of rows that `held_out` leaves; where ids
are repeated in the documents, at most `most` texts in the order of id and text. That is the fitting bound. An id that is labelled both ways trains nothing,
so that the model doesn't depend on the order of rows. A fifth of them sets, for each language, the logit that becomes score 0.5; the language is guessed from
function words of the text itself. Languages with few such texts share one threshold.

Defined results: null, empty and wordless texts are scored as texts of one untrained word. Without any labelled texts of
either class every score is 0. Filters whose largest response ties take its first place. Whole texts are scored, however long; an empty table
gives an empty one. One row out for each row in, whatever its id; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, held_out

WORD = re.compile(r"[^\W_]+")
WIDTHS, FILTERS, DIM, EPOCHS, BATCH = (1, 2, 3), 12, 8, 6, 32
PER_CLASS, MOST_TEXTS, LEAST_TEXTS, STRETCH, CACHED = 1500, 6000, 3, 100_000, 100_000
#: Function words by which a text's language is guessed for its threshold.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with as be on by at this from are".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine".split(),
    "fr": "le la les de des du et en un une que qui est pour dans par sur au pas".split(),
    "es": "el la los las de y en que del se con por una un su para es al lo".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "und")
_SPOKEN = {w: [i for i, l in enumerate(FUNCTION_WORDS) if w in FUNCTION_WORDS[l]] for l in FUNCTION_WORDS for w in FUNCTION_WORDS[l]}


class Model(NamedTuple):
    rows: dict[int, int]  # of each word hash; 0 is the untrained row
    tables: dict[int, np.ndarray]  # by width: (rows, width, filters)
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    thresholds: np.ndarray  # by language
    scale: float


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def language(words: list[str]) -> int:
    votes = [0.0] * len(FUNCTION_WORDS)
    for w, n in Counter(words).items():
        for i in _SPOKEN.get(w, ()):
            votes[i] += n / len(_SPOKEN[w])
    return int(np.argmax(votes)) if max(votes) else len(votes)


def hashed(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def responses(tables: dict[int, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """The largest response of each filter, the widths one after another. Both ends are padded with the untrained row."""
    ids = np.r_[np.zeros(max(tables) - 1, np.int64), ids, np.zeros(max(tables) - 1, np.int64)]
    best = None
    for at in range(0, len(ids), STRETCH):
        part = ids[at : at + STRETCH + max(tables) - 1]
        if len(part) < max(tables):
            break
        now = []
        for w, t in tables.items():
            r = t[part[: len(part) - w + 1], 0]
            for o in range(1, w):
                r = r + t[part[o : len(part) - w + 1 + o], o]
            now.append(r.max(0))
        now = np.concatenate(now)
        best = now if best is None else np.maximum(best, now)
    return best


def logit(model: Model, ids: np.ndarray) -> float:
    return float(np.maximum(responses(model.tables, ids) + model.bias, 0) @ model.weights + model.intercept)


def fit(texts: list[str | None], labels: np.ndarray, folds: np.ndarray, seed: int = 7) -> Model | None:
    """folds: 0 where a text sets thresholds, else it trains."""
    train = folds > 0
    if len(set(labels[train])) < 2:
        return None
    rng = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    docs: list[Counter] = [Counter(), Counter()]
    for w, y, t in zip(split, labels, train):
        if t:
            docs[y].update({hashed(x) for x in set(w)})
    total = docs[0] + docs[1]
    kept = sorted(h for h, n in total.items() if n >= LEAST_TEXTS)
    rows = {h: i + 1 for i, h in enumerate(kept)}
    # the first dimension starts from how much more often toxic texts have the word, shrunk for rare words
    size = [max(1, int((labels[train] == y).sum())) for y in (0, 1)]
    odds = np.array([np.log((docs[1][h] + 0.5) / (size[1] + 1)) - np.log((docs[0][h] + 0.5) / (size[0] + 1)) for h in kept])
    e = np.zeros((len(kept) + 1, DIM))
    e[1:] = rng.normal(0, 0.1, (len(kept), DIM))
    e[1:, 0] = odds * np.array([total[h] / (total[h] + 5) for h in kept]) if kept else 0
    f = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS}
    for w in WIDTHS:
        f[w][:, 0] = np.abs(f[w][:, 0]) + 0.3 / w
    n = FILTERS * len(WIDTHS)
    par = {"bias": np.zeros(n), "weights": rng.normal(0.1, 0.1, n), "intercept": np.zeros(1), **{f"f{w}": f[w] for w in WIDTHS}}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in par.items()}
    ids = [np.array([rows.get(hashed(x), 0) for x in w], np.int64) for w in split]
    order, step = np.flatnonzero(train), 0
    share = np.array([len(order) / 2 / size[y] for y in (0, 1)])
    pad = np.zeros(max(WIDTHS) - 1, np.int64)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for b in range(0, len(order), BATCH):
            batch, step = order[b : b + BATCH], step + 1
            grads, moved = {k: np.zeros_like(v) for k, v in par.items()}, []
            for d in batch:
                x = np.r_[pad, ids[d], pad]
                v, where = e[x], []
                feature = np.empty(n)
                for j, w in enumerate(WIDTHS):
                    m = len(x) - w + 1
                    r = sum(v[o : o + m] @ par[f"f{w}"][o] for o in range(w))
                    where.append(r.argmax(0))
                    feature[j * FILTERS : (j + 1) * FILTERS] = r[where[-1], np.arange(FILTERS)]
                a = np.maximum(feature + par["bias"], 0)
                p = 1 / (1 + np.exp(-np.clip(a @ par["weights"] + par["intercept"][0], -30, 30)))
                g = (p - labels[d]) * share[labels[d]] / len(batch)
                grads["weights"] += g * a
                grads["intercept"] += g
                da = g * par["weights"] * (a > 0)
                grads["bias"] += da
                for j, w in enumerate(WIDTHS):
                    part = da[j * FILTERS : (j + 1) * FILTERS]
                    for o in range(w):
                        at = x[where[j] + o]
                        grads[f"f{w}"][o] += e[at].T * part
                        moved.append((at, part[:, None] * par[f"f{w}"][o].T))
            for k, gr in grads.items():
                m, s = moments[k]
                m += 0.1 * (gr + 1e-4 * par[k] - m)
                s += 0.01 * (gr**2 - s)
                par[k] -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            at, by = np.concatenate([m[0] for m in moved]), np.concatenate([m[1] for m in moved])
            np.subtract.at(e, at, 0.5 * by)
            e[0] = 0
    tables = {w: np.einsum("rd,wdf->rwf", e, par[f"f{w}"]).astype(np.float32) for w in WIDTHS}
    model = Model(rows, tables, par["bias"], par["weights"], float(par["intercept"][0]), np.zeros(len(LANGUAGES)), 1.0)
    z = np.array([logit(model, x) for x in ids])
    held = ~train if len(set(labels[~train])) == 2 else train
    whole = threshold(z[held], labels[held])
    spoken = np.array([language(w) for w in split])
    each = [threshold(z[m], labels[m]) if min((m := held & (spoken == i)) @ (labels == 1), m @ (labels == 0)) >= 20 else whole for i in range(len(LANGUAGES))]
    return model._replace(thresholds=np.array(each))


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest sum of both classes' shares on their own side, the clean texts' share counted twice; the middle
    of the gap where it may lie."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    good = 2 * np.r_[0, np.cumsum(y == 0)] / max(1, (y == 0).sum()) + np.r_[(y == 1).sum(), (y == 1).sum() - np.cumsum(y == 1)] / max(1, (y == 1).sum())
    good[1:-1][z[1:] == z[:-1]] = -1  # no cut parts equal logits
    best = int(good.argmax())
    low, high = z[best - 1] if best else z[0] - 2, z[best] if best < len(z) else z[-1] + 2
    return float((low + high) / 2)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = MOST_TEXTS) -> pd.DataFrame:
    """(text, toxic, fold): texts of at most per_class labelled ids of each class, drawn by the hash of the id, at most `most` in all."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "id")
    fold = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("int")
    return texts.select("id", "text", "toxic", fold.alias("fold")).orderBy("id", "text").limit(most).toPandas()


def scored(docs: DataFrame, model: Model | None, text: str = "text"):
    """The score column: 0 to 1, at least 0.5 where the logit reaches the language's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        known: dict[str, int] = {}
        for x in fresh(parts):
            out = []
            for t in x:
                if m is None:
                    out.append(0.0)
                    continue
                w = words_of(t)
                if len(known) > CACHED:
                    known.clear()
                for u in set(w).difference(known):
                    known[u] = m.rows.get(hashed(u), 0)
                ids = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                z = logit(m, ids) - m.thresholds[language(w)]
                out.append(float(1 / (1 + np.exp(-np.clip(m.scale * z, -30, 30)))))
            yield pd.Series(out, dtype="float64")

    return score(F.col(text))


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    drawn = sample(docs, labels, per_class)
    return fit(drawn["text"].tolist(), drawn["toxic"].to_numpy().astype(int), drawn["fold"].to_numpy())


def clean(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    return docs.where(scored(docs, trained(train_docs, labels), text) < 0.5)


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep's columns, score and predicted, by a model that is trained on train_docs and labels first."""
    model = trained(train_docs, labels, per_class)
    df = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], scored(docs, model, text).alias("score"))
    return df.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    df = toxicity(docs, docs, labels)
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
