"""The pipeline's near copies against all pairs in plain Python."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import neardup, simhash


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited():
    """Texts of families of near copies, on both sides of 0.8."""
    rng = np.random.default_rng(5)
    out = []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 200))]
        out.append(" ".join(base))
        for k in range(5):
            w = list(base)
            for i in rng.integers(0, len(w), 1 + k):
                w[i] = "other"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [512, 2])
def test_pairs_from_0_8(spark, small, monkeypatch, chunk):
    texts = edited()
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if jaccard(texts[a], texts[b]) >= 0.8 and root[a] != root[b]:
            lo, hi = sorted((root[a], root[b]))
            root = [lo if r == hi else r for r in root]
    assert 30 < len(set(root)) < len(texts)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect()} == set(root)


def plain_print(found):
    """Bit by bit: what more than half of the shingles have, or the least one where it is half."""
    each = [[int(b) for b in row] for row in neardup.shingle_bits(found)]
    votes = [sum(column) for column in zip(*each)]
    return [int(2 * v + first > len(found)) for v, first in zip(votes, each[0])]


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_fingerprint(n):
    found = neardup.shingles(" ".join(f"w{i * i}" for i in range(n + 4)))
    assert len(found) == n
    bits = neardup.fingerprint(found)
    assert bits.tolist() == plain_print(found)
    words, keys = neardup.print_keys(bits)
    assert [int(b) for w in words for b in f"{w % (1 << 64):064b}"[::-1]] == bits[: 64 * neardup.WORDS].tolist()
    assert keys.tolist() == [sum(int(b) << i for i, b in enumerate(bits[neardup.BITS * k : neardup.BITS * (k + 1)])) for k in range(neardup.BANDS)]


def test_wide_fingerprints_bit_sliced():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, (300, neardup.WORDS), np.uint64) * np.uint64(2)
    for i in range(150, 300):  # on both sides of the radius from an earlier one
        fps[i] = fps[i - 150]
        for k in rng.choice(64 * neardup.WORDS, rng.integers(neardup.RADIUS - 8, neardup.RADIUS + 9), replace=False):
            fps[i, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    bits = np.unpackbits(fps.view(np.uint8), axis=1)
    near = np.triu((bits[:, None] != bits[None]).sum(2) <= neardup.RADIUS, 1)
    a, b = simhash.linked(np.zeros(300, int), np.full(300, -1), fps, neardup.RADIUS)
    assert 50 < near.sum() < 100
    assert simhash.forest(a, b, 300).tolist() == simhash.forest(*np.nonzero(near), 300).tolist()


@pytest.mark.parametrize("chunk", [4096, 3])
def test_linked_by_simhash(spark, monkeypatch, chunk):
    """Coarse components are those of fingerprints that agree in a piece and are within the radius, by plain Python."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    texts = edited()
    bits = np.array([neardup.fingerprint(neardup.shingles(t)) for t in texts])
    words, keys = zip(*(neardup.print_keys(b) for b in bits))
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        near = (keys[i] == keys[j]).any() and (bits[i] != bits[j])[: 64 * neardup.WORDS].sum() <= neardup.RADIUS
        assert near or jaccard(texts[i], texts[j]) < 0.8
        if near and root[i] != root[j]:
            lo, hi = sorted((root[i], root[j]))
            root = [lo if r == hi else r for r in root]
    firsts = spark.createDataFrame([(i, words[i], keys[i].tolist()) for i in range(len(texts))], "mark long, words array<long>, keys array<short>")
    got = {r.mark: r.root for r in neardup.coarsely(firsts).collect()}
    assert [len({got[i] for i in range(len(texts)) if root[i] == k}) for k in set(root)] == [1] * len(set(root))
    assert len(set(got.values())) == len(set(root)) < len(texts)
