"""Nearest rows against plain Python, and what a search costs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark import plans
from tidemark.functions import vector


def distance(a, b):
    if a is None or b is None or None in a or None in b:
        return (2, 0.0)
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return (1, 0.0) if math.isnan(total) else (0, math.sqrt(total))


def brute(rows, queries, k, others):
    out = {}
    for q, v in queries:
        out.setdefault(q, []).extend((distance(v, e), n) for n, e in rows if n != q or not others)
    return sorted((q, n) for q, found in out.items() for _, n in sorted(found)[:k])


def table(kind, seed):
    rng = random.Random(seed)
    draw = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(4)]
    rows = [draw() for _ in range(200)]
    if kind == "odd":
        rows[:8] = [None, None, [0.0] * 4, [1.0, None, 2.0, 3.0], [math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [1e200, 0.0, 0.0, 0.0], [1e-30] * 4]
    if kind == "equal":
        rows[:120] = [rows[0]] * 120
    if kind == "far":
        rows = [[1e6 + x / 1000 for x in r] for r in rows]
    if kind == "few":
        rows = rows[:3] + [None]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("others", [True, False])
@pytest.mark.parametrize("kind", ["plain", "odd", "equal", "far", "few"])
def test_nearest_is_exact(spark, kind, others):
    """Nulls, NaN, infinities, equal and hardly different vectors, doubled ids, ids that are texts."""
    values = table(kind, 7)
    rows = [(i if i != 11 else 10, v) for i, v in enumerate(values)]
    for key, name in ((lambda i: i, "bigint"), (lambda i: f"k{i}", "string")):
        keyed = [(key(i), v) for i, v in rows]
        queries = keyed[::5] + keyed[10:12] + [r for r in keyed if r[1] is None][:1]
        df = spark.createDataFrame(keyed, f"id {name}, v array<double>").repartition(3)
        q = spark.createDataFrame(queries, f"id {name}, v array<double>")
        for block in (None, 7):
            assert sorted(tuple(r) for r in vector.nearest(df, "id", "v", q, 5, block=block, others=others).select("q", "n").collect()) == brute(keyed, queries, 5, others)


def test_lengths_that_differ(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])], "id int, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="different dimensions"):
        vector.nearest(df, "id", "v", df.where("id = 1"), 2).collect()


def vectors(n, start=0):
    x = np.random.default_rng(start).random((n, 16))
    return vector._Vectors(pa.array(range(start, start + n)), pa.array(x.tolist(), pa.list_(pa.float64())))


def test_few_pairs_are_compared_exactly():
    """The products leave a few rows for each query, and fewer from one batch to the next."""
    state, compared = vector._Nearest(vectors(200), 5, True), []
    exact = state._exact
    state._exact = lambda rows, i, j: compared.append(len(i)) or exact(rows, i, j)
    for a in range(5):
        rows = vectors(4000, 1000 + 4000 * a)
        state.add(rows, [(state.thinned(rows), np.arange(200))])
    assert sum(compared) <= 200 * 100 < 200 * 20_000
    assert len(state.i) == 1000


@pytest.mark.parametrize("name", ["vec_knn_batch", "vec_ivf"])
def test_one_pass_over_many_queries(spark, tmp_path, name):
    """2,500 queries are held against the rows in one pass, without a join of rows and queries."""
    rows = spark.range(125_000).selectExpr("id AS vec_id", "array(CAST(id % 977 AS float), CAST(id % 1009 AS float)) AS embedding", "0 AS label")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    df = plans.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
