"""Dense vectors as arrays of numbers: distances, arithmetic, text form. All sums are in double precision, inside the JVM.

Null in, null out. Vectors of different lengths raise an error when the row is evaluated."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dims(v: Column) -> Column:
    return F.when(v.isNotNull(), F.size(v))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors have different dimensions")).cast("double")))


def inner_product(a: Column, b: Column) -> Column:
    return same_length(a, b, total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_distance(a: Column, b: Column) -> Column:
    return same_length(a, b, F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine kept within -1 and 1; 1 if either vector is zero."""
    n = norm(a) * norm(b)
    cosine = inner_product(a, b) / F.when(n != 0, n)
    return F.when(n == 0, 1.0).otherwise(1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    return F.transform(v, lambda x: x.cast("double") / F.when(norm(v) == 0, 1.0).otherwise(norm(v)))


def from_text(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def typed(v: Column, n: int) -> Column:
    """v as a vector of n dimensions; an error for another length or an element that is missing."""
    bad = (F.size(v) != n) | F.exists(v, lambda x: x.isNull())
    return F.when(bad, F.raise_error(F.lit(f"a vector of {n} dimensions was expected")).cast("array<double>")).otherwise(v.cast("array<double>"))


def to_text(v: Column) -> Column:
    return F.to_json(v)


DISTANCES = {"l2": l2_distance, "cosine": cosine_distance, "inner": lambda a, b: -inner_product(a, b)}


def knn(df: DataFrame, vector: str, query: Sequence[float], k: int, key: str, metric: str = "l2") -> DataFrame:
    """The k nearest rows; for inner products the largest. A top-k in each task, then one merge."""
    return df.withColumn("distance", DISTANCES[metric](F.col(vector), literal(query))).orderBy(F.col("distance").asc_nulls_last(), key).limit(k)


def within(df: DataFrame, vector: str, query: Sequence[float], radius: float, metric: str = "l2") -> DataFrame:
    return df.withColumn("distance", DISTANCES[metric](F.col(vector), literal(query))).where(F.col("distance") < radius)


def summed(df: DataFrame, vector: str, by: Sequence[str] = (), mean: bool = False, unit: bool = False) -> DataFrame:
    """The element-wise sum, mean or normalized sum of each group's vectors. Elements are added up by position, so that no
    group of vectors is gathered; only one element for each position comes together again."""
    at = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg((F.avg if mean else F.sum)(F.col("x").cast("double")).alias("x"))
    out = at.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias(vector))
    return out.withColumn(vector, normalize(F.col(vector))) if unit else out


#: Bytes of vectors in a block of queries, and numbers in one slice of rows or of products.
BLOCK_BYTES, SLICE = 32_000_000, 1 << 20
#: Queries beyond which a row costs more to compare than to move, so that rows are dealt out evenly over all cores first.
SPREAD = 1000
#: Kinds of vectors, which are also the order of their distances: numbers, NaN, null.
NUMBER, NAN, NULL = 0, 1, 2


class _Vectors:
    """Keys and vectors of an Arrow table: a matrix of doubles, and the kind of each row."""

    def __init__(self, keys, vectors):
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(vectors, pa.ChunkedArray):
            vectors, keys = vectors.combine_chunks(), keys.combine_chunks()
        there = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)[there]
        if len(size) and (size != size[0]).any():
            raise ValueError("vectors have different dimensions")
        flat, self.dims = vectors.flatten(), int(size[0]) if len(size) else None
        gaps = pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(len(size), self.dims or 0).any(1)
        x = np.zeros((len(vectors), self.dims or 0))
        x[there] = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), self.dims or 0)
        self.kind = np.where(there, NUMBER, NULL).astype(np.int8)
        self.kind[np.flatnonzero(there)[gaps]] = NULL
        self.kind[(self.kind == NUMBER) & np.isnan(x).any(1)] = NAN
        x[self.kind != NUMBER] = 0
        self.x, self.keys = x, keys.to_numpy(zero_copy_only=False) if pa.types.is_integer(keys.type) and not keys.null_count else np.array(keys.to_pylist(), dtype=object)
        # what single precision holds well; others are compared in double precision alone
        most = np.abs(x).max(1, initial=0)
        self.plain = (self.kind == NUMBER) & ((most == 0) | ((most > 1e-12) & (most < 1e12)))

    def take(self, at: np.ndarray) -> _Vectors:
        out = object.__new__(_Vectors)
        out.dims, out.x, out.keys, out.kind, out.plain = self.dims, self.x[at], self.keys[at], self.kind[at], self.plain[at]
        return out


def _codes(keys: np.ndarray) -> np.ndarray:
    """Numbers in the order of the keys, a null before all."""
    return pd.factorize(keys, sort=True)[0] if keys.dtype == object else keys


class _Nearest:
    """The k nearest of the rows seen so far for each of a block of queries. Products in single precision, with a bound for what they can be
    off, leave the few rows that may be among them; those are compared in double precision, element after element as l2_distance adds."""

    def __init__(self, q: _Vectors, k: int, others: bool):
        self.q, self.k, self.others = q, k, others
        self.off = 2.5 * ((q.dims or 0) + 8) * 2.0**-24
        self.square = (q.x**2).sum(1)
        with np.errstate(over="ignore"):
            self.left = np.concatenate([-2 * q.x, np.ones((len(q.x), 1))], 1).astype(np.float32)
        #: No row whose squared distance is more can be among the nearest.
        self.most = np.full(len(q.x), np.inf)
        self.i, self.d, self.kind, self.n = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int8), None

    def _spare(self, codes: np.ndarray) -> int:
        """How many rows are enough when those of one key may be left out."""
        return self.k + (int(np.unique(codes, return_counts=True)[1].max(initial=0)) if self.others else 0)

    def thinned(self, rows: _Vectors) -> np.ndarray:
        """The rows, but of equal vectors only the first by key that a query could need."""
        codes = _codes(rows.keys)
        whole = np.ascontiguousarray(np.concatenate([rows.x, rows.kind[:, None]], 1))
        same = np.unique(whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((codes, same))
        at = np.arange(len(order)) - np.r_[0, np.cumsum(np.bincount(same))[:-1]][same[order]] if len(order) else order
        return np.sort(order[at < self._spare(codes)])

    def add(self, rows: _Vectors, groups: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Takes in some rows; each group is positions of rows and those of the queries they are held against."""
        if rows.dims is not None and self.q.dims is not None and rows.dims != self.q.dims:
            raise ValueError("vectors have different dimensions")
        found = [pair for r, q in groups if len(r) and len(q) for pair in self._pairs(rows, r, q)]
        if found:
            self._keep(*[np.concatenate(y) for y in zip(*found)])

    def _pairs(self, rows: _Vectors, r: np.ndarray, q: np.ndarray):
        plain, odd = r[rows.plain[r]], r[~rows.plain[r]]
        counted, huge, lost = q[self.q.plain[q]], q[~self.q.plain[q] & (self.q.kind[q] == NUMBER)], q[self.q.kind[q] != NUMBER]
        if len(plain) and len(counted):
            yield from self._near(rows, plain, counted)
        if len(odd) and len(counted):
            yield from self._all(rows, odd, counted)
        if len(huge):
            yield from self._all(rows, r, huge)
        if len(lost):
            # for these only the kind of a row and its key make a difference
            codes = _codes(rows.keys[r])
            for kind in (NAN, NULL):
                mine = lost[self.q.kind[lost] == kind]
                first = np.lexsort((codes, (rows.kind[r] == NULL) & (kind == NAN)))[: self._spare(codes)]
                yield from self._all(rows, r[first], mine)

    def _near(self, rows: _Vectors, r: np.ndarray, q: np.ndarray):
        x = rows.x[r]
        square = (x**2).sum(1)
        # columns are filled up to whole words of eight, which are looked through at once below
        width = -(-len(r) // 8) * 8
        right = np.zeros((x.shape[1] + 1, width), np.float32)
        right[:-1, : len(r)], right[-1, : len(r)] = x.T, square * (1 - self.off)
        spare = self._spare(_codes(rows.keys[r]))
        few = min(len(r), 1000 + spare)
        step = max(1, SLICE // width)
        for a in range(0, len(q), step):
            mine = q[a : a + step]
            product = self.left[mine] @ right
            if spare <= few and not np.isfinite(self.most[mine]).all():
                above = np.partition(product[:, :few] + (3 * self.off * square[:few]).astype(np.float32), spare - 1, axis=1)[:, spare - 1]
                self.most[mine] = np.minimum(self.most[mine], above + self.square[mine] * (1 + 2 * self.off))
            bound = np.nextafter((self.most[mine] - self.square[mine] * (1 - self.off)).astype(np.float32), np.float32(np.inf))
            near = (product <= bound[:, None]).reshape(-1, 8)
            words = np.flatnonzero(near.view(np.uint64).ravel())
            w, bit = np.nonzero(near[words])
            i, j = np.divmod(words[w] * 8 + bit, width)
            there = j < len(r)
            yield from self._exact(rows, mine[i[there]], r[j[there]])

    def _all(self, rows: _Vectors, r: np.ndarray, q: np.ndarray):
        step = max(1, SLICE // len(r))
        for a in range(0, len(q), step):
            mine = q[a : a + step]
            yield from self._exact(rows, np.repeat(mine, len(r)), np.tile(r, len(mine)))

    def _exact(self, rows: _Vectors, i: np.ndarray, j: np.ndarray):
        if self.others:
            other = self.q.keys[i] != rows.keys[j]
            i, j = i[other], j[other]
        step = max(1, SLICE // max(1, self.q.dims or 0))
        for a in range(0, len(i), step):
            ia, ja = i[a : a + step], j[a : a + step]
            kind = np.maximum(self.q.kind[ia], rows.kind[ja])
            kind[(self.q.kind[ia] == NULL) | (rows.kind[ja] == NULL)] = NULL
            total = np.zeros(len(ia))
            if self.q.dims and rows.dims:
                with np.errstate(invalid="ignore", over="ignore"):
                    by = (rows.x[ja] - self.q.x[ia]) ** 2
                    for y in by.T:
                        total += y
            d = np.sqrt(total)
            kind[np.isnan(d) & (kind == NUMBER)] = NAN
            d[kind != NUMBER] = 0
            # of a slice no more than k rows of a query are kept, so that rows at one distance don't heap up
            first = self._first(ia, kind, d, rows.keys[ja])
            yield ia[first], kind[first], d[first], rows.keys[ja[first]]

    def _first(self, i, kind, d, n) -> np.ndarray:
        order = np.lexsort((_codes(n), d, kind, i))
        i = i[order]
        start = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
        at = np.arange(len(i)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(i) else i
        return order[at < self.k]

    def _keep(self, i, kind, d, n) -> None:
        if self.n is not None:
            i, kind, d, n = (np.concatenate(y) for y in ((self.i, i), (self.kind, kind), (self.d, d), (self.n, n)))
        first = self._first(i, kind, d, n)
        self.i, self.kind, self.d, self.n = i[first], kind[first], d[first], n[first]
        last = np.flatnonzero(np.bincount(self.i, minlength=len(self.q.x)) == self.k)
        at = np.cumsum(np.bincount(self.i, minlength=len(self.q.x)))[last] - 1
        good = self.kind[at] == NUMBER
        self.most[last[good]] = np.minimum(self.most[last[good]], self.d[at[good]] ** 2 * (1 + 1e-12))


def _searched(e: DataFrame, q: DataFrame, k: int, block: int | None, others: bool, probed=None) -> DataFrame:
    """(q, n, distance): for each row (q, v) of q the k nearest rows (n, e) of e. Each block of queries, of BLOCK_BYTES of vectors or `block` rows,
    is shared with all tasks; a task reads its rows once and passes on k of them for a query. `probed` is a function from vectors to the cells
    that are looked at; e then has a column cell."""
    from functools import reduce

    import pyarrow as pa

    context = e.sparkSession.sparkContext
    if others:
        e, q = e.where(F.col("n").isNotNull()), q.where(F.col("q").isNotNull())
    one = q.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("dims")).first()
    blocks = max(1, -(-one.rows // (block or max(1, BLOCK_BYTES // (8 * max(one.dims or 1, 1))))))
    if one.rows > SPREAD:
        e = e.repartition(4 * context.defaultParallelism)
    types = {"q": q.schema["q"].dataType.simpleString(), "n": e.schema["n"].dataType.simpleString()}

    def held(i: int) -> DataFrame:
        mine = q.where(F.pmod(F.xxhash64("q", "v"), F.lit(blocks)) == i).select("q", "v").toArrow()
        key = mine.schema.field("q").type
        vectors = _Vectors(mine["q"], mine["v"])
        cells = probed(vectors.x) if probed and len(vectors.x) else None
        shared = context.broadcast((vectors, cells))

        def search(batches):
            vectors, cells = shared.value
            state, kind = _Nearest(vectors, k, others), None
            every = np.arange(len(vectors.x))
            if cells is not None:
                order = np.argsort(cells.ravel(), kind="stable")
                at = np.r_[0, np.cumsum(np.bincount(cells.ravel()))]
                within = [order[at[c] : at[c + 1]] // cells.shape[1] for c in range(len(at) - 1)]
            for batch in batches if len(every) else ():
                kind = batch.schema.field("n").type
                step = max(1, SLICE // max(1, vectors.dims or 0))
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    rows = _Vectors(part.column("n"), part.column("e"))
                    if cells is None:
                        state.add(rows, [(state.thinned(rows), every)])
                        continue
                    cell, kept = part.column("cell").to_numpy(zero_copy_only=False), state.thinned(rows)
                    state.add(rows, [(kept[cell[kept] == c], within[c]) for c in np.unique(cell[kept]).astype(int) if c < len(within)])
            if state.n is not None:
                d = pa.array(np.where(state.kind == NAN, np.nan, state.d), pa.float64(), mask=state.kind == NULL)
                out = {"q": pa.array(vectors.keys[state.i].tolist(), key), "n": pa.array(state.n.tolist(), kind), "distance": d}
                yield from pa.table(out).to_batches(max_chunksize=10_000)

        return e.mapInArrow(search, f"q {types['q']}, n {types['n']}, distance double")

    found = reduce(DataFrame.unionByName, map(held, range(blocks)))
    nearest = Window.partitionBy("q").orderBy(F.col("distance").asc_nulls_last(), "n")
    return found.withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= k).drop("rn")


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int | None = None, others: bool = True) -> DataFrame:
    """(q, n, distance): the k nearest rows of df for each row of a stated query set with the same columns, itself left out if `others`; rows
    without a distance come last. A block of queries at a time is held against every row; each task keeps k rows of a query before rows move."""
    return _searched(df.select(F.col(key).alias("n"), F.col(vector).alias("e")), queries.select(F.col(key).alias("q"), F.col(vector).alias("v")), k, block, others)


class Cells:
    """An inverted file: rows by the nearest of `lists` centroids, which are fitted on at most `sample` vectors, drawn by the hash of their
    key. Every row is in the index; a search looks at the cells of the `probe` nearest centroids and compares exactly there."""

    def __init__(self, df: DataFrame, key: str, vector: str, lists: int = 100, sample: int = 20_000, rounds: int = 10, seed: int = 0):
        self.key, self.vector = key, vector
        drawn = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).select(vector).toPandas()[vector]
        x = np.stack([np.asarray(v, np.float64) for v in drawn]) if len(drawn) else np.zeros((0, 0))
        rng = np.random.default_rng(seed)
        c = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))]
        for _ in range(rounds if len(x) else 0):
            at = self._order(c, x)[:, 0]
            for i in range(len(c)):
                if (at == i).any():
                    c[i] = x[at == i].mean(0)
        self.centroids = c
        self.shared = df.sparkSession.sparkContext.broadcast(c)

    @staticmethod
    def _order(c: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each row of x the centroids, the nearest first."""
        return np.argsort((c**2).sum(1)[None] - 2 * x @ c.T, axis=1, kind="stable")

    def indexed(self, df: DataFrame) -> DataFrame:
        """df with the cell of each row; null vectors are in none."""
        shared = self.shared

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(v), index=v.index, dtype="Int32")
            there = v.notna()
            if there.any():
                out[there] = Cells._order(shared.value, np.stack([np.asarray(y, np.float64) for y in v[there]]))[:, 0]
            return out

        return df.withColumn("cell", cell(F.col(self.vector)))

    def search(self, indexed: DataFrame, queries: DataFrame, k: int, probe: int = 10, block: int | None = None, others: bool = True) -> DataFrame:
        """(q, n, distance). A block of queries is held against the rows of its cells, row by row where they lie: a cell may hold most rows, and
        none of them moves but the k nearest of each task."""
        centroids = self.centroids
        q = queries.where(F.col(self.vector).isNotNull()).select(F.col(self.key).alias("q"), F.col(self.vector).alias("v"))
        e = indexed.where(F.col("cell").isNotNull()).select(F.col(self.key).alias("n"), F.col(self.vector).alias("e"), "cell")
        return _searched(e, q, k, block, others, lambda v: Cells._order(centroids, v)[:, :probe].astype(np.int32))
