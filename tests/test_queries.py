"""Every registered query against its oracle; those without one must run and keep their schema."""

import oracle
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions import approx


@pytest.fixture(scope="module")
def connection(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, connection, name):
    df = plans.QUERIES[name](spark, small)
    if name in plans.ORACLE:
        assert oracle.compare(df, connection, plans.ORACLE[name]) is None
    else:
        assert len(df.columns) == len(set(df.columns))
        assert df.count() > 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_vec_ivf_recall(spark, sf):
    d = f"/root/testdata/sf{sf}"
    found, exact = ({(r.q, r.n) for r in plans.QUERIES[n](spark, d).select("q", "n").collect()} for n in ("vec_ivf", "vec_knn_batch"))
    assert len(found & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("name", ["approx_count_distinct", "hll_merge_rollup"])
def test_distinct_counts(spark, name):
    """On sf0.1 a sketch is off by some values; what the queries return isn't, and a sketch of the same column is within its bound."""
    d = "/root/testdata/sf0.1"
    assert oracle.compare(plans.QUERIES[name](spark, d), oracle.connect(d), plans.ORACLE[name]) is None
    exact = {r[0]: r[-1] for r in plans.QUERIES["approx_count_distinct"](spark, d).collect()}
    about = plans.sql.load(spark, d, "events").groupBy("event_type").agg(approx.approx_count_distinct(F.col("user_id")).alias("x"))
    assert all(abs(r.x - exact[r.event_type]) <= 3 * approx.ERROR * exact[r.event_type] for r in about.collect())
    parts = plans.QUERIES["hll_merge_rollup"](spark, d).first().parts
    merged = plans.sql.load(spark, d, "lineitem").groupBy("l_returnflag").agg(approx.hll(F.col("l_partkey")).alias("h")).agg(approx.hll_count(approx.hll_merge("h")).alias("x")).first().x
    assert abs(merged - parts) <= 3 * approx.ERROR * parts


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
