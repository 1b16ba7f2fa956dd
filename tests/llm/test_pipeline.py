"""The stages one after another on a small table, and on rows with nulls, repeats and extra columns."""

import oracle
import pytest

from tidemark.llm import decontaminate, queries, secrets
from tidemark.llm.common import stored, table


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, small, name):
    assert oracle.compare(queries.QUERIES[name](spark, small), oracle.connect(small), queries.ORACLE[name]) is None


def test_stages(spark, small):
    import corpus_pipeline as c

    docs, kept = table(spark, small, "documents"), {}
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        docs = stored(stage(spark, docs, small), name)
        kept[name] = docs.count()
        assert docs.columns == columns
    assert kept["toxicity"] >= kept["near_dedup"] >= kept["decontamination"] == kept["secrets"] > 100
    assert decontaminate.digest(docs, table(spark, small, "benchmark")).where("contaminated").count() == 0
    assert secrets.digest(docs).where("spans <> ''").count() == 0
    pieces = c.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_odd_rows(spark, small):
    import corpus_pipeline as c

    rows = [(1, None, None, None, None, 1.0), (None, "hello token=abcdefghi", "en", "s", 5, 2.0), (3, "", "en", "s", 0, 3.0), (3, "", "en", "s", 0, 3.0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    clashing = spark.createDataFrame([(r[0], r[1], 1, 2, 3, 4, "a", "b", 7, 8.0, 9, 1, 1) for r in [*rows, (7, long), (8, long + " tail"), (9, "x" * 40_000)]], "doc_id long, text string, id int, mark int, key int, root int, wanted string, t string, n int, score double, h int, own int, first int")
    for some, n in ((odd, 2), (odd.limit(0), 0), (clashing, 4), (clashing.limit(0), 0)):
        names = some.columns
        for name, stage in c.STAGES[:-1]:
            some = stored(stage(spark, some, small), name)
            assert some.columns == names
        assert some.count() == n
        assert c.STAGES[-1][1](spark, some, small).where("start = 0").count() == n
