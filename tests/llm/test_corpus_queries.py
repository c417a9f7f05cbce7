"""Registered corpus queries: SQL twins at the smallest size, and the pipeline against its stages done plainly."""

from __future__ import annotations

import os

import pytest

from tapewright.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert not compare(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_for_each_row(spark, name):
    table = "pages" if "html" in name else "conversations" if "conversation" in name else "documents"
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    assert QUERIES[name](spark, FOLDER).count() == (rows.select("conv_id").distinct() if table == "conversations" else rows).count()


def test_pipeline(spark):
    import corpus_pipeline as c
    from tapewright.llm import toxicity
    from tests.llm.test_copies import brute, norm

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    left = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.scored(docs, model).collect():
        if r.score >= 0.5:
            del left[r.doc_id]
    last = {}
    for i in sorted(left):
        last[norm(left[i])] = i
    left = {i: left[i] for i in sorted(last.values())}
    sets = []
    for i, t in left.items():
        w = norm(t).split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    left = {i: left[i] for (i, _), root in zip(sets, brute(sets, 80)) if i == root}
    got = {}
    for r in c.run(spark, FOLDER).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert set(got) <= set(left)
    from tapewright.llm import mixing

    rest = docs.filter(docs.doc_id.isin(list(left)))
    assert got == {r.doc_id: r.copies for r in mixing.mix(rest).collect() if r.copies}
