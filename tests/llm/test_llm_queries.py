"""The queries against their SQL, and p7 and p8 against the tokenizer itself."""

import pytest

from oracle import compare, connect
from tidelog.llm import queries as Q
from tidelog.llm import tokens as T

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_rows_as_sql(spark, con, name):
    rows, missing, surplus = compare(spark, Q.QUERIES[name], Q.ORACLE[name], SMALL, con)
    assert (missing, surplus) == (0, 0)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs_without_sql(spark, name):
    assert Q.QUERIES[name](spark, SMALL).count() >= 0


def test_ids_and_short_sources(spark, con):
    enc = T.encoder(T.vocabulary())
    rows = con.sql("SELECT doc_id, text, source FROM documents").fetchall()
    ids = {r["doc_id"]: list(r["ids"]) for r in Q.p7_ids(spark, SMALL).collect()}
    assert ids == {i: enc.flat(t) if t else [] for i, t, _ in rows}
    size = {}
    for i, _, s in rows:
        size[s] = size.get(s, 0) + len(ids[i])
    targets = con.sql("SELECT source, weight, max_repeats FROM mix_targets").fetchall()
    total = sum(size.get(s, 0) for s, _, _ in targets)
    assert {r["source"] for r in Q.p8_found(spark, SMALL).collect()} == {s for s, w, k in targets if k * size.get(s, 0) < w * total}
