"""Null and repeated ids lose no text of other rows."""

import random

import pytest

from seqgrid.llm import neardup, passages, substrings


def text(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(50_000)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b, c, d = text(120, 1), text(120, 2), text(120, 3), text(120, 4)
    rows = [(1, a), (None, a), (None, b), (5, a + " x"), (5, c), (7, d), (7, d), (8, d[:300] + " " + text(60, 5))]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source", "'e' as lang"), (a, b, c, d)


def test_near_duplicates_of_shared_ids(docs):
    df, (a, b, c, d) = docs
    got = [(r.doc_id, r.text) for r in neardup.keep_one_each(df).collect()]
    assert {(1, a), (None, b), (5, c), (7, d)} <= set(got) and len(got) == 5


def test_passages_of_shared_ids(docs):
    df, (a, b, c, d) = docs
    got = {(r.doc_id, r.text) for r in passages.cut_passages(df).collect()}
    assert {(1, a), (None, b), (5, c), (7, d)} <= got and (None, a) not in got


def test_substrings_of_shared_ids(docs):
    df, (a, b, c, d) = docs
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substrings.remove_repeats(df).collect())
    want = [(0, len(a), len(a)), (0, len(b), 0), (1, len(a), 0), (5, len(a) + 2, len(a)), (5, len(c), 0), (7, len(d), 0), (7, len(d), 0)]
    assert got[:-1] == sorted(want) and got[-1][2] >= 300
