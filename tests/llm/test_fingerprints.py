"""Fingerprints against the definition, text by text, and near duplicates against all pairs."""

import random
from hashlib import sha256

import numpy as np
import pytest

from seqgrid.llm import fingerprints as fp
from seqgrid.llm.common import materialize


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def plain_print(text):
    """Every function over every shingle, in Python's whole numbers."""
    m, known = fp.MinHash(), fp.WordHash()
    s = [int(x) >> 32 for x in fp._shingles(fp._words(text, known), fp.WORDS)]
    least = [min(((int(a) * x + int(b)) % 2**64 >> 32 for x in s), default=2**32 - 1) for a, b in zip(m.a.ravel(), m.b.ravel(), strict=True)]
    return "".join(f"{x & 0xFFFF:04x}" for x in least)


def check(spark, rows, partitions=None):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, part string, fingerprint string")
    df = materialize(df.repartition(partitions) if partitions else df, "test")
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: r[0])
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha256(edited.encode()).hexdigest())
        assert r.fingerprint == plain_print(t) and r.edited_fingerprint == plain_print(edited)
        same = lambda a, b: np.mean([a[k : k + 4] == b[k : k + 4] for k in range(0, 512, 4)])
        assert r.near_edited == pytest.approx(same(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(same(r.fingerprint, plain_print(following)))
    return got


def test_against_the_definition(spark):
    r = random.Random(5)
    rows = [(i, " ".join(words(r.choice([1, 3, 4, 5, 6, 40, 700]), i))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "ü" * 7 + " é"), (104, "A b C d E f"), (105, "a B c D e F"), (106, "x" * 300_000)]
    r.shuffle(rows)
    got = check(spark, rows, 7)
    assert got[104].fingerprint == got[105].fingerprint and got[104].near_next == 1.0
    long = [got[i] for i, t in rows if t and len(t.split()) == 700]
    assert all(x.near_edited > 0.4 and x.near_next < 0.1 for x in long)


def test_one_document_and_none(spark):
    check(spark, [(3, "one two three four five six seven eight")])
    assert check(spark, []) == {}


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "c d"), (1, "same text here"), (1, "same text here"), (1, "same text here"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.fingerprints(df).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 1) >= 2
    assert sorted(map(str, got)) == sorted(map(str, fp.fingerprints(df.repartition(5)).collect()))


def test_estimates_are_near_the_similarity():
    m, r = fp.MinHash(), np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        x = r.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2)
        cut = int(4000 * share)
        a, b = x[: cut + (4000 - cut) // 2], np.concatenate([x[:cut], x[cut + (4000 - cut) // 2 :]])
        assert np.mean(m.least(a) == m.least(b)) == pytest.approx(share, abs=0.13)


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(8)
    rows = []
    for g in range(30):
        base = words(60, 100 + g)
        for _ in range(4):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                t[r.randrange(60)] = f"z{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A B"), (504, "a c")]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in fp.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i, _ in rows}
