"""Findings of round 4: each test fails on the code before."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqgrid.llm import passages
from seqgrid.operators import groups, identity, joining, trees

SEQ = "aln_id string, row_ix int, name string, grp string, aligned string"


def test_rows_travel_once_for_each_stack(spark, monkeypatch):
    """F4, F5, F6, F8: not once for each tile; any ASCII character is a letter of its own."""
    monkeypatch.setattr(identity, "TILE", 2)
    monkeypatch.setattr(identity, "BLOCK", 70)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACZ*Xj.-~\x01"), n)) for n in rng.integers(0, 160, 24).tolist()]
    s = spark.createDataFrame([("a", k, f"n{k}", "xyz"[k % 3], t) for k, t in enumerate(texts)], SEQ)
    assert identity._tiles(s, 2, []).count() == 24 * identity.STACKS
    want = {}
    for i, a in enumerate(texts):
        for j in range(i + 1, 24):
            met = [(x, y) for x, y in zip(a, texts[j], strict=False) if "-" not in (x, y)]
            want[i, j] = (sum(x == y for x, y in met), len(met))
    pairs = identity.pair_identity(s).cache()
    assert {(r.i, r.j): (r.same, r.compared) for r in pairs.collect()} == want
    assert sorted(identity.row_partners(s).collect()) == sorted(groups.best_partners(pairs, s).collect())
    assert identity.row_summary(s).first().mean == pytest.approx(identity.identity_summary(pairs).first().mean)


def _deep(n):
    """A chain of n nodes beside leaves, and a tree with random parents."""
    r = random.Random(n)
    rows = [("deep", f"c{k}", f"c{k - 1}" if k else None, k % 2) for k in range(n)] + [("deep", f"l{k}", f"c{k}", 1 - k % 2) for k in range(n)]
    return rows + [("wild", f"w{k}", f"w{r.randrange(k)}" if k else None, k) for k in range(n)] + [("wild", "lone", "gone", 0), ("wild", "below", "lone", 0)]


def test_paths_and_splits_make_no_row_for_a_name(spark):
    """stretches of chains and of leaves are listed within tasks."""
    rows = _deep(40)
    up = {(t, n): p for t, n, p, _ in rows}
    nodes = spark.createDataFrame([(*r, r[1] if r[1][0] != "w" or int(r[1][1:]) % 5 else None, 1.0) for r in rows], "tree_id string, node_id string, parent_id string, child_ix int, name string, length double")
    r = random.Random(1)
    pairs = [(t, *r.choices(sorted(n for k, n in up if k == t), k=2)) for t in ("deep", "wild") for _ in range(30)] + [("wild", "w1", "lone"), ("wild", "below", "lone"), ("deep", "c3", "c3"), ("deep", "c3", "none")]
    want = {}
    for t, a, b in pairs:
        if (t, a) not in up or (t, b) not in up:
            continue
        ways = []
        for n in (a, b):
            way = [n]
            while up.get((t, way[-1])) and (t, up[t, way[-1]]) in up:
                way.append(up[t, way[-1]])
            ways.append(way)
        common = next((n for n in ways[0] if n in ways[1]), None)
        if common:
            want[t, a, b] = {n for w in ways for n in w[: w.index(common) + 1]}
    asked = spark.createDataFrame(pairs, "tree_id string, a string, b string")
    found = trees.path_digests(nodes, asked)
    md5 = lambda names: hashlib.md5(",".join(sorted(names)).encode()).hexdigest()
    assert {(x.tree_id, x.a, x.b): (x.n, x.digest) for x in found.collect()} == {k: (len(v), md5(v)) for k, v in want.items()}
    got = {}
    for x in trees.paths(nodes, asked).collect():
        got.setdefault((x.tree_id, x.a, x.b), []).append(x.node_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    rooted = nodes.where("node_id not in ('lone', 'below')")  # ranks are those of one root
    listed = {(x.tree_id, x.node_id): md5(x.split) for x in trees.bipartitions(rooted).collect()}
    assert len(listed) > 40 and {(x.tree_id, x.node_id): x.digest for x in trees.split_digests(rooted).collect()} == listed


def test_every_run_of_words_is_a_seed():
    """no run is left out, and each is of one band."""
    texts = [" ".join(f"w{(7 * k * n) % 50}" for k in range(30 * n)) for n in range(4)] + [None, "", "a b c", "a b c d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "text"])
    rows = lambda *of: [tuple(r.values()) for b in passages._seed_scan(iter([batch]), *of) for r in b.to_pylist()]
    assert sorted((d, p) for _, d, p in rows()) == [(d, p) for d, t in enumerate(texts) for p in range(len((t or "").split()) - passages.K + 1)]
    bands = [rows(k, passages.BANDS) for k in range(passages.BANDS)]
    assert sorted(sum(bands, [])) == sorted(rows()) and not {s for s, *_ in bands[0]} & {s for s, *_ in bands[1]}


def test_trees_are_joined_without_rows_of_pairs(spark, monkeypatch):
    """a family's distances are made where it is joined, for its replicates too."""
    monkeypatch.setattr(joining, "TILE", 4)
    monkeypatch.setattr(joining, "HELD_ROWS", 6)
    r = np.random.default_rng(8)
    rows = [(a, k, f"{a}{k}", None, "".join(r.choice(list("ACD-"), m))) for a, n in (("x", 11), ("y", 5), (None, 3)) for k, m in enumerate(r.integers(9, 40, n).tolist())]
    s = spark.createDataFrame(rows, SEQ)
    tree = lambda df: sorted(((x.tree_id or "", x.rep, x.node_id, x.parent_id, x.child_ix, x.name, round(x.length, 9)) for x in df.collect()), key=str)
    members = s.select(F.col("aln_id").alias("tree_id"), "row_ix", "name")
    pairs = lambda n: identity.distances(identity.pair_counts(s.where("aln_id is not null") if n else s, n, 5)).withColumnRenamed("aln_id", "tree_id")
    assert tree(joining.joined_rows(s)) == tree(joining.neighbor_join(members.withColumn("rep", F.lit(-1)), pairs(0).withColumn("rep", F.lit(-1)), "tree_id", "rep"))
    drawn = members.where("tree_id is not null").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2))))
    assert tree(joining.joined_rows(s, 3, 5).where("tree_id is not null")) == tree(joining.neighbor_join(drawn, pairs(3), "tree_id", "rep"))
    assert joining.build_trees(s, 3, 5).where("support is not null").count() > 0
    assert joining.joined_rows(s, 3, 5)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
