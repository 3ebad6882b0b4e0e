"""Trees from text and from distances."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqgrid.operators import identity, joining, newick, trees
from seqgrid.operators.bootstrap import draws, times_drawn


def parsed(spark, *texts, n=0):
    df = spark.createDataFrame(list(enumerate(texts)), "tree_id int, text string")
    return newick.parse_trees(df, n)


def test_newick_round_trip(spark):
    texts = ["((a:1,'b c':2.5)90:0.25,(d:1,e:0.000001):3,'it''s':0);", "(a:1,(b:2,(c:3,d:4)50:1)100:2);", "x:1;"]
    nodes = parsed(spark, *texts).cache()
    got = {r.tree_id: r.text for r in newick.format_newick(nodes).collect()}
    assert got[0] == texts[0] and got[1] == texts[1] and got[2] == "x;"
    leaves = {r.name for r in nodes.where("tree_id = 0 and name is not null").collect()}
    assert leaves == {"a", "b c", "d", "e", "it's"}
    assert [r.support for r in nodes.where("tree_id = 0 and support is not null").collect()] == [0.9]
    nodes.unpersist()


def test_nexus(spark):
    text = "#NEXUS\nbegin trees;\n translate 1 alpha, 2 'beta gamma', 3 delta;\n tree one = [&R] ((1:1,2:2)[x]:1,3:1);\n tree two = (1,2);\nend;"
    got = parsed(spark, text).where("name is not null").orderBy("node_id").collect()
    assert [r.name for r in got] == ["alpha", "beta gamma", "delta"] and [r.length for r in got] == [1, 2, 1]


def test_joining_of_additive_distances(spark):
    # Four leaves with branches 1..4 and an inner branch of 2.
    d = {("a", "b"): 3, ("a", "c"): 6, ("a", "d"): 7, ("b", "c"): 7, ("b", "d"): 8, ("c", "d"): 7}
    members = spark.createDataFrame([("t", i, x) for i, x in enumerate("abcd")], "tree_id string, row_ix int, name string")
    pairs = spark.createDataFrame([("t", "abcd".index(x), "abcd".index(y), float(v)) for (x, y), v in d.items()], "tree_id string, i int, j int, dist double")
    nodes = joining.neighbor_join(members, pairs, "tree_id")
    length = {r.name: r.length for r in nodes.collect() if r.name}
    assert length["a"] == pytest.approx(1) and length["b"] == pytest.approx(2)
    splits = {tuple(r.split) for r in trees.bipartitions(nodes).collect()}
    assert splits == {("c", "d")}
    one = joining.neighbor_join(members.where("row_ix = 0"), pairs.where("i < 0"), "tree_id").collect()
    assert [(r.name, r.parent_id) for r in one] == [("a", None)]


@pytest.mark.parametrize("width", [7, 5000])
def test_pair_counts(spark, width):
    r = random.Random(width)
    rows = [("x", i, "".join(r.choice("AC-") for _ in range(width - r.randrange(5)))) for i in range(140)] + [("x", 200, ""), ("y", 1, "AC"), ("y", 2, "--")]
    df = spark.createDataFrame(rows, "aln_id string, row_ix int, aligned string")
    got = {(p.aln_id, p.i, p.j): (p.same, p.compared, p.pct) for p in identity.pair_identity(df).collect()}
    want = {}
    for a, i, s in rows:
        for b, j, t in rows:
            if a == b and i < j:
                met = [x == y for x, y in zip(s, t, strict=False) if "-" not in (x, y)]
                want[a, i, j] = (sum(met), len(met), 100 * sum(met) / len(met) if met else 0.0)
    assert got == want


def test_draws_of_both_forms_agree(spark):
    widths = spark.createDataFrame([("x", 37)], "aln_id string, width int")
    got = np.zeros((3, 37))
    for r in draws(widths, 3, 11).collect():
        got[r.rep, r.col] = r.times
    assert (got == times_drawn(37, 3, 11)).all()


def test_support_of_clear_groups(spark):
    r = random.Random(3)
    base = ["".join(r.choice("ACDEFGHIKL") for _ in range(300)) for _ in range(2)]
    change = lambda s, n: "".join(r.choice("MNPQ") if r.random() < n else x for x in s)
    rows = [("t", i, f"s{i}", change(base[i // 3], 0.1)) for i in range(6)]
    df = spark.createDataFrame(rows, "aln_id string, row_ix int, name string, aligned string")
    nodes = joining.build_trees(df, replicates=10)
    got = {tuple(x.split): x.support for x in trees.bipartitions(nodes).join(nodes.select("node_id", "support"), "node_id").collect()}
    assert got["s3", "s4", "s5"] == 1.0


def test_zones_and_global_gaps(spark):
    rows = [("t", 0, "AAC-A"), ("t", 1, "ACCCA"), ("t", 2, "AAC")]
    df = spark.createDataFrame(rows, "aln_id string, row_ix int, aligned string")
    zones = spark.createDataFrame([("t", 0, 1), ("t", 1, 4)], "aln_id string, first int, last int")
    full = spark.createDataFrame([("t", c) for c in range(3)], "aln_id string, col int")
    at = lambda x: {(r.i, r.j): (r.same, r.compared) for r in x.collect()}
    assert at(identity.identity_distance(df, zones=zones))[0, 1] == (3, 5)
    assert at(identity.identity_distance(df, ungapped=full)) == {(0, 1): (2, 3), (0, 2): (3, 3), (1, 2): (2, 3)}
    assert at(identity.identity_distance(df, full, zones))[0, 1] == (2, 4)


def _shape(nodes):
    """node_id -> (parent, place, name), and the lengths."""
    rows = nodes.to_dict("records")
    return [(None if r["parent_id"] != r["parent_id"] or r["parent_id"] is None else int(r["parent_id"]), r["child_ix"], r["name"]) for r in rows], [r["length"] for r in rows]


@pytest.mark.parametrize(("n", "kind"), [(3, "plain"), (40, "plain"), (40, "ties"), (150, "uneven"), (90, "copies")])
def test_joining_by_rows_equals_joining_of_the_square(n, kind):
    r = np.random.default_rng(n)
    d = r.random((n, n))
    if kind == "ties":
        d = r.integers(1, 3, (n, n)) / 2.0
    elif kind == "uneven":
        d *= r.random(n)[:, None] * r.random(n)[None, :] * 5
    elif kind == "copies":
        x = r.random((n // 3, 4))[r.integers(0, n // 3, n)]
        d = np.abs(x[:, None] - x[None, :]).sum(axis=2) + r.random((n, n)) * 1e-6
    d = np.triu(d, 1) + np.triu(d, 1).T
    names = [f"s{i}" for i in range(n)]
    (want, lengths), (got, by_rows) = _shape(joining._joined(names, d)), _shape(joining._joined_by_rows(names, d.copy(), tail=4))
    assert got == want and by_rows == pytest.approx(lengths, abs=1e-9)


def test_large_families_are_joined_and_not_refused(spark, monkeypatch):
    """Families of more than 2000 rows were refused with an error."""
    assert not hasattr(joining, "MAX_ROWS")
    r = random.Random(5)
    rows = [(a, 10 * i, f"{a}{i}") for a, n in (("x", 9), (None, 7), ("y", 1)) for i in range(n)]
    met = [(a, i, j, r.random()) for a, i, _ in rows for b, j, _ in rows if a == b and i < j]
    members = spark.createDataFrame(rows, "tree_id string, row_ix int, name string")
    pairs = spark.createDataFrame(met, "tree_id string, i int, j int, dist double")
    tree = lambda: sorted(((x.tree_id or "", x.node_id, x.parent_id, x.child_ix, x.name, round(x.length, 9)) for x in joining.neighbor_join(members, pairs, "tree_id").collect()), key=str)
    want = tree()
    assert len(want) == 17 + 13 + 1
    many = joining._Family()
    monkeypatch.setattr(joining, "HELD_ROWS", 4)
    n = 30
    part = lambda pair, i, j, dist, name: pa.RecordBatch.from_arrays([pa.array([pair] * len(i)), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(dist, pa.float64()), pa.array(name, pa.string())], names=["_pair", "i", "j", "dist", "name"])
    many.take(part(False, list(range(n)), [None] * n, [None] * n, [f"s{i}" for i in range(n)]))
    at = [(i, j, r.random()) for i in range(n) for j in range(i + 1, n)]
    for k in range(0, len(at), 50):
        i, j, x = (list(c) for c in zip(*at[k : k + 50], strict=True))
        many.take(part(True, i, j, x, [None] * len(i)))
    d = np.zeros((n, n))
    for i, j, x in at:
        d[i, j] = d[j, i] = x
    assert many.file is not None and isinstance(many.square, np.memmap)
    assert _shape(many.tree())[0] == _shape(joining._joined([f"s{i}" for i in range(n)], d))[0]
