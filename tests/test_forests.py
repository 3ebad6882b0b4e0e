"""Tree operators over many and deep trees, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from seqgrid.operators import newick, trees

SCHEMA = "tree_id int, node_id int, parent_id int, child_ix int, name string, length double, support double"


def random_tree(tree_id, n, r, names=None):
    """Nodes in random order of ids; children of a node in order of their making."""
    ids = list(range(n))
    r.shuffle(ids)
    rows, kids = [(tree_id, ids[0], None, 0, None, 0.25, None)], {}
    for k in range(1, n):
        p = ids[r.randrange(max(0, k - 6), k)]
        rows.append((tree_id, ids[k], p, kids.setdefault(p, 0), None, r.randrange(1, 9) / 4, None))
        kids[p] += 1
    name = lambda i: f"n{i % names if names else i}"
    return [x if x[1] in kids else (*x[:4], name(x[1]), *x[5:]) for x in rows]


class Plain:
    def __init__(self, rows):
        self.up = {x[1]: x[2] for x in rows}
        self.length = {x[1]: x[5] for x in rows}
        self.name = {x[1]: x[4] for x in rows}
        self.kids = {}
        for x in sorted(rows, key=lambda x: x[3]):
            self.kids.setdefault(x[2], []).append(x[1])
        self.root = next(x[1] for x in rows if x[2] is None)

    def way(self, i):
        out = []
        while i is not None:
            out.append(i)
            i = self.up[i]
        return out

    def leaves(self, i=None):
        stack, out = [self.root if i is None else i], []
        while stack:
            x = stack.pop()
            if x in self.kids:
                stack += reversed(self.kids[x])
            else:
                out.append(x)
        return out

    def split(self, i):
        everything, own = sorted(self.name[x] for x in self.leaves()), sorted(self.name[x] for x in self.leaves(i))
        if not 2 <= len(own) <= len(everything) - 2:
            return None
        return tuple(own) if everything[0] not in own else tuple(x for x in everything if x not in own)


@pytest.fixture(scope="module")
def forest():
    r = random.Random(7)
    return {t: random_tree(t, r.choice([1, 2, 3, 5, 20, 40]), r) for t in range(100)}


@pytest.fixture(scope="module")
def nodes(spark, forest):
    return spark.createDataFrame([x for t in forest.values() for x in t], SCHEMA).cache()


def test_info_stats_and_ranks(nodes, forest):
    info = {(x.tree_id, x.node_id): (x.depth, x.tips) for x in trees.node_info(nodes).collect()}
    ranks = {(x.tree_id, x.node_id): x.leaf_rank for x in trees.leaf_ranks(nodes).collect()}
    stats = {x.tree_id: x for x in trees.tree_stats(nodes).collect()}
    assert len(info) == nodes.count() and len(stats) == len(forest)
    for t, rows in forest.items():
        p = Plain(rows)
        for i in p.up:
            assert info[t, i] == (sum(p.length[x] for x in p.way(i)), len(p.leaves(i)))
        assert {i: k for k, i in enumerate(p.leaves())} == {i: k for (u, i), k in ranks.items() if u == t}
        branches = [p.length[i] for i, up in p.up.items() if up is not None]
        assert (stats[t].total, stats[t].leaves) == (sum(branches), len(p.leaves()))
        assert stats[t].mean_branch == pytest.approx(sum(branches) / len(branches) if branches else 0)
        assert stats[t].height == max(info[t, i][0] for i in p.up) - 0.25


def test_pairs(spark, nodes, forest):
    r = random.Random(3)
    pairs = [(t, r.choice(rows)[1], r.choice(rows)[1]) for t, rows in forest.items() for _ in range(4)] + [(0, 999, 998), (5, 0, 999)]
    pairs = list(dict.fromkeys(pairs))
    df = spark.createDataFrame(pairs, "tree_id int, a int, b int")
    got = {(x.tree_id, x.a, x.b): x.dist for x in trees.patristic(nodes, df).collect()}
    met = {}
    for x in trees.paths(nodes, df).collect():
        met.setdefault((x.tree_id, x.a, x.b), set()).add(x.node_id)
    assert len(got) == len(pairs)
    for t, a, b in pairs:
        p = Plain(forest[t])
        if a not in p.up or b not in p.up:
            assert got[t, a, b] is None and (t, a, b) not in met
            continue
        wa, wb = p.way(a), p.way(b)
        shared = [x for x in wa if x in wb]
        assert met[t, a, b] == (set(wa) ^ set(wb)) | {shared[0]}
        assert got[t, a, b] == sum(p.length[x] for x in set(wa) ^ set(wb))


def test_order_of_children_shows_in_ranks(spark, nodes, forest):
    big = max(forest, key=lambda t: len(forest[t]))
    only = nodes.where(F.col("tree_id") == big)
    kids = trees.swapped(trees.ladderize(nodes), Plain(forest[big]).root, big)
    ranks = {x.node_id: x.leaf_rank for x in trees.leaf_ranks(trees.in_order(nodes, kids)).where(F.col("tree_id") == big).collect()}
    p = Plain(forest[big])
    for at, children in p.kids.items():
        if at is not None:
            children.sort(key=lambda i: -len(p.leaves(i)))
    p.kids[p.root].reverse()
    assert ranks == {i: k for k, i in enumerate(p.leaves())}
    assert only.count() == len(forest[big])


def test_reroot_of_many_trees(spark, nodes, forest):
    at = spark.createDataFrame([(t, forest[t][-1][1]) for t in range(0, 100, 2)], "tree_id int, node_id int")
    turned = trees.reroot(nodes, at).collect()
    for t in (0, 2, 4, 5, 98):
        before, after = Plain(forest[t]), {x.node_id: (x.parent_id, x.length) for x in turned if x.tree_id == t}
        assert set(after) == set(before.up)
        root = forest[t][-1][1] if t % 2 == 0 else before.root
        assert after[root][0] is None
        edges = {frozenset((i, p)): before.length[i] for i, p in before.up.items() if p is not None}
        assert edges == {frozenset((i, p)): x for i, (p, x) in after.items() if p is not None}


def test_split_numbers_equal_lists(nodes, forest):
    numbers = {(x.tree_id, x.node_id): (x.split, x.leaves) for x in trees.splits(nodes).collect()}
    lists = {(x.tree_id, x.node_id): tuple(x.split) for x in trees.bipartitions(nodes).collect()}
    assert set(numbers) == set(lists)
    by_name = {}
    for k, names in lists.items():
        assert numbers[k][1] == len(names)
        by_name.setdefault(names, set()).add(numbers[k][0])
    for t, rows in forest.items():
        p = Plain(rows)
        want = {p.split(i) for i in p.kids if i is not None} - {None}
        assert want == {v for (u, _), v in lists.items() if u == t}
    # One number for one side of one set of names, over all trees.
    assert all(len(v) == 1 for v in by_name.values()) and len({n for v in by_name.values() for n in v}) == len(by_name)


def test_equal_names_do_not_cancel(spark):
    rows = [(1, 0, None, 0, None, 0.0, None), (1, 1, 0, 0, None, 1.0, None), (1, 2, 0, 1, "a", 1.0, None), (1, 3, 0, 2, "b", 1.0, None), (1, 4, 1, 0, "x", 1.0, None), (1, 5, 1, 1, "x", 1.0, None)]
    got = trees.splits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(x.node_id, x.leaves) for x in got] == [(1, 2)] and got[0].split != "0" * 32


def test_deep_chain_beside_many_trees(spark):
    n = 5000
    chain = [(-1, i, i - 1 if i else None, 0, "end" if i == n - 1 else None, 0.5, None) for i in range(n)]
    r = random.Random(1)
    many = [x for t in range(1000) for x in random_tree(t, 6, r)]
    df = spark.createDataFrame(chain + many, SCHEMA).cache()
    info = trees.node_info(df)
    assert info.where("tree_id = -1").agg(F.max("depth"), F.min("tips"), F.count("*")).first()[:] == (n / 2, 1, n)
    assert info.where("tree_id >= 0").count() == 6000
    far = trees.patristic(df, spark.createDataFrame([(-1, 3, n - 1)], "tree_id int, a int, b int")).first()
    assert far.dist == (n - 4) / 2


def test_deep_text_and_back(spark):
    n = 300
    df = spark.createDataFrame([(1, i, i - 1 if i else None, 1, "end" if i == n - 1 else None, 0.5, None) for i in range(n)], SCHEMA)
    text = newick.format_newick(df).first().text
    assert text.count("(") == n - 1 and "," not in text
    assert newick.parse_trees(spark.createDataFrame([(1, text)], "tree_id int, text string")).count() == n


def test_a_circle_is_refused(spark, monkeypatch):
    monkeypatch.setattr(trees, "_MOST_ROUNDS", 3)
    df = spark.createDataFrame([(1, 1, 2, 0, None, 1.0, None), (1, 2, 1, 0, None, 1.0, None)], SCHEMA)
    with pytest.raises(ValueError, match="ancestors"):
        trees.node_info(df)


def test_no_trees(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trees.node_info(none).count() == trees.leaf_ranks(none).count() == trees.splits(none).count() == 0
