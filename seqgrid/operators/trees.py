"""Trees as node tables (tree_id, node_id, parent_id, child_ix, name, length, support), many at once.

Nodes point at an ancestor; each round sends the pointers on to what their ancestors point at, so their
reach doubles and the rounds grow with the logarithm of the deepest tree. Sums over a node's way to the
root and over its subtree grow in the same rounds. No table of all ancestors is made, and nothing recurs.

tree_id may be left out where there is one tree; it is never null. Children are in the order of child_ix,
or of node_id where that column is absent. A node whose parent isn't in the table is a root.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.functions.lineage import cut
from seqgrid.operators.listing import digests

#: Aggregate of what lies below a node, and how it joins the node's own value.
_JOINED = {
    "sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))),
    "max": (F.max, F.greatest),
}
#: Rounds after which parents can only go round in a circle.
_MOST_ROUNDS = 40


def geo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, regions, nations and suppliers as one tree."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "supplier")}
    edge = lambda k: ((F.col(k) % 7 + 1) * 0.5).alias("length")
    id_ = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    root = spark.range(1).select(F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("length"))
    return (
        root.unionByName(t["region"].select(id_("r", "r_regionkey").alias("node_id"), F.lit("root").alias("parent_id"), edge("r_regionkey")))
        .unionByName(t["nation"].select(id_("n", "n_nationkey").alias("node_id"), id_("r", "n_regionkey").alias("parent_id"), edge("n_nationkey")))
        .unionByName(t["supplier"].select(id_("s", "s_suppkey").alias("node_id"), id_("n", "s_nationkey").alias("parent_id"), edge("s_suppkey")))
    )


def _tree(nodes: DataFrame) -> list[str]:
    return [c for c in ("tree_id",) if c in nodes.columns]


def _place(nodes: DataFrame) -> str:
    return "child_ix" if "child_ix" in nodes.columns else "node_id"


def lift(nodes: DataFrame, above: dict[str, Column] | None = None, below: dict[str, tuple[Column, str]] | None = None, with_jumps: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """((tree_id, node_id, sums), jumps): sums over each node's way to the root and over its subtree.

    above: name -> a node's own value, added up over the node and all its ancestors. below: name -> (own
    value, kind), over the node and all below it, kind being sum, xor or max. jumps[k] (tree_id, node_id,
    anc) holds the ancestors 2 ** k steps up of the nodes that have one, if they are asked for.
    """
    above, below = above or {}, below or {}
    tree = _tree(nodes)
    key = [*tree, "node_id"]
    own = [v.alias(c) for c, v in above.items()] + [v.alias(c) for c, (v, _) in below.items()]
    state = cut(nodes.select(*key, F.col("parent_id").alias("anc"), *own))
    jumps: list[DataFrame] = []
    for _ in range(_MOST_ROUNDS):
        met = state.where("anc is not null")
        if met.isEmpty():
            return state.drop("anc"), jumps
        hop = state.select(*tree, F.col("node_id").alias("anc"), F.col("anc").alias("_anc"), F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in above])
        df = state.join(hop, [*tree, "anc"], "left")
        if with_jumps:
            jumps.append(cut(df.where("_known").select(*key, "anc")))
        grown = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in above]
        if below:
            under = met.groupBy(*tree, F.col("anc").alias("node_id")).agg(*[_JOINED[kind][0](c).alias(f"_{c}") for c, (_, kind) in below.items()])
            df = df.join(under, key, "left")
            grown += [_JOINED[kind][1](F.col(c), F.col(f"_{c}")).alias(c) for c, (_, kind) in below.items()]
        state = cut(df.select(*key, F.col("_anc").alias("anc"), *grown))
    raise ValueError("nodes are their own ancestors")


def with_leaf(nodes: DataFrame) -> DataFrame:
    """Nodes with `leaf`, whether no node has them as parent."""
    key = [*_tree(nodes), "node_id"]
    inner = nodes.where("parent_id is not null").select(*_tree(nodes), F.col("parent_id").alias("node_id"), F.lit(True).alias("_inner")).distinct()
    return nodes.join(inner, key, "left").withColumn("leaf", F.col("_inner").isNull()).drop("_inner")


def _length() -> Column:
    return F.coalesce("length", F.lit(0.0))


def node_info(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, depth, tips, support): length from the root, its own included, and leaves under a node."""
    found, _ = lift(with_leaf(nodes), {"depth": _length()}, {"tips": (F.col("leaf").cast("long"), "sum")})
    if "support" in nodes.columns:
        found = found.join(nodes.select(*_tree(nodes), "node_id", "support"), [*_tree(nodes), "node_id"])
    return found


def tree_stats(nodes: DataFrame) -> DataFrame:
    """(tree_id, total, mean_branch, leaves, height) of each tree, the root's branch left out; 0 without branches."""
    tree = _tree(nodes)
    edge = F.when(F.col("parent_id").isNotNull(), _length())
    nodes = with_leaf(nodes)
    depth, _ = lift(nodes, {"depth": F.coalesce(edge, F.lit(0.0))})
    size = [F.coalesce(F.sum(edge), F.lit(0.0)).alias("total"), F.coalesce(F.avg(edge), F.lit(0.0)).alias("mean_branch"), F.sum(F.col("leaf").cast("long")).alias("leaves")]
    return nodes.join(depth, [*tree, "node_id"]).groupBy(*tree).agg(*size, F.max("depth").alias("height"))


def lowest_common(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """((pairs, lca, level_a, level_b, level_lca), (node, depth, level), jumps) of pairs (tree_id, a, b).

    The deeper node of a pair climbs to the other's level, then both climb by halving steps as long as
    they differ. lca is null where a node is unknown or the two have no common ancestor.
    """
    tree = _tree(nodes)
    found, jumps = lift(nodes, {"depth": _length(), "level": F.lit(1).cast("long")}, with_jumps=True)
    level = lambda node, name: found.select(*tree, F.col("node_id").alias(node), F.col("level").alias(name))
    pairs = pairs.select(*tree, "a", "b").distinct()
    df = pairs.join(level("a", "level_a"), [*tree, "a"]).join(level("b", "level_b"), [*tree, "b"])
    first = F.col("level_a") >= F.col("level_b")
    df = df.select(*tree, "a", "b", "level_a", "level_b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"), F.abs(F.col("level_a") - F.col("level_b")).alias("gap"))
    step = lambda k, node: jumps[k].select(*tree, F.col("node_id").alias(node), F.col("anc").alias(f"_{node}"))
    for k in reversed(range(len(jumps))):
        far = F.col("gap") >= 2**k
        df = df.join(step(k, "x"), [*tree, "x"], "left").withColumn("x", F.when(far, F.col("_x")).otherwise(F.col("x"))).withColumn("gap", F.when(far, F.col("gap") - 2**k).otherwise(F.col("gap"))).drop("_x")
        df = cut(df)
    for k in reversed(range(len(jumps))):
        df = df.join(step(k, "x"), [*tree, "x"], "left").join(step(k, "y"), [*tree, "y"], "left")
        apart = F.coalesce(F.col("_x") != F.col("_y"), F.lit(False))
        df = cut(df.withColumns({"x": F.when(apart, F.col("_x")).otherwise(F.col("x")), "y": F.when(apart, F.col("_y")).otherwise(F.col("y"))}).drop("_x", "_y"))
    df = df.join(step(0, "x"), [*tree, "x"], "left") if jumps else df.withColumn("_x", F.lit(None))
    df = df.withColumn("lca", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("_x")))
    df = df.drop("x", "y", "_x", "gap").join(level("lca", "level_lca"), [*tree, "lca"], "left")
    return df, found, jumps


def patristic(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree_id, a, b, dist) of pairs of nodes: branches between them through their last common ancestor.

    0 for a node with itself, null for unknown nodes.
    """
    tree = _tree(nodes)
    met, found, _ = lowest_common(nodes, pairs)
    for side in ("a", "b", "lca"):
        met = met.join(found.select(*tree, F.col("node_id").alias(side), F.col("depth").alias(f"d_{side}")), [*tree, side], "left")
    way = met.select(*tree, "a", "b", (F.col("d_a") + F.col("d_b") - 2 * F.col("d_lca")).alias("dist"))
    out = pairs.select(*tree, "a", "b").join(way, [*tree, "a", "b"], "left")
    return out.withColumn("dist", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("dist")))


def chains(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, level, chain, pos, up, top): ways down that follow the largest subtree, so few of them make up any path.

    A node is at place pos of its chain, from 0; up is the parent of the chain's first node, null at a root, top that
    node's level.
    """
    tree = _tree(nodes)
    key = [*tree, "node_id"]
    one = F.lit(1).cast("long")
    found, _ = lift(nodes, {"level": one}, {"size": (one, "sum")})
    base = cut(nodes.select(*key, "parent_id").join(found, key).withColumn("_nr", F.monotonically_increasing_id() + 1))
    largest = base.groupBy(*tree, "parent_id").agg(F.max(F.struct("size", "node_id"))["node_id"].alias("node_id"))
    parents = base.select(*tree, F.col("node_id").alias("parent_id"))
    follows = largest.join(parents, [*tree, "parent_id"], "left_semi").select(*key, F.lit(True).alias("_follows"))
    marked = base.join(follows, key, "left")
    linked = marked.select(*key, F.when(F.col("_follows"), F.col("parent_id")).alias("parent_id"), F.when(F.col("_follows"), 0).otherwise(F.col("_nr")).alias("_first"))
    placed, _ = lift(linked, {"pos": one, "chain": F.col("_first")})
    df = cut(base.select(*key, "parent_id", "level").join(placed, key).withColumn("pos", F.col("pos") - 1))
    tops = df.where("pos = 0").select(*tree, "chain", F.col("parent_id").alias("up"), F.col("level").alias("top"))
    return cut(df.drop("parent_id").join(tops, [*tree, "chain"]))


def path_ranges(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree_id, a, b, ranges): the stretches (list, lo, hi) of `chains` that make up the path of each pair.

    The end whose chain starts lower climbs to the node above that chain until both ends are in one. Pairs of an
    unknown node or without a common ancestor are left out.
    """
    tree = _tree(placed)
    info = ["chain", "pos", "up", "top"]
    of = lambda node, name: placed.select(*tree, F.col("node_id").alias(node), *[F.col(c).alias(f"{name}_{c}") for c in info])
    stretch = lambda chain, lo, hi: F.array(F.struct(F.col(chain).alias("list"), lo.alias("lo"), hi.alias("hi")))
    df = pairs.select(*tree, "a", "b").distinct().join(of("a", "x"), [*tree, "a"]).join(of("b", "y"), [*tree, "b"])
    df = cut(df.withColumn("ranges", F.expr("cast(array() as array<struct<list:bigint,lo:bigint,hi:bigint>>)")))
    out = None
    while True:
        met = df.where("x_chain = y_chain")
        met = met.select(*tree, "a", "b", F.concat("ranges", stretch("x_chain", F.least("x_pos", "y_pos"), F.greatest("x_pos", "y_pos"))).alias("ranges"))
        out = met if out is None else out.unionByName(met)
        df = df.where("x_chain != y_chain")
        if df.isEmpty():
            return out
        first = F.col("x_top") >= F.col("y_top")
        zero = F.lit(0).cast("long")
        climbed = F.when(first, stretch("x_chain", zero, F.col("x_pos"))).otherwise(stretch("y_chain", zero, F.col("y_pos")))
        df = df.withColumn("_first", first).withColumn("ranges", F.concat("ranges", climbed)).withColumn("_up", F.when(first, F.col("x_up")).otherwise(F.col("y_up")))
        df = df.join(of("_up", "n"), [*tree, "_up"])
        moved = {f"{s}_{c}": F.when(F.col("_first") == (s == "x"), F.col(f"n_{c}")).otherwise(F.col(f"{s}_{c}")) for s in "xy" for c in info}
        df = cut(df.withColumns(moved).select(*tree, "a", "b", "ranges", *[f"{s}_{c}" for s in "xy" for c in info]))


def paths(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree_id, a, b, node_id): nodes from a to b through their last common ancestor, all three included."""
    tree = _tree(nodes)
    placed = chains(nodes)
    steps = path_ranges(placed, pairs).select(*tree, "a", "b", F.inline("ranges")).select(*tree, "a", "b", F.col("list").alias("chain"), F.explode(F.sequence("lo", "hi")).alias("pos"))
    return steps.join(placed.select(*tree, "chain", "pos", "node_id"), [*tree, "chain", "pos"]).select(*tree, "a", "b", "node_id")


def path_digests(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree_id, a, b, n, digest): how many nodes `paths` gives, and the MD5 of their names in order; no row is made for a step."""
    tree = _tree(nodes)
    placed = chains(nodes)
    members = placed.select(*tree, F.col("chain").alias("list"), "pos", F.col("node_id").alias("name"))
    return digests(path_ranges(placed, pairs), members, tree)


def ladderize(nodes: DataFrame, largest_first: bool = True) -> DataFrame:
    """(tree_id, node_id, parent_id, child_ix): children by their tips, in their order where equal."""
    tree = _tree(nodes)
    found, _ = lift(with_leaf(nodes), below={"tips": (F.col("leaf").cast("long"), "sum")})
    tips = F.col("tips").desc() if largest_first else F.col("tips")
    order = W.partitionBy(*tree, "parent_id").orderBy(tips, _place(nodes))
    df = nodes.join(found, [*tree, "node_id"]).where("parent_id is not null")
    return df.select(*tree, "node_id", "parent_id", (F.row_number().over(order) - 1).alias("child_ix"))


def swapped(children: DataFrame, node_id: object, tree_id: object = None) -> DataFrame:
    """Children (tree_id, node_id, parent_id, child_ix) with the order under one node of a tree reversed."""
    tree = _tree(children)
    last = F.max("child_ix").over(W.partitionBy(*tree, "parent_id"))
    at = F.col("parent_id") == F.lit(node_id)
    if tree_id is not None:
        at &= F.col("tree_id") == F.lit(tree_id)
    return children.withColumn("child_ix", F.when(at, last - F.col("child_ix")).otherwise(F.col("child_ix")))


def in_order(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Nodes with the child_ix of children, as `ladderize` and `swapped` give them."""
    tree = _tree(nodes)
    return nodes.drop("child_ix").join(children.select(*tree, "node_id", "child_ix"), [*tree, "node_id"], "left").withColumn("child_ix", F.coalesce("child_ix", F.lit(0)))


def reroot(nodes: DataFrame, at: object) -> DataFrame:
    """(tree_id, node_id, parent_id, length) with the edges from a node to the root turned; lengths stay on edges.

    at: a node, or a table (tree_id, node_id) with a node for each tree to turn; other trees stay.
    """
    tree = _tree(nodes)
    key = [*tree, "node_id"]
    chosen = at.select(*key) if isinstance(at, DataFrame) else nodes.where(F.col("node_id") == F.lit(at)).select(*key)
    marked = nodes.join(chosen.withColumn("_at", F.lit(1)), key, "left")
    found, _ = lift(marked, below={"way": (F.coalesce("_at", F.lit(0)), "max")})
    df = marked.join(found, key)
    turned = df.where("way = 1 and parent_id is not null").select(*tree, F.col("parent_id").alias("node_id"), F.col("node_id").alias("parent_id"), "length")
    top = df.where("_at = 1").select(*tree, "node_id", F.lit(None).cast(dict(nodes.dtypes)["parent_id"]).alias("parent_id"), F.lit(0.0).alias("length"))
    return df.where("way = 0").select(*tree, "node_id", "parent_id", "length").unionByName(turned).unionByName(top)


def spans(nodes: DataFrame) -> DataFrame:
    """Nodes with leaf, size, tips, enter and leaf_rank: the nodes and leaves of its subtree, and how many
    nodes and leaves come before it in its tree's order. A subtree's leaves are leaf_rank to leaf_rank + tips."""
    tree = _tree(nodes)
    key = [*tree, "node_id"]
    nodes = with_leaf(nodes)
    found, _ = lift(nodes, below={"size": (F.lit(1).cast("long"), "sum"), "tips": (F.col("leaf").cast("long"), "sum")})
    nodes = nodes.join(found, key)
    earlier = W.partitionBy(*tree, "parent_id").orderBy(_place(nodes)).rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.when(F.col("parent_id").isNotNull(), F.coalesce(F.sum(c).over(earlier), F.lit(0))).otherwise(F.lit(0))
    placed = cut(nodes.withColumn("_nodes", before("size") + F.col("parent_id").isNotNull().cast("long")).withColumn("_leaves", before("tips")))
    order, _ = lift(placed, {"enter": F.col("_nodes"), "leaf_rank": F.col("_leaves")})
    return placed.drop("_nodes", "_leaves").join(order, key)


def leaf_ranks(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, leaf_rank): leaves in their tree's order."""
    return spans(nodes).where("leaf").select(*_tree(nodes), "node_id", "leaf_rank")


def supported(nodes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Nodes with `strong`: whether their support reaches the threshold, held within 0 and 1."""
    return nodes.withColumn("strong", F.col("support") >= min(max(threshold, 0.0), 1.0))


def _names_at(at: DataFrame, nodes: DataFrame, ranks: Callable[[], Column], name: str) -> DataFrame:
    """(tree_id, node_id, name): for each row of at the sorted names of the leaves of its ranks."""
    leaves = nodes.where("leaf").select("tree_id", F.col("leaf_rank").alias("_rank"), "name")
    each = at.select("tree_id", "node_id", F.explode(ranks()).alias("_rank"))
    return each.join(leaves, ["tree_id", "_rank"]).groupBy("tree_id", "node_id").agg(F.sort_array(F.collect_list("name")).alias(name))


def _range(start: Column, end: Column) -> Column:
    """Whole numbers from start to before end."""
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))


def clades(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, leaves): the sorted leaf names under each inner node."""
    df = cut(spans(nodes))
    return _names_at(df.where("not leaf"), df, lambda: _range(F.col("leaf_rank"), F.col("leaf_rank") + F.col("tips")), "leaves")


def splits(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, split, leaves): each inner branch's side without the first leaf by name, as 128 bits.

    A leaf is a random number of its name (and of how many leaves of that name come before it); a side is
    the sum of its leaves bit by bit. So sides are compared as numbers, and a node never lists its leaves.
    Trivial splits are left out. Of nodes with one split, as both children of a root, the later one keeps it.
    """
    nodes = with_leaf(nodes)
    nth = F.row_number().over(W.partitionBy("tree_id", "leaf", "name").orderBy("node_id"))
    nodes = nodes.select("tree_id", "node_id", "parent_id", "leaf", "name", F.when(F.col("leaf"), nth).alias("_nth"))
    mark = lambda seed: F.when(F.col("leaf"), F.xxhash64("name", "_nth", F.lit(seed))).otherwise(F.lit(0).cast("long"))
    name = F.struct(F.col("name").isNotNull(), "name", "_nth")
    nodes = nodes.withColumn("_high", mark(1)).withColumn("_low", mark(2)).withColumn("_name", name)
    whole = nodes.where("leaf").groupBy("tree_id").agg(F.bit_xor("_high").alias("_all_high"), F.bit_xor("_low").alias("_all_low"), F.count("*").alias("_n"), F.min("_name").alias("_least"))
    nodes = cut(nodes.join(whole, "tree_id"))
    first = (F.col("leaf") & (F.col("_name") == F.col("_least"))).cast("int")
    below = {"high": (F.col("_high"), "xor"), "low": (F.col("_low"), "xor"), "tips": (F.col("leaf").cast("long"), "sum"), "first": (first, "max")}
    found, _ = lift(nodes, below=below)
    df = found.join(nodes.where("not leaf").select("tree_id", "node_id", "_all_high", "_all_low", "_n"), ["tree_id", "node_id"]).where("tips between 2 and _n - 2")
    side = lambda c: F.when(F.col("first") == 1, F.col(c).bitwiseXOR(F.col(f"_all_{c}"))).otherwise(F.col(c))
    size = F.when(F.col("first") == 1, F.col("_n") - F.col("tips")).otherwise(F.col("tips"))
    df = df.select("tree_id", "node_id", F.concat(F.lpad(F.hex(side("high")), 16, "0"), F.lpad(F.hex(side("low")), 16, "0")).alias("split"), size.alias("leaves"))
    return df.groupBy("tree_id", "split").agg(F.max(F.struct("node_id", "leaves")).alias("x")).select("tree_id", "x.node_id", "split", "x.leaves")


def _sides(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tree_id, node_id, leaves, ranges), nodes with spans): the stretches of leaf_rank that make up each split's side."""
    df = cut(spans(nodes))
    least = df.where("leaf").groupBy("tree_id").agg(F.min_by("leaf_rank", F.struct("name", "node_id")).alias("_first"), (F.max("leaf_rank") + 1).alias("_n"))
    at = df.join(splits(nodes).select("tree_id", "node_id", "leaves"), ["tree_id", "node_id"]).join(least, "tree_id")
    start, end = F.col("leaf_rank"), F.col("leaf_rank") + F.col("tips")
    stretch = lambda lo, hi: F.struct(F.lit(0).cast("long").alias("list"), lo.cast("long").alias("lo"), (hi - 1).cast("long").alias("hi"))
    other = F.array(stretch(F.lit(0), start), stretch(end, F.col("_n")))
    ranges = F.when((F.col("_first") >= start) & (F.col("_first") < end), other).otherwise(F.array(stretch(start, end)))
    return at.select("tree_id", "node_id", "leaves", F.filter(ranges, lambda r: r["lo"] <= r["hi"]).alias("ranges")), df


def bipartitions(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, split): `splits` with the sorted names of their leaves."""
    at, df = _sides(nodes)
    return _names_at(at, df, lambda: F.flatten(F.transform("ranges", lambda r: F.sequence(r["lo"], r["hi"]))), "split")


def split_digests(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, leaves, digest): the MD5 of what `bipartitions` lists, with no row for a name of a side."""
    at, df = _sides(nodes)
    members = df.where("leaf").select("tree_id", F.lit(0).cast("long").alias("list"), F.col("leaf_rank").alias("pos"), "name")
    return digests(at, members, ["tree_id"]).select("tree_id", "node_id", "leaves", "digest")


def with_support(nodes: DataFrame, replicates: DataFrame, n: int) -> DataFrame:
    """Nodes with support: the share of n replicate trees (tree_id, rep, ...) that hold the node's split."""
    own = splits(nodes)
    made = splits(replicates.withColumn("tree_id", F.struct("tree_id", "rep")))
    seen = made.groupBy(F.col("tree_id.tree_id").alias("tree_id"), "split").agg(F.count("*").alias("times"))
    met = own.join(seen, ["tree_id", "split"], "left").select("tree_id", "node_id", (F.coalesce("times", F.lit(0)) / F.lit(float(n))).alias("_share"))
    return nodes.drop("support").join(met, ["tree_id", "node_id"], "left").withColumnRenamed("_share", "support")
