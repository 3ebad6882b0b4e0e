"""Merkle manifest of documents: a tree for each source, a tree of their roots, proofs by recomputation.

A leaf is the digest of a row's fields. Leaves of a source ascend by doc_id; every ARITY neighbours become
one node, until one is left, the source's subroot. Subroots, by source, become the root in the same way.

Of a tree's levels only the leaves and every STORED-th level above are kept (checkpoints). A stored node
covers an aligned subtree of ARITY ** STORED nodes of the stored level below; a proof's siblings on the
levels between are computed again from those, block by block, handed out and forgotten. A node's way to
the root (its chain: what stands left and right of it on each level) is its own part within its block and
the chain of the stored node above. So each join is between one stored level and the next, whose rows
fall by ARITY ** STORED, and a block is all that a task holds of a source, whatever the source's size.

Nulls, ties and edges: a null field enters a digest as `-`; null ids come first, null sources are a source
of their own, before all others; rows of one id in one source are ordered by their digests, so repeated
rows differ in nothing; an empty table has no root and an empty result; a lone leaf is its subroot, a lone
source's subroot the root; texts of any length are read once and never shuffled; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.llm.common import materialize, table

ARITY = 3
#: Levels from one stored level to the next.
STORED = 4
BLOCK = ARITY**STORED

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _framed(value: Column) -> Column:
    """The value as a digest takes it: `-` for null, else its bytes behind their number."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row's FIELDS, some of them exchanged."""
    return F.sha2(F.concat(*[_framed(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def _group(source: Column) -> Column:
    """A key that is never null; the null source sorts before all others."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with `pos`, a row's place in its group from 0, and `n`, the group's rows.

    Rows are dealt by range over group and order and numbered where they lie; what a part of a group
    lacks is a sum over the parts before it (a row for each group and partition it touches).
    """
    cols = df.columns
    at = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id())
    at = materialize(at, "ordered").withColumn("_part", F.shiftright("_id", 33))
    parts = at.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    of = W.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of).alias("n")), "parts")
    return at.join(parts, [group, "_part"]).select(*cols, (F.col("_id") + F.col("_shift")).alias("pos"), "n")


def _above(nodes: Column) -> Column:
    """Digests of every ARITY neighbours."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), ""), 256))


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """(g, pos, n, members, levels, d): blocks of a stored level (g, pos, n, d, more).

    pos and n number the blocks, d is the digest over each. levels are the digests of the block's
    levels below that, from its members' own upwards. A tree's last block ends where one node is left.
    """
    member = F.struct("pos", "d", *more)
    df = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))
    none = F.array().cast("array<array<string>>")
    start = F.struct(none.alias("levels"), F.transform("members", lambda m: m["d"]).alias("now"))
    ended = lambda x: (F.col("n") <= BLOCK) & (F.size(x["now"]) == 1)
    step = lambda x, _: F.when(ended(x), x).otherwise(F.struct(F.array_append(x["levels"], x["now"]).alias("levels"), _above(x["now"]).alias("now")))
    df = df.withColumn("tree", F.aggregate(F.sequence(F.lit(1), F.lit(STORED)), start, step))
    return df.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), "members", "tree.levels", F.col("tree.now")[0].alias("d"))


def stored_levels(nodes: DataFrame) -> list[DataFrame]:
    """The stored levels (g, pos, n, d) of the trees over nodes of that form; the last holds a root for each g."""
    levels = [nodes]
    while True:
        levels.append(materialize(_blocks(levels[-1]).select("g", "pos", "n", "d"), "level"))
        if levels[-1].where("n > 1").isEmpty():
            return levels


def _beside(levels: Column, at: Column) -> Column:
    """For each level what stands left and right of the member's way, from the bottom upwards."""
    steps = F.array(*[F.lit(ARITY**k) for k in range(STORED)])

    def of(nodes: Column, k: Column) -> Column:
        own = F.floor(at / F.element_at(steps, k + 1)).cast("int")
        first = own - own % ARITY
        return F.struct(F.array_join(F.slice(nodes, first + 1, own - first), "").alias("l"), F.array_join(F.slice(nodes, own + 2, first + ARITY - own - 1), "").alias("r"))

    return F.transform(levels, of)


def chained(levels: list[DataFrame], top: DataFrame, *more: str) -> DataFrame:
    """(g, d, chain, more...) of the lowest stored level, by the chains above: top (g, above, more...).

    From level to level the blocks' inner nodes are made again from the stored ones.
    """
    chains = top.withColumn("pos", F.lit(0).cast("long"))
    for depth, level in reversed(list(enumerate(levels[:-1]))):
        extra = [c for c in level.columns if c not in ("g", "pos", "n", "d")]
        blocks = _blocks(level, *extra).select("g", "pos", "members", "levels").join(chains, ["g", "pos"])
        each = F.transform("members", lambda m, i: F.struct(m["pos"].alias("pos"), m["d"].alias("d"), *[m[c].alias(c) for c in extra], _beside(F.col("levels"), i).alias("own")))
        rows = blocks.select("g", F.inline(each), "above", *more).withColumn("above", F.concat("own", "above"))
        chains = rows.select("g", "d", F.col("above").alias("chain"), *extra, *more) if depth == 0 else materialize(rows.select("g", "pos", "above", *more), "chains")
    return chains


def folded(leaf: Column, chain: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(chain, leaf, lambda d, x: F.sha2(F.concat(x["l"], d, x["r"]), 256))


def manifest(docs: DataFrame, shown: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, chain, shown) per row; shown is a leaf to check, by default the row's."""
    leaf = leaf_digest()
    rows = docs.select("doc_id", "source", _group(F.col("source")).alias("g"), leaf.alias("d"), (leaf if shown is None else shown).alias("shown"))
    trees = stored_levels(numbered(rows, "g", "doc_id", "d"))
    subroots = trees[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), "d")
    whole = stored_levels(materialize(numbered(subroots, "g", "key"), "subroots"))
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    over = chained(whole, whole[-1].select("g", nothing.alias("above"), F.col("d").alias("root")), "root")
    top = over.select(F.col("key").alias("g"), F.col("chain").alias("above"), F.col("d").alias("subroot"), "root")
    df = chained(trees, materialize(top, "tops"), "subroot", "root")
    return df.select("doc_id", "source", F.col("d").alias("leaf"), "subroot", "root", "chain", "shown")


def without_line_feeds() -> Column:
    """The leaf of each row once a tamperer has taken the line feeds from the texts of every second id (by crc32)."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(hit, leaf_digest(text=F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf_digest())


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = manifest(table(spark, sf_dir, "documents"), without_line_feeds())
    siblings = F.array_join(F.transform("chain", lambda x: F.concat(x["l"], x["r"])), "")
    df = df.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("shown"), F.col("chain")).alias("folded_root"))
    return df.withColumn("verified", F.col("folded_root") == F.col("root"))


_FRAMED = lambda x: f"coalesce(octet_length(encode({x}::varchar))::varchar || ':' || {x}::varchar, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FRAMED(text if c == "text" else c) for c in FIELDS) + ")"


def _tree_sql(name: str, base: str) -> str:
    """CTEs of the levels (g, l, pos, d, n) over base (g, pos, d, n), and of what stands beside each node."""
    return f"""
{name} as (select g, 0 as l, pos, d, n from {base}
  union all select g, l + 1, pos // {ARITY}, sha256(string_agg(d, '' order by pos)), (n + {ARITY - 1}) // {ARITY} from {name} where n > 1 group by g, l, pos // {ARITY}, n),
{name}_beside as (select a.g, a.l, a.pos, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos < a.pos), '') as lhs, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos > a.pos), '') as rhs
  from {name} a join {name} b on a.g = b.g and a.l = b.l and a.pos // {ARITY} = b.pos // {ARITY} where a.n > 1 group by all)"""


SQL = f"""
with recursive lf as (select doc_id, coalesce('=' || source, '-') as g, {_LEAF("text")} as d,
    case when list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
      lambda c, b: list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)), 4294967295::bigint) % 2 = 1
    then {_LEAF("replace(text, chr(10), '')")} else {_LEAF("text")} end as shown from documents),
nl as (select *, row_number() over (partition by g order by doc_id nulls first, d) - 1 as pos, count(*) over (partition by g) as n from lf),
{_tree_sql("tr", "nl")},
sr as (select '' as g, g as key, d, row_number() over (order by encode(g)) - 1 as pos, count(*) over () as n from tr where n = 1),
{_tree_sql("rt", "sr")},
up as (select nl.doc_id, nl.g, nl.pos as leaf_pos, d as leaf, 0 as l, pos, shown, '' as proof from nl
  union all select doc_id, up.g, leaf_pos, leaf, up.l + 1, up.pos // {ARITY}, sha256(lhs || shown || rhs), proof || lhs || rhs from up join tr_beside b on b.g = up.g and b.l = up.l and b.pos = up.pos),
mid as (select up.doc_id, leaf, sr.d as subroot, 0 as l, sr.pos, shown, proof, up.g, leaf_pos from up join sr on sr.key = up.g join (select g, max(l) as l from tr group by g) h on h.g = up.g and h.l = up.l),
fin as (select * from mid
  union all select doc_id, leaf, subroot, fin.l + 1, fin.pos // {ARITY}, sha256(lhs || shown || rhs), proof || lhs || rhs, fin.g, leaf_pos from fin join rt_beside b on b.l = fin.l and b.pos = fin.pos)
select doc_id, leaf, subroot, rt.d as root, sha256(proof) as proof_sha256, shown as folded_root, shown = rt.d as verified
from fin join rt on rt.n = 1 and rt.l = fin.l"""
