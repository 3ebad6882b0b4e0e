"""Queries of groups, partners, bootstrap draws, parts of alignments and leaf orders, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.functions.residues import CLASS_OF
from seqgrid.operators import bootstrap, clustering, features, groups, identity, motif, rows, trees, variants
from seqgrid.operators import cells as c
from seqgrid.plans.bridge import SQL, sequences
from seqgrid.plans.more import _CODE, _R, _TREE, _VARIANTS, _case, rounded, variant_rows
from seqgrid.plans.queries import _PAIRS

REPLICATES, SEED = 4, 42


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def silhouettes(spark: SparkSession, d: str) -> DataFrame:
    """How well the vectors of each label part by the remainder of their id by 3."""
    parts = F.array((F.col("vec_id") % 3).cast("int")).alias("clusters")
    rows = _vectors(spark, d).select(F.col("label").alias("aln_id"), F.col("vec_id").alias("row_ix"), F.col("embedding").cast("array<double>").alias("v"), parts)
    return rounded(clustering.silhouettes(rows).select(F.col("aln_id").alias("label"), "silhouette"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    return groups.kmeans(v, 4).withColumnRenamed("i", "vec_id")


def partners(spark: SparkSession, d: str) -> DataFrame:
    return identity.row_partners(sequences(spark, d))


def bootstrap_draws(spark: SparkSession, d: str) -> DataFrame:
    widths = sequences(spark, d).groupBy("aln_id").agg(F.max(F.length("aligned")).alias("width"))
    drawn = bootstrap.draws(widths, REPLICATES, SEED)
    return drawn.groupBy("aln_id", "rep").agg(F.count("*").alias("columns"), F.sum(F.col("col") * F.col("times")).alias("places"), F.max("times").alias("most"))


def motif_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d)
    return rows.coverage(motif.aligned_matches(s.where("aln_id is not null"), "A{1,2}N"), s)


def external_scores(spark: SparkSession, d: str) -> DataFrame:
    v = variant_rows(spark, d)
    given = v.where("ord % 2 = 0").withColumns({"score": (F.col("ord") * 37 % 140 - 20).cast("double"), "confidence": (F.col("ord") % 10) / F.lit(10.0)})
    return rounded(rows.with_external(v.select("ord", "seq_name", "position", "to_aa"), given)).withColumn("foldable", rows.foldable(F.col("to_aa")))


def lca_paths(spark: SparkSession, d: str) -> DataFrame:
    """Nodes between each supplier and the next one."""
    k = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    pairs = k.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("a"), F.concat(F.lit("s"), (F.col("k") + 1).cast("string")).alias("b"))
    return trees.paths(trees.geo_tree(spark, d), pairs)


def queries() -> dict:
    return {
        "silhouettes": silhouettes,
        "kmeans_clusters": clusters,
        "best_partners": partners,
        "group_table": lambda s, d: groups.group_table(sequences(s, d)),
        "representatives": lambda s, d: groups.representatives(sequences(s, d)).select("aln_id", "row_ix", "grp", F.md5("aligned").alias("aligned")),
        "bootstrap_draws": bootstrap_draws,
        "slice_rows": lambda s, d: rows.slice_rows(sequences(s, d), (10, 100_000), (5, 600)).select("row_ix", F.md5("aligned").alias("aligned")),
        "class_counts": lambda s, d: rows.class_counts(c.to_cells(sequences(s, d))),
        "motif_coverage": motif_coverage,
        "cell_variants": lambda s, d: rows.cell_variants(variants.placed(variant_rows(s, d), sequences(s, d)), "ord"),
        "external_scores": external_scores,
        "leaf_ranks": lambda s, d: trees.leaf_ranks(trees.geo_tree(s, d)),
        "lca_paths": lca_paths,
    }


def oracle_sql() -> dict:
    part = lambda f, order, where: f"first(j order by {order}) filter (where {where}) as {f}"
    within = "coalesce(gi = gj, false)"
    picks = ", ".join(
        part(f"{name}_{p}", f"pct {way}, j", where)
        for name, way in (("closest", "desc"), ("farthest", "asc"))
        for p, where in (("all", "true"), ("within", within), ("outside", f"not {within}"))
    )
    times = lambda x, y: f"((({x}) & 65535) * ({y}) + ((((({x}) >> 16) * ({y})) & 65535) << 16)) & 4294967295"
    return {
        "silhouettes": "with p as (select a.label, a.vec_id as i, b.vec_id % 3 as c, list_distance(a.embedding::double[], b.embedding::double[]) as d from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id),"
        " m as (select label, i, c, avg(d) as d from p group by all), s as (select label, i, min(d) filter (c = i % 3) as a, min(d) filter (c <> i % 3) as b from m group by all)"
        f" select e.label, {_R('case when count(b) = 0 then -1 else avg(case when a is null or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end) end', 'silhouette')} from embeddings e left join s on e.label = s.label and e.vec_id = s.i group by e.label",
        "best_partners": SQL + f", {_PAIRS}, bw as (select aln_id, i, j, pct from pp union all select aln_id, j, i, pct from pp),"
        " gg as (select bw.*, a.grp as gi, b.grp as gj from bw join seqs a on a.aln_id = bw.aln_id and a.row_ix = i join seqs b on b.aln_id = bw.aln_id and b.row_ix = j)"
        f" select aln_id, i as row_ix, {picks} from gg group by aln_id, i",
        "group_table": SQL + " select aln_id, grp, count(*) as size, min(row_ix) as first_row from seqs where grp is not null group by all",
        "representatives": SQL + " select aln_id, row_ix, grp, md5(aligned) as aligned from (select *, row_number() over (partition by aln_id, grp order by row_ix) as k from seqs where grp is not null) where k = 1 and aln_id is not null",
        "bootstrap_draws": SQL + f""", wd as (select aln_id, max(length(aligned))::bigint as width from seqs group by 1),
rp as (select *, unnest(range(0, {REPLICATES}))::int as rep from wd), ek as (select *, unnest(range(1, width + 1)) as k from rp),
e1 as (select aln_id, width, rep, ({SEED} + (rep * width + k) * {bootstrap.STEP}) & 4294967295 as a from ek),
e2 as (select *, {times("xor(a, a >> 15)", "a | 1")} as t from e1),
e3 as (select *, xor((t + ({times("xor(t, t >> 7)", "t | 61")})) & 4294967295, t) as u from e2),
e4 as (select aln_id, rep, floor(xor(u, u >> 14) / 4294967296.0::double * width)::int as col, count(*) as times from e3 group by all)
select aln_id, rep, count(*) as columns, sum(col * times)::bigint as places, max(times) as most from e4 group by all""",
        "slice_rows": SQL + " select row_ix, md5(substr(aligned, 6, 596)) as aligned from seqs where row_ix between 10 and 100000",
        "class_counts": SQL + f" select aln_id, {_case(CLASS_OF, 'code')} as cls, count(*) as residues from cells where code > 0 group by all",
        "motif_coverage": SQL + r", rm as (select aln_id, row_ix, grp, col, row_number() over (partition by aln_id, row_ix order by col) - 1 as r from cells where code > 0), u as (select aln_id, row_ix, string_split(regexp_replace(replace(aligned, '-', ''), '(A{1,2}N)', '<\1>', 'g'), '<') as parts from seqs), x as (select *, unnest(range(2, len(parts) + 1)) as k from u),"
        " m as (select aln_id, row_ix, length(replace(array_to_string(parts[1:k - 1], ''), '>', '')) as s, s + instr(parts[k], '>') - 2 as e from x)"
        " select m.aln_id, f.grp, g.col, count(*) as matches from (select m.aln_id, m.row_ix, a.grp, a.col as lo, b.col as hi from m join rm a on a.aln_id = m.aln_id and a.row_ix = m.row_ix and a.r = s join rm b on b.aln_id = m.aln_id and b.row_ix = m.row_ix and b.r = e) f, unnest(range(f.lo, f.hi + 1)) g(col) group by all".replace("m.aln_id, f.grp, g.col, count", "f.aln_id, f.grp, g.col::int as col, count"),
        "cell_variants": f"{SQL}, {_VARIANTS} select aln_id, row_ix, col, seq_name, to_aa from (select *, row_number() over (partition by aln_id, row_ix, col order by ord) as k from pl where col is not null) where k = 1",
        "external_scores": f"{SQL}, {_VARIANTS} select ord, seq_name, position, to_aa, case when ord % 2 = 0 then greatest(0, least(100, ord * 37 % 140 - 20)) else 0 end::bigint as score,"
        f" {_R('case when ord % 2 = 0 then (ord % 10) / 10.0::double else 0 end', 'confidence')}, {_CODE('to_aa')} between 1 and 20 as foldable from vr",
        "leaf_ranks": _TREE + ", pt(node_id, path) as (select node_id, [node_id] from nodes where parent_id is null union all select n.node_id, list_append(p.path, n.node_id) from pt p join nodes n on n.parent_id = p.node_id)"
        " select node_id, (row_number() over (order by path) - 1)::bigint as leaf_rank from pt join leaf using (node_id)",
        "lca_paths": _TREE + ", pr as (select 's' || s_suppkey as a, 's' || (s_suppkey + 1) as b from supplier), l as (select a, b, min(x.dist) as da, min(y.dist) as db from pr join up x on x.node_id = a join up y on y.node_id = b and y.anc = x.anc group by a, b)"
        " select distinct a, b, anc as node_id from (select a, b, anc from l join up on up.node_id = a and dist <= da union all select a, b, anc from l join up on up.node_id = b and dist <= db)",
    }
