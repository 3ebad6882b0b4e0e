"""Queries of trees, clusterings, layouts, versions, match lists and overviews, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import BACKGROUND, CANONICAL
from seqgrid.functions.lineage import cut
from seqgrid.functions.residues import RESIDUES
from seqgrid.operators import cells as c
from seqgrid.operators import clustering, columns, conservation, features, identity, joining, labels, layout, motif, newick, profile, rows, structures, trees, versions
from seqgrid.plans.bridge import SQL, sequences
from seqgrid.plans.more import _CLAMP, _LOG20, _Q, _R, _TREE, _case, atoms, rounded
from seqgrid.plans.queries import _PAIRS

GRID = (16, 8)
REPLICATES = 20


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.long_counts(profile.count_vectors(sequences(spark, d)))


def named_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tables' tree with numbered children; node names are kept at leaves alone, as trees in text do."""
    nodes = trees.geo_tree(spark, d).withColumn("tree_id", F.lit(1)).withColumn("support", F.lit(None).cast("double"))
    nth = W.partitionBy("parent_id").orderBy("node_id")
    return nodes.withColumn("child_ix", F.row_number().over(nth) - 1).withColumn("name", F.col("node_id"))


def tree_text(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the tree after a way through text: their branch and how many siblings they have."""
    nodes = newick.parse_trees(newick.format_newick(named_tree(spark, d))).withColumn("siblings", F.count("*").over(W.partitionBy("tree_id", "parent_id")))
    return rounded(nodes.where("name is not null").select("name", "length", "siblings"))


def splits(spark: SparkSession, d: str) -> DataFrame:
    return trees.bipartitions(named_tree(spark, d)).select("node_id", F.size("split").alias("leaves"), F.md5(F.array_join("split", ",")).alias("split"))


def joined_trees(spark: SparkSession, d: str) -> DataFrame:
    """A tree of each source's documents with bootstrap support."""
    return rounded(joining.build_trees(sequences(spark, d), REPLICATES))


def composition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.composition(sequences(spark, d)))


def distance_global(spark: SparkSession, d: str) -> DataFrame:
    """Identity distance over the columns 10 to 200 in which no row of the source has a gap."""
    s = sequences(spark, d)
    zones = s.select("aln_id").distinct().select("aln_id", F.lit(10).alias("first"), F.lit(200).alias("last"))
    return rounded(identity.identity_distance(s, columns.ungapped_columns(_counts(spark, d), s), zones))


def _labelled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of each label as an alignment's rows."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    return v.select(F.col("label").alias("aln_id"), F.col("vec_id").alias("row_ix"), F.col("embedding").cast("array<double>").alias("v"))


def density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clustering.vector_density_peaks(_labelled_vectors(spark, d)))


def peaks(spark: SparkSession, d: str) -> DataFrame:
    return clustering.peak_clusters(clustering.vector_density_peaks(_labelled_vectors(spark, d)))


def _labelled_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    return v.select(F.col("label").alias("aln_id"), F.col("vec_id").alias("row_ix")), features.euclidean(v).withColumnRenamed("label", "aln_id")


def cluster_silhouettes(spark: SparkSession, d: str) -> DataFrame:
    """How well the vectors of each label part by the remainders of their id by 2, 3 and 4."""
    parts = F.array(*[(F.col("row_ix") % k).cast("int") for k in (2, 3, 4)])
    return rounded(clustering.silhouettes(_labelled_vectors(spark, d).withColumn("clusters", parts)))


def column_labels(spark: SparkSession, d: str) -> DataFrame:
    scores = cut(conservation.scored(profile.count_vectors(sequences(spark, d)), ["jsd"]).where("canonical > 0").select("aln_id", "col", F.col("jsd").alias("score"), "total"))
    return labels.label_tally(labels.auto_labels(scores), scores)


def conservation_job(spark: SparkSession, d: str) -> DataFrame:
    """Two tracks of all rows, with labels, and of each language, from one scan of the texts."""
    return rounded(conservation.conservation_job(sequences(spark, d), ["shannon", "jsd"]))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d)
    number = s.select(F.col("grp").alias("lang")).distinct().withColumn("cluster", F.row_number().over(W.orderBy("lang")) * 2)  # a row per language
    return s.join(F.broadcast(number), F.col("grp").eqNullSafe(F.col("lang"))).select("aln_id", "row_ix", "cluster", (F.col("cluster") == 4).alias("others"))


def laid_out(spark: SparkSession, d: str) -> DataFrame:
    """Every third row gets a gap in front, in reversed order; every ninth of them has other residues."""
    s = sequences(spark, d)
    given = s.where("row_ix % 3 = 0").select("aln_id", "name", (-F.col("row_ix")).alias("nth"), F.concat(F.lit("-"), "aligned", F.when(F.col("row_ix") % 9 == 0, "A").otherwise("")).alias("aligned"))
    return layout.apply_layout(s, given).select("aln_id", "row_ix", "name", F.md5("aligned").alias("aligned"), "applied")


def moved(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d)
    return layout.move_rows(s, s.where("row_ix % 5 = 0").select("aln_id", "row_ix"), 7).select("aln_id", "row_ix", "name")


def match_list(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d).where("aln_id is not null")
    return motif.match_list(motif.aligned_matches(s, "A{1,2}N"))


def _versioned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A version for each source; names repeat over versions."""
    s = sequences(spark, d).withColumn("version_id", F.expr("cast(regexp_extract(aln_id, '[0-9]+$', 0) as int)"))
    made = s.select("version_id", "row_ix", F.concat(F.lit("n"), (F.col("row_ix") % 97).cast("string")).alias("name"), "aligned")
    return s.select("version_id", F.col("aln_id").alias("name")).distinct().withColumn("parent_id", F.nullif(F.col("version_id") - 1, F.lit(-1))), made


def forked(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each version after a fork of version 3, with a new name for version 5 and without version 4."""
    v, r = versions.fork(*_versioned(spark, d), 3, "copy")
    v = versions.remove(versions.rename(v, 5, "five"), 4)
    return v.join(r, "version_id").groupBy("version_id", v["name"], "parent_id").agg(F.count("*").alias("n"), F.min("row_ix").alias("first_row"))


def merged(spark: SparkSession, d: str) -> DataFrame:
    """Own versions with those of even number merged in again."""
    v, _ = _versioned(spark, d)
    return versions.merge(v, v.where("version_id % 2 = 0"))


def site_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each model fitted on the next one, read at residue 5."""
    a = atoms(spark, d)
    pairs = a.select(F.col("model_id").alias("mobile")).distinct().withColumn("ref", F.col("mobile") + 1)
    met = structures.matched(a, pairs)
    fits = structures.superpose(met)
    return rounded(structures.mutant_summary(pairs.withColumn("position", F.lit(5)), a, structures.deviations(met, fits)))


def queries() -> dict:
    return {
        "tree_text": tree_text,
        "bipartitions": splits,
        "joined_trees": joined_trees,
        "composition": composition,
        "distance_global": distance_global,
        "identity_report": lambda s, d: rounded(identity.identity_report(sequences(s, d), identity.pair_identity(sequences(s, d)))),
        "density_peaks": density,
        "pair_density_peaks": density,
        "cluster_silhouettes": cluster_silhouettes,
        "conservation_job": conservation_job,
        "peak_clusters": peaks,
        "hierarchic": lambda s, d: clustering.hierarchic_vectors(_labelled_vectors(s, d)),
        "column_labels": column_labels,
        "group_layout": lambda s, d: clustering.group_layout(_languages(s, d)),
        "apply_layout": laid_out,
        "move_rows": moved,
        "match_list": match_list,
        "version_names": lambda s, d: versions.name_table(_versioned(s, d)[1]),
        "version_fork": forked,
        "version_merge": merged,
        "overview": lambda s, d: rows.overview(sequences(s, d), *GRID),
        "residue_kinds": lambda s, d: rows.described(c.to_cells(sequences(s, d)).select("aln_id", "code")).groupBy("aln_id", "residue", "three", "kind").agg(F.count("*").alias("cells")),
        "site_summary": site_summary,
    }


def _density_sql() -> str:
    return (
        "with p as (select a.label as aln_id, a.vec_id as i, b.vec_id as j, list_distance(a.embedding::double[], b.embedding::double[]) as dist from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id),"
        " k as (select *, row_number() over (partition by aln_id order by dist, i, j) - 1 as nth, count(*) over (partition by aln_id) as n from p),"
        " r as (select aln_id, max(dist) as far, coalesce(nullif(max(dist) filter (nth = floor(n * 0.02::double)), 0), nullif(min(dist), 0), 1) as reach from k group by 1),"
        " b as (select aln_id, i, j, dist from p union all select aln_id, j, i, dist from p),"
        " rh as (select aln_id, i as row_ix, sum(exp(-power(dist / reach, 2))) as rho, max(far) as far from b join r using (aln_id) group by 1, 2),"
        " rk as (select e.label as aln_id, e.vec_id as row_ix, coalesce(rho, 0) as rho, far, row_number() over (partition by e.label order by coalesce(rho, 0) desc, e.vec_id) as rank from embeddings e left join rh on rh.aln_id = e.label and rh.row_ix = e.vec_id),"
        " nd as (select x.aln_id, x.row_ix, min(dist) as delta, first(y.row_ix order by dist, y.rank) as denser from rk x join b on b.aln_id = x.aln_id and b.i = x.row_ix join rk y on y.aln_id = b.aln_id and y.row_ix = b.j where y.rank < x.rank group by 1, 2)"
        f" select aln_id, row_ix, {_R('rho', 'rho')}, {_R('coalesce(delta, far, 0)', 'delta')}, rank, denser from rk left join nd using (aln_id, row_ix)"
    )


def _silhouette_sql() -> str:
    return (
        "with e as (select label, vec_id, embedding::double[] as v, nth, (vec_id % (nth + 2))::int as c from embeddings, range(3) t(nth)),"
        " p as (select a.label, a.nth, a.vec_id as i, b.c, list_distance(a.v, b.v) as d from e a join e b on a.label = b.label and a.nth = b.nth and a.vec_id <> b.vec_id),"
        " m as (select label, nth, i, c, avg(d) as d from p group by all), s as (select label, nth, i, min(d) filter (c = i % (nth + 2)) as a, min(d) filter (c <> i % (nth + 2)) as b from m group by all)"
        f" select e.label as aln_id, e.nth::int as nth, {_R('case when count(b) = 0 then -1 else avg(case when a is null or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end) end', 'silhouette')}"
        " from e left join s on e.label = s.label and e.nth = s.nth and e.vec_id = s.i group by e.label, e.nth"
    )


def _job_sql() -> str:
    """Tracks of all rows and of each language; labels by k-means in a recursion over its rounds."""
    jsd = f"(sum(p * log2(p / ((p + q) / 2)) / 2 + q * log2(q / ((p + q) / 2)) / 2 - q / 2) + {sum(BACKGROUND.values()) / 2!r}::double) * 100"
    near = "list_position(list_transform(c, lambda y: abs(y - x)), list_min(list_transform(c, lambda y: abs(y - x))))"
    return f"""{SQL}, q(code, q) as (values {_Q}),
gc as (select aln_id, true as whole, null::varchar as grp, col, code, count(*) as n from cells where code > 0 group by aln_id, col, code
  union all select aln_id, false, grp, col, code, count(*) from cells where code > 0 and grp is not null group by aln_id, grp, col, code),
allc as (select aln_id, true as whole, null::varchar as grp, col, count(*) filter (code > 0) as total from cells group by aln_id, col
  union all select aln_id, false, grp, col, count(*) filter (code > 0) from cells where grp is not null group by aln_id, grp, col),
gp as (select *, n::double / sum(n) over (partition by aln_id, whole, grp, col) as p from gc where code between 1 and 20),
sh as (select aln_id, whole, grp, col, {_CLAMP(f"(1 + sum(p * log2(p)) / {_LOG20}) * 100")} as shannon, {_CLAMP(jsd)} as jsd from gp join q using (code) group by all),
tr as (select a.*, m.method, case when m.method = 'shannon' then shannon else jsd end as score from allc a cross join (values ('shannon'), ('jsd')) m(method)
  left join sh on sh.aln_id is not distinct from a.aln_id and sh.whole = a.whole and sh.grp is not distinct from a.grp and sh.col = a.col),
va as (select aln_id, method, score::float::double as x, count(*) as n from tr where whole and total >= 6 and score is not null group by all),
st as (select aln_id, method, min(x) as lo, max(x) as hi, least(count(*), 3) as k from va group by all),
ce(aln_id, method, it, c) as (select aln_id, method, 0, list_transform(range(k), lambda i: lo + (i + 0.5::double) * (hi - lo) / k) from st
  union all select aln_id, method, it + 1, list_transform(range(1, len(c) + 1), lambda i: coalesce(map_extract(means, i)[1], c[i])) from (
    select aln_id, method, it, c, map_from_entries(list((nr, m))) as means from (
      select ce.aln_id, ce.method, it, c, {near} as nr, sum(x * n) / sum(n) as m from ce join va on va.aln_id = ce.aln_id and va.method = ce.method where it < 40 group by all) group by all)),
en as (select * from ce where it = 40),
hd as (select distinct en.aln_id, en.method, {near} as nr, c[{near}] as m from en join va on va.aln_id = en.aln_id and va.method = en.method),
rk as (select *, row_number() over (partition by aln_id, method order by m desc, nr) as nth from hd),
sited as (select tr.*, case when total >= 6 and score is not null then {near.replace("x)", "score::float::double)")} end as nr from tr left join en on whole and en.aln_id = tr.aln_id and en.method = tr.method)
select s.aln_id, whole, grp, col, s.method, {_R("score", "score")}, total, case when not whole then null when s.nr is null then 0 else greatest(0, 3 - nth) end::int as label
from sited s left join rk on whole and rk.aln_id = s.aln_id and rk.method = s.method and rk.nr = s.nr"""


def oracle_sql() -> dict:
    residues = {k: {a: v[k] for a, v in RESIDUES.items()} for k in range(3)}
    count = " union all ".join(f"select aln_id, row_ix, '{a}' as residue, length(aligned) - length(replace(aligned, '{a}', '')) as n from seqs" for a in CANONICAL)
    ver = "vs as (select distinct regexp_extract(aln_id, '[0-9]+$')::int as version_id, aln_id as name, nullif(version_id - 1, -1) as parent_id from seqs), vr as (select regexp_extract(aln_id, '[0-9]+$')::int as version_id, row_ix, 'n' || (row_ix % 97) as name from seqs)"
    first = "(select aln_id, name, min(row_ix) as row_ix from seqs group by all)"
    w, h = GRID
    return {
        "tree_text": _TREE + ", ns as (select *, count(*) over (partition by parent_id) as siblings from nodes) select node_id as name, " + _R("length", "length") + ", siblings from ns join leaf using (node_id)",
        "bipartitions": _TREE + ", un as (select anc as node_id, list_sort(list(node_id)) as l from up join leaf using (node_id) group by 1), al as (select list_sort(list(node_id)) as a from leaf),"
        " sd as (select node_id, case when list_contains(l, a[1]) then list_filter(a, lambda x: not list_contains(l, x)) else l end as s from un, al where node_id not in (select node_id from leaf) and len(l) between 2 and len(a) - 2)"
        " select max(node_id) as node_id, len(s)::int as leaves, md5(array_to_string(s, ',')) as split from sd group by s",
        "composition": f"{SQL}, ct as ({count}), tt as (select *, sum(n) over (partition by aln_id, row_ix) as t from ct) select aln_id, row_ix, residue, n::int as n, {_R('case when t > 0 then n / t::double else 0 end', 'share')} from tt",
        "distance_global": SQL + ", rw as (select aln_id, count(*) as k from seqs group by 1), uc as (select aln_id, col from counts join rw using (aln_id) where col between 10 and 200 group by aln_id, col, k having sum(n) = k),"
        " m as (select a.aln_id, a.row_ix as i, b.row_ix as j, sum((a.code = b.code)::int)::bigint as same, count(*) as compared from cells a join uc using (aln_id, col) join cells b on a.aln_id = b.aln_id and a.col = b.col and a.row_ix < b.row_ix group by all)"
        f" select a.aln_id, a.row_ix as i, b.row_ix as j, coalesce(same, 0) as same, coalesce(compared, 0) as compared, {_R('coalesce(1 - same / compared::double, 1)', 'dist')} from seqs a join seqs b on a.aln_id = b.aln_id and a.row_ix < b.row_ix left join m on m.aln_id = a.aln_id and m.i = a.row_ix and m.j = b.row_ix",
        "identity_report": SQL + f", {_PAIRS} select aln_id, i, j, {_R('pct', 'pct')} from (select aln_id, i, j, pct from pp union all select aln_id, j, i, pct from pp union all select aln_id, row_ix, row_ix, 100.0::double from seqs)",
        "density_peaks": _density_sql(),
        "pair_density_peaks": _density_sql(),
        "cluster_silhouettes": _silhouette_sql(),
        "conservation_job": _job_sql(),
        "group_layout": SQL + ", g as (select aln_id, row_ix, dense_rank() over (order by grp nulls first) * 2 as cluster from seqs)"
        " select aln_id, row_ix, dense_rank() over (partition by aln_id order by cluster) - 1 as group_id, case when cluster = 4 then 'Others' else 'Group ' || (cluster + 1) end as name, row_number() over (partition by aln_id order by cluster, row_ix) - 1 as position from g",
        "apply_layout": SQL + f", m as (select aln_id, row_ix, row_number() over (partition by aln_id order by row_ix) as k, row_number() over (partition by aln_id order by -row_ix) as t from {first} where row_ix % 3 = 0),"
        " mv as (select a.aln_id, a.row_ix, b.row_ix as slot from m a join m b on a.aln_id = b.aln_id and a.t = b.k)"
        " select s.aln_id, coalesce(slot, s.row_ix) as row_ix, name, md5(case when s.row_ix % 3 = 0 and s.row_ix % 9 <> 0 then '-' || aligned else aligned end) as aligned, s.row_ix % 3 = 0 and s.row_ix % 9 <> 0 as applied from seqs s left join mv on mv.aln_id = s.aln_id and mv.row_ix = s.row_ix",
        "move_rows": SQL + ", k as (select aln_id, row_ix, name, row_number() over (partition by aln_id order by row_ix) - 1 as slot from seqs)"
        " select aln_id, (row_number() over (partition by aln_id order by case when row_ix % 5 = 0 then 1 when slot < 7 then 0 else 2 end, row_ix) - 1)::int as row_ix, name from k",
        "match_list": SQL + r", rm as (select aln_id, row_ix, col, row_number() over (partition by aln_id, row_ix order by col) - 1 as r from cells where code > 0), u as (select aln_id, row_ix, string_split(regexp_replace(replace(aligned, '-', ''), '(A{1,2}N)', '<\1>', 'g'), '<') as parts from seqs), x as (select *, unnest(range(2, len(parts) + 1)) as k from u),"
        " m as (select aln_id, row_ix, k - 2 as match_ix, length(replace(array_to_string(parts[1:k - 1], ''), '>', '')) as s, s + instr(parts[k], '>') - 2 as e from x),"
        " l as (select m.aln_id, m.row_ix, match_ix, a.col as col_from, b.col + 1 as col_to from m join rm a on a.aln_id = m.aln_id and a.row_ix = m.row_ix and a.r = s join rm b on b.aln_id = m.aln_id and b.row_ix = m.row_ix and b.r = e),"
        " n as (select *, row_number() over (partition by aln_id order by row_ix, col_from) - 1 as nth, count(*) over (partition by aln_id) as matches from l)"
        " select aln_id, row_ix, match_ix, col_from, col_to, nth, matches, (nth + 1) % matches as next, (nth - 1 + matches) % matches as previous from n",
        "version_names": f"{SQL}, {ver} select name, row_number() over (order by v, r) - 1 as ref from (select name, min((version_id, row_ix)) as f, f[1] as v, f[2] as r from vr group by 1)".replace("min((version_id, row_ix)) as f, f[1] as v, f[2] as r", "first(version_id order by version_id, row_ix) as v, first(row_ix order by version_id, row_ix) as r"),
        "version_fork": f"{SQL}, {ver}, top as (select max(version_id) + 1 as n from vs), v2 as (select version_id, case when version_id = 5 then 'five' else name end as name, parent_id from vs where version_id <> 4 union all select n, 'copy', 3 from top),"
        " r2 as (select version_id, row_ix from vr union all select n, row_ix from vr, top where version_id = 3) select v2.version_id, v2.name, parent_id, count(*) as n, min(row_ix) as first_row from v2 join r2 on v2.version_id = r2.version_id group by all",
        "version_merge": f"{SQL}, {ver}, top as (select max(version_id) as t from vs), f as (select *, row_number() over (order by version_id) + t as id from vs, top where version_id % 2 = 0)"
        " select version_id, name, parent_id, null::int as old_id from vs union all select f.id, f.name || ' 2', p.id, f.version_id from f left join f p on f.parent_id = p.version_id",
        "overview": SQL + f", sz as (select aln_id, count(*) as n, max(length(aligned)) as w from seqs group by 1), k as (select *, row_number() over (partition by aln_id order by row_ix) - 1 as nth from seqs),"
        f" g as (select aln_id, x::int as x, y::int as y, least(n - 1, y * n // {h}) as nth, least(w - 1, x * w // {w})::int as col from sz, range({w}) a(x), range({h}) b(y) where w > 0)"
        " select aln_id, x, y, row_ix, col, case when col >= length(aligned) then '-' else aligned[col + 1] end as ch from g join k using (aln_id, nth)",
        "residue_kinds": f"{SQL} select aln_id, {_case(residues[0], 'code')} as residue, {_case(residues[1], 'code')} as three, {_case(residues[2], 'code')} as kind, count(*) as cells from cells group by all",
    }
