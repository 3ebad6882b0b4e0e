"""Registered queries of the alignment operators, with the SQL that gives the same rows."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.functions.alphabet import ALPHABET, BACKGROUND, CANONICAL, HYDROPATHY, canonicalise, ungap
from seqgrid.functions.joins import same_keys
from seqgrid.functions.lineage import cut
from seqgrid.operators import cells as c
from seqgrid.operators import features as f
from seqgrid.operators import conservation, identity, motif, profile, trees
from seqgrid.plans.bridge import SQL, sequences
from seqgrid.sources.fasta import fasta_records


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(n, 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return c.to_cells(sequences(spark, d))


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    found = conservation.scored(profile.count_vectors(sequences(spark, d)), ["shannon"]).where("total > 0")
    return _rounded(found.select("aln_id", "col", "total", "consensus", "consensus_frac", "shannon"))


def _track(spark: SparkSession, d: str, method: str) -> DataFrame:
    return _rounded(conservation.track(profile.count_vectors(sequences(spark, d)), method))


def group_tracks(spark: SparkSession, d: str) -> DataFrame:
    """threshold of all rows and of each group, a null group included, from one count by group."""
    by_group = cut(profile.count_vectors(sequences(spark, d), "grp"))
    whole = profile.merged_counts(by_group, "aln_id").select("aln_id", F.lit(True).alias("whole"), F.lit(None).cast("string").alias("grp"), "col", "n", "rows")
    both = whole.unionByName(by_group.withColumn("whole", F.lit(False)))
    found = conservation.scored(both, ["threshold"]).where("canonical > 0")
    return _rounded(found.select("aln_id", "whole", "grp", "col", F.col("threshold").alias("score"), F.col("canonical").alias("n")))


def barcode_lanes(spark: SparkSession, d: str) -> DataFrame:
    by_group = profile.count_vectors(sequences(spark, d), "grp")
    found = same_keys(conservation.scored(by_group, []).where("total > 0"), by_group.select("aln_id", "grp", "rows").distinct(), ["aln_id", "grp"])
    return _rounded(found.select("aln_id", "grp", "col", (F.col("consensus_frac") * 100).alias("conservation"), ((F.col("rows") - F.col("total")) / F.col("rows")).alias("gap_frac")))


def edit_splice(spark: SparkSession, d: str) -> DataFrame:
    a, at = F.col("aligned"), F.col("row_ix") % 20
    s = sequences(spark, d)
    return s.select("row_ix", F.md5(c.insert_gaps(a, at, F.lit(3))).alias("inserted"), F.md5(c.delete_gaps(a, at, F.lit(2))).alias("deleted"), F.md5(c.shift_right(a, F.col("row_ix") % 3)).alias("shifted"))


def mutants(spark: SparkSession, d: str) -> DataFrame:
    letters = F.lit(CANONICAL)
    s = sequences(spark, d)
    return s.select("row_ix", F.md5(c.substitute(F.col("aligned"), F.col("row_ix") % 40 + 1, F.substring(letters, F.col("row_ix") % 20 + 1, F.lit(1)))).alias("mutant"))


def queries() -> dict:
    return {
        "column_profile": column_profile,
        "threshold_track": lambda s, d: _track(s, d, "threshold"),
        "jsd_track": lambda s, d: _track(s, d, "jsd"),
        "group_tracks": group_tracks,
        "barcode_lanes": barcode_lanes,
        "residue_map": lambda s, d: c.row_residues(sequences(s, d)),
        "gap_runs": lambda s, d: c.row_gap_runs(sequences(s, d)),
        "gap_only_cols": lambda s, d: c.gap_only_columns(_cells(s, d)),
        "to_rows": lambda s, d: c.to_rows(_cells(s, d)).select("aln_id", "row_ix", F.md5("aligned").alias("aligned")),
        "fasta_wrap": lambda s, d: fasta_records(sequences(s, d)).select(F.md5("value").alias("value")),
        "ungap": lambda s, d: sequences(s, d).select("row_ix", F.md5(ungap(F.col("aligned"))).alias("ungapped"), F.md5(canonicalise(F.col("aligned"))).alias("canonical")),
        "edit_splice": edit_splice,
        "mutants": mutants,
        "features": lambda s, d: _rounded(f.features(sequences(s, d))),
        "features_z": lambda s, d: _rounded(f.z_scores(f.features(sequences(s, d)), "len", "hydro")),
        "pair_identity": lambda s, d: _rounded(identity.pair_identity(sequences(s, d))),
        "identity_summary": lambda s, d: _rounded(identity.row_summary(sequences(s, d))),
        "euclid_embeddings": lambda s, d: _rounded(f.euclidean(s.read.parquet(f"{d}/embeddings.parquet"))),
        "motif_hits": lambda s, d: motif.find_motifs(sequences(s, d), "A{1,2}N"),
        "node_info": lambda s, d: _rounded(trees.node_info(trees.geo_tree(s, d))),
    }


_Q = ", ".join(f"({ALPHABET.index(a)}, {q}::double)" for a, q in BACKGROUND.items())
_COUNT = {a: f"(length(aligned) - length(replace(aligned, '{a}', '')))" for a in CANONICAL}
_LEN = " + ".join(_COUNT.values())
_HYDRO = " + ".join(f"{_COUNT[a]} * ({HYDROPATHY[a]}::double)" for a in CANONICAL)
_FEATURES = f"ft as (select aln_id, row_ix, length(replace(aligned, '-', '')) as ungapped, {_LEN} as len, case when {_LEN} > 0 then ({_HYDRO}) / ({_LEN}) else 0 end as hydro from seqs)"
_PAIRS = """pr as (
  select a.aln_id, a.row_ix as i, b.row_ix as j, sum((a.code = b.code)::int)::bigint as same, count(*) as compared
  from cells a join cells b on a.aln_id = b.aln_id and a.col = b.col and a.row_ix < b.row_ix where a.code > 0 and b.code > 0 group by all
), pp as (select a.aln_id, a.row_ix as i, b.row_ix as j, coalesce(same, 0) as same, coalesce(compared, 0) as compared, coalesce(100 * same / compared::double, 0) as pct
  from seqs a join seqs b on a.aln_id = b.aln_id and a.row_ix < b.row_ix left join pr on pr.aln_id = a.aln_id and pr.i = a.row_ix and pr.j = b.row_ix)"""
_R = lambda x: f"round({x}, 6) + 0.0::double"
_STATS = """st as (select aln_id, col, sum(n)::bigint as total, max(n) as best, min(code) filter (n = m) as consensus
  from (select *, max(n) over (partition by aln_id, col) as m from counts) group by all)"""


def oracle_sql() -> dict:
    z = lambda d: f"round(({d} - avg({d}) over w) / coalesce(nullif(stddev_pop({d}) over w, 0), 1), 6) + 0.0::double as z_{d}"
    tree = r"""
with recursive nodes as (
  select 'root' as node_id, null as parent_id, 0.0::double as length
  union all select 'r' || r_regionkey, 'root', (r_regionkey % 7 + 1) * 0.5::double from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, (n_nationkey % 7 + 1) * 0.5::double from nation
  union all select 's' || s_suppkey, 'n' || s_nationkey, (s_suppkey % 7 + 1) * 0.5::double from supplier
),
up as (select node_id, node_id as anc, 0.0::double as dist from nodes
  union all select u.node_id, n.parent_id, u.dist + n.length from up u join nodes n on u.anc = n.node_id where n.parent_id is not null)
select a.node_id, depth, tips from (select node_id, round(max(dist), 6) + 0.0::double as depth from up group by 1) a
join (select anc as node_id, count(*) as tips from up where node_id not in (select parent_id from nodes where parent_id is not null) group by 1) b using (node_id)"""
    splice = "substr(aligned, 1, {at}) || repeat('-', 3) || substr(aligned, {at} + 1)".format(at="(row_ix % 20)")
    return {
        "column_profile": SQL + f", {_STATS}, sh as (select aln_id, col, greatest(0, least(100, (1 + sum(p * log2(p)) / {math.log2(20)!r}::double) * 100)) as shannon from canon group by all)"
        f" select st.aln_id, st.col, total, consensus, {_R('best::double / total')} as consensus_frac, {_R('shannon')} as shannon from st left join sh using (aln_id, col)",
        "threshold_track": SQL + f" select aln_id, col, {_R('max(p) * 100')} as score from canon group by all",
        "jsd_track": SQL + f", q(code, q) as (values {_Q}) select aln_id, col, {_R(f'greatest(0, least(100, (sum(p * log2(p / ((p + q) / 2)) / 2 + q * log2(q / ((p + q) / 2)) / 2 - q / 2) + {sum(BACKGROUND.values()) / 2!r}::double) * 100))')} as score from canon join q using (code) group by aln_id, col",
        "group_tracks": SQL + f", g as (select aln_id, grp, col, code, count(*) as n, grouping(grp) = 1 as whole from cells where code between 1 and 20 group by grouping sets ((aln_id, col, code), (aln_id, grp, col, code)))"
        f" select aln_id, whole, grp, col, {_R('max(n) / sum(n)::double * 100')} as score, sum(n)::bigint as n from g group by aln_id, whole, grp, col",
        "barcode_lanes": SQL + f", gc as (select aln_id, grp, col, code, count(*) as n from cells where code > 0 group by all), gs as (select aln_id, grp, col, max(n) as best, sum(n) as total from gc group by all), rw as (select aln_id, grp, count(*) as rows_ from seqs group by all)"
        f" select aln_id, grp, col, {_R('best::double / total::double * 100')} as conservation, {_R('(rows_ - total)::double / rows_')} as gap_frac from gs join rw using (aln_id, grp)",
        "residue_map": SQL + " select aln_id, row_ix, col, row_number() over (partition by aln_id, row_ix order by col) - 1 as residue_ix from cells where code > 0",
        "gap_runs": SQL + ' , g as (select *, col - row_number() over (partition by aln_id, row_ix order by col) as island from cells where code = 0) select aln_id, row_ix, min(col) as start, count(*) as "count" from g group by aln_id, row_ix, island',
        "gap_only_cols": SQL + " select aln_id, col from cells group by all having max(code) = 0",
        "to_rows": SQL + " select aln_id, row_ix, md5(aligned) as aligned from seqs where aligned <> ''",
        "fasta_wrap": SQL + r" select md5('>' || name || chr(10) || regexp_replace(regexp_replace(aligned, '(.{60})', '\1' || chr(10), 'g'), '\n$', '')) as value from seqs",
        "ungap": SQL + " select row_ix, md5(replace(aligned, '-', '')) as ungapped, md5(translate(replace(aligned, '-', ''), 'BZXUO*', 'DEACKA')) as canonical from seqs",
        "edit_splice": SQL + f" , e as (select *, row_ix % 20 as k, substr(aligned, row_ix % 20 + 1) as rest from seqs) select row_ix, md5({splice}) as inserted, md5(substr(aligned, 1, k) || substr(rest, least(length(regexp_extract(rest, '^-*')), 2) + 1)) as deleted, md5(repeat('-', row_ix % 3) || aligned) as shifted from e",
        "mutants": SQL + f" , u as (select row_ix, replace(aligned, '-', '') as s, row_ix % 40 + 1 as pos, substr('{CANONICAL}', row_ix % 20 + 1, 1) as t from seqs) select row_ix, case when pos <= length(s) then md5(substr(s, 1, pos - 1) || t || substr(s, pos + 1)) end as mutant from u",
        "features": SQL + f", {_FEATURES} select aln_id, row_ix, ungapped, len, {_R('hydro')} as hydro from ft",
        "features_z": SQL + f", {_FEATURES} select aln_id, row_ix, {z('len')}, {z('hydro')} from ft window w as (partition by aln_id)",
        "pair_identity": SQL + f", {_PAIRS} select aln_id, i, j, same, compared, {_R('pct')} as pct from pp",
        "identity_summary": SQL + f", {_PAIRS} select aln_id, {_R('avg(pct)')} as mean, {_R('stddev_pop(pct)')} as sd, {_R('min(pct)')} as min, {_R('max(pct)')} as max, count(*) as pairs, first(i order by pct, i, j) as min_i, first(j order by pct, i, j) as min_j, first(i order by pct desc, i, j) as max_i, first(j order by pct desc, i, j) as max_j from pp group by 1",
        "euclid_embeddings": f"select a.label, a.vec_id as i, b.vec_id as j, {_R('list_distance(a.embedding::double[], b.embedding::double[])')} as dist from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id",
        "motif_hits": SQL + r" , u as (select aln_id, row_ix, string_split(regexp_replace(replace(aligned, '-', ''), '(A{1,2}N)', '<\1>', 'g'), '<') as parts from seqs), x as (select *, unnest(range(2, len(parts) + 1)) as k from u)"
        " select aln_id, row_ix, k - 2 as match_ix, length(replace(array_to_string(parts[1:k - 1], ''), '>', '')) as u_start, length(replace(array_to_string(parts[1:k - 1], ''), '>', '')) + instr(parts[k], '>') - 1 as u_end from x",
        "node_info": tree,
    }
